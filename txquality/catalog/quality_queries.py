"""Admission, gate, declared tests, contract and quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog import sql as Q
from txquality.catalog.registry import query
from txquality.operators import admission
from txquality.plans import marts, quality
from txquality.sources import star_tables as st

_KEYS = ["order_key", "line_number", "part_key", "supp_key"]
_V_MISSING = " or ".join(f"{v} is null or isnan({v})" for v in Q.V)
_JUDGED = f"""judged as (
  select *, concat_ws(',',
    case when time is null or isnan(time) then 'time_missing' end, case when time < 0 then 'time_negative' end,
    case when amount is null or isnan(amount) then 'amount_missing' end,
    case when amount < 0 then 'amount_negative' end,
    case when {_V_MISSING} then 'component_missing' end,
    case when is_fraud is null then 'label_missing' end,
    case when is_fraud not in (0, 1) then 'label_out_of_domain' end) as reasons
  from inbound)"""


@query(
    "row_admission",
    f"with {Q.INBOUND}, {_JUDGED} select order_key, line_number, part_key, supp_key, amount, reasons, reasons = '' as is_valid from judged",
)
def row_admission(spark, sf_dir):
    judged = admission.judged(st.inbound_rows(spark, sf_dir))
    return judged.select(*_KEYS, "amount", F.concat_ws(",", "reasons").alias("reasons"), "is_valid")


@query(
    "row_admission_reasons",
    f"with {Q.INBOUND}, {_JUDGED}, split as (select unnest(string_split(reasons, ',')) as reason from judged where reasons <> '') "
    "select reason, count(*) as row_count from split group by 1",
)
def row_admission_reasons(spark, sf_dir):
    return admission.reason_counts(st.inbound_rows(spark, sf_dir))


@query(
    "batch_admission",
    f"with {Q.INBOUND}, {_JUDGED} select batch_day, count(*) as row_count, count(*) filter (where reasons <> '') as bad_rows, "
    "count(*) filter (where reasons <> '') = 0 as accepted from judged group by 1",
)
def batch_admission(spark, sf_dir):
    return admission.batch_verdict(st.inbound_rows(spark, sf_dir), ["batch_day"])


@query(
    "scoring_input_admission",
    f"with {Q.INBOUND}, {_JUDGED} select order_key, line_number, part_key, supp_key, amount, "
    "time >= 0 and amount >= 0 and not coalesce(isnan(time), true) and not coalesce(isnan(amount), true) "
    f"and not ({_V_MISSING}) as is_valid from judged",
)
def scoring_input_admission(spark, sf_dir):
    judged = admission.judged(st.inbound_rows(spark, sf_dir), label=None)
    return judged.select(*_KEYS, "amount", "is_valid")


@query(
    "quality_gate",
    f"""with {Q.INBOUND}, counts as (
      select count(*) as row_count, count(*) filter (where amount is null) as c2, count(*) filter (where is_fraud is null) as c3,
             count(*) filter (where is_fraud not in (0, 1)) as c4, count(*) filter (where amount < 0) as c5 from inbound),
    checks as (
      select 1 as check_no, 'required_columns' as check_name, 0::bigint as failures, row_count from counts
      union all select 2, 'null_amount', c2, row_count from counts
      union all select 3, 'null_class', c3, row_count from counts
      union all select 4, 'class_domain', c4, row_count from counts
      union all select 5, 'negative_amount', c5, row_count from counts)
    select row_count, check_no, check_name, failures, case when failures = 0 then 'pass' else 'fail' end as status from checks""",
)
def quality_gate(spark, sf_dir):
    return quality.gate_report(st.inbound_rows(spark, sf_dir).withColumnRenamed("is_fraud", "class"))


def _suite_sql() -> str:
    model_sql = {
        "stg_transactions": "(select row_uid as transaction_id, load_id, time as time_seconds, amount, class as is_fraud from tx)",
        "fct_transactions_clean": "(select row_uid as transaction_id, amount, class as is_fraud from tx where amount >= 0)",
        "fct_transactions_features": "feats",
        "agg_fraud_hourly_summary": "(select hour_of_day, sum(is_fraud)::double / count(*) as fraud_rate from feats group by 1)",
    }
    selects = []
    for c in quality.declared_checks():
        source = model_sql[c.model]
        if c.kind == "unique":
            failures = (
                f"(select count(*) from (select {c.column} from {source} where {c.column} is not null "
                f"group by 1 having count(*) > 1))"
            )
        else:
            if c.kind == "not_null":
                rule = f"{c.column} is null"
            elif c.kind == "accepted_values":
                rule = f"{c.column} not in ({', '.join(repr(v) for v in c.args['values'])})"
            elif c.kind == "accepted_range":
                rule = " or ".join(
                    [f"{c.column} < {c.args['min_value']}"]
                    + ([f"{c.column} > {c.args['max_value']}"] if "max_value" in c.args else [])
                )
            else:
                rule = f"{c.column} < 0"
            failures = f"(select count(*) from {source} where {rule})"
        selects.append(
            f"select '{c.model}' as model, '{c.column}' as column_name, '{c.kind}' as test, {failures}::bigint as failures"
        )
    return f"with {Q.CORE}, {Q.FEATS}, results as (" + " union all ".join(selects) + ")"


_SUITE = _suite_sql()


@query(
    "quality_suite",
    _SUITE + " select *, case when failures = 0 then 'pass' else 'fail' end as status from results",
)
def quality_suite(spark, sf_dir):
    return quality.run_suite(quality.suite_models(st.raw_core(spark, sf_dir)))


@query(
    "quality_roll_up",
    _SUITE + " select count(*) filter (where failures = 0) as passed, count(*) as total, "
    "cast(count(*) filter (where failures = 0) as varchar) || '/' || cast(count(*) as varchar) || ' PASS' as summary from results",
)
def quality_roll_up(spark, sf_dir):
    return quality.roll_up(quality.run_suite(quality.suite_models(st.raw_core(spark, sf_dir))))


@query(
    "unique_violations",
    f"with {Q.INBOUND} select order_key, line_number, count(*) as n_records from inbound "
    "where order_key is not null and line_number is not null group by 1, 2 having count(*) > 1",
)
def unique_violations(spark, sf_dir):
    return quality.duplicate_keys(st.inbound_rows(spark, sf_dir), "order_key", "line_number")


@query("accepted_range_violations", "select c_custkey, c_name, c_acctbal from customer where c_acctbal < 0 or c_acctbal > 9000")
def accepted_range_violations(spark, sf_dir):
    customer = st.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return quality.out_of_range(customer, "c_acctbal", 0, 9000)


@query(
    "accepted_values_violations",
    "select event_type as value_field, count(*) as n_records from events where event_type not in ('view', 'click') group by 1",
)
def accepted_values_violations(spark, sf_dir):
    return quality.unexpected_values(st.table(spark, sf_dir, "events"), "event_type", ["view", "click"])


@query(
    "not_null_violations",
    "select d.doc_id, d.lang, l.quality from documents d left join labels l on d.doc_id = l.doc_id where l.quality is null",
)
def not_null_violations(spark, sf_dir):
    documents = st.table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = st.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.null_rows(documents.join(labels, "doc_id", "left"), "quality")


def _negative_amounts(df):
    return df.filter(F.col("amount") < 0)


@query(
    "negative_amounts",
    f"with {Q.INBOUND} select order_key, line_number, part_key, supp_key, amount from inbound where amount < 0",
)
def negative_amounts(spark, sf_dir):
    return _negative_amounts(st.inbound_rows(spark, sf_dir)).select(*_KEYS, "amount")


def _inbound_features(spark, sf_dir):
    """Inbound rows in the shape of the features table, before cleaning."""
    rows = st.inbound_rows(spark, sf_dir)
    shaped = rows.select(
        F.concat_ws(":", "order_key", "line_number").alias("transaction_id"),
        F.concat(F.lit("load-"), F.col("batch_day").cast("string")).alias("load_id"),
        F.col("time").alias("time_seconds"),
        *S.V_COLUMNS,
        "amount",
        "is_fraud",
    )
    return marts.with_features(shaped)


_INBOUND_FEATS = f"""shaped as (
  select cast(order_key as varchar) || ':' || cast(line_number as varchar) as transaction_id,
         'load-' || cast(batch_day as varchar) as load_id, time as time_seconds, {", ".join(Q.V)}, amount, is_fraud,
         {Q.HOUR} as hour_of_day, case when amount > -1 then ln(amount + 1) end as log_amount,
         {Q.BUCKET} as amount_bucket
  from inbound)"""


def _contract_sql() -> str:
    rows = []
    for name, _, nullable, unique, domain, _ in S.CONTRACT:
        nulls = "0" if nullable else f"(select count(*) from shaped where {name} is null)"
        dup = f"(select count(*) from (select {name} from shaped group by 1 having count(*) > 1))" if unique else "0"
        dom = f"(select count(*) from shaped where not ({domain}))" if domain else "0"
        rows.append(
            f"select '{name}' as column_name, true as type_ok, {nulls}::bigint as null_rows, {dup}::bigint as duplicate_keys, "
            f"{dom}::bigint as out_of_domain"
        )
    return (
        f"with {Q.INBOUND}, {_INBOUND_FEATS}, rows_ as ("
        + " union all ".join(rows)
        + ") select *, null_rows + duplicate_keys + out_of_domain = 0 as ok from rows_"
    )


@query("contract_check", _contract_sql())
def contract_check(spark, sf_dir):
    return quality.contract_check(_inbound_features(spark, sf_dir))


@query(
    "quality_dimensions",
    f"""with {Q.INBOUND}, {_INBOUND_FEATS}, c as (
      select count(*) filter (where amount is null) + count(*) filter (where is_fraud is null)
             + count(*) filter (where time_seconds is null) + count(*) filter (where transaction_id is null) as completeness,
             count(*) filter (where is_fraud not in (0, 1)) + count(*) filter (where amount < 0)
             + count(*) filter (where hour_of_day not between 0 and 23)
             + count(*) filter (where amount_bucket not in ('zero', 'low', 'medium', 'high', 'very_high')) as validity,
             count(*) filter (where amount > -1 and abs(log_amount - ln(greatest(amount, 0) + 1)) > 1e-9 and amount >= 0) as consistency,
             count(*) filter (where amount < 0) as business_consistency,
             count(*) filter (where load_id is null) as traceability,
             count(*) filter (where time_seconds < 0) as uniformity,
             (select count(*) from (select transaction_id from shaped group by 1 having count(*) > 1)) as uniqueness
      from shaped),
    d as (
      select 1 as dimension_no, 'completeness' as dimension, completeness as violations, null as fixed from c
      union all select 2, 'validity', validity, null from c
      union all select 3, 'consistency', consistency, null from c
      union all select 4, 'business_consistency', business_consistency, null from c
      union all select 5, 'uniqueness', uniqueness, null from c
      union all select 6, 'accuracy', null, 'not verifiable' from c
      union all select 7, 'freshness', null, 'not applicable' from c
      union all select 8, 'integrity', null, 'not applicable' from c
      union all select 9, 'traceability', traceability, null from c
      union all select 10, 'uniformity', uniformity, null from c
      union all select 11, 'documentation', 0, null from c)
    select dimension_no, dimension, violations, coalesce(fixed, case when violations = 0 then 'pass' else 'fail' end) as status from d""",
)
def quality_dimensions(spark, sf_dir):
    return quality.dimensions(_inbound_features(spark, sf_dir))


@query(
    "derived_consistency",
    f"with {Q.CORE}, {Q.FEATS} select count(*) as row_count, count(*) filter (where abs(log_amount - ln(amount + 1)) > 1e-9) as inconsistent_rows from feats",
)
def derived_consistency(spark, sf_dir):
    return quality.derived_consistency(marts.features_from_raw(st.raw_core(spark, sf_dir)))
