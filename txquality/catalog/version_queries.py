"""Change batches, version history, snapshots and the model registry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog import sql as Q
from txquality.catalog.registry import query
from txquality.functions import columns as C
from txquality.plans import evaluation, registry, versions
from txquality.session import shared_dir
from txquality.sources import star_tables as st

FIELDS = ["amount", "is_fraud"]


def _base(spark, sf_dir):
    return st.raw_core(spark, sf_dir).select("id", "time", "amount", F.col("class").alias("is_fraud"), "row_uid")


def _batch(spark, sf_dir, known_only=True):
    """Change batch: edits from all order lines (several per row), deletions from open orders, new rows from all customers.

    Keys beyond the rows wrap around, so that every line is an edit; ``known_only=False`` leaves them as they are.
    """
    item, orders, customer = (st.table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    updates = item.select(
        F.col("l_orderkey").alias("id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).alias("amount"),
        F.when(F.col("l_linestatus") == "O", F.lit(1)).cast("long").alias("is_fraud"),
    )
    deletes = orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("id"))
    if known_only:
        rows = st.table(spark, sf_dir, "events").agg(F.count(F.lit(1))).scalar()
        updates, deletes = (t.withColumn("id", F.col("id") % rows) for t in (updates, deletes))
    creates = customer.select(
        F.col("c_custkey").alias("pos"),
        (F.col("c_custkey") * F.lit(10.0)).alias("time"),
        F.col("c_acctbal").alias("amount"),
        F.lit(0).cast("long").alias("is_fraud"),
        F.sha2(F.concat(F.lit("create:"), F.col("c_custkey").cast("string")), 256).alias("row_uid"),
    )
    return updates, deletes, creates


_TX = f"{Q.CORE}, t as (select id, time, amount, class as is_fraud, row_uid from tx)"
_BATCH = f"""{_TX},
updates as (
  select l_orderkey % (select count(*) from events) as id,
         row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos,
         case when l_returnflag = 'A' then l_extendedprice end as amount, (case when l_linestatus = 'O' then 1 end)::bigint as is_fraud
  from lineitem),
deletes as (select o_orderkey % (select count(*) from events) as id from orders where o_orderstatus = 'P'),
creates as (
  select c_custkey as pos, c_custkey * 10.0::double as time, c_acctbal as amount, 0::bigint as is_fraud,
         sha256('create:' || c_custkey) as row_uid from customer),
folded as (
  select id, arg_max(amount, pos) filter (where amount is not null) as amount, arg_max(is_fraud, pos) filter (where is_fraud is not null) as is_fraud
  from updates group by 1),
kept as (
  select t.id, t.time, coalesce(f.amount, t.amount) as amount, coalesce(f.is_fraud, t.is_fraud) as is_fraud, t.row_uid
  from t left join folded f on f.id = t.id where t.id not in (select id from deletes)),
after_ as (
  select row_number() over (order by id) - 1 as id, time, amount, is_fraud, row_uid from kept
  union all
  select (select count(*) from kept) + row_number() over (order by pos) - 1, time, amount, is_fraud, row_uid from creates)"""


@query("apply_changes", f"with {_BATCH} select * from after_")
def apply_changes(spark, sf_dir):
    return versions.apply_changes(_base(spark, sf_dir), *_batch(spark, sf_dir), FIELDS)


@query(
    "change_counts",
    f"""with {_BATCH}, c as (
      select (select count(*) from creates) as rows_created,
             (select count(*) from updates where id not in (select id from deletes)) as rows_updated,
             (select count(distinct id) from deletes) as rows_deleted)
    select *, rows_created || ' rows created, ' || rows_updated || ' rows updated, ' || rows_deleted || ' rows deleted' as message from c""",
)
def change_counts(spark, sf_dir):
    return versions.change_counts(*_batch(spark, sf_dir))


@query(
    "staged_changes",
    f"with {_BATCH} select (select count(*) from (select id from updates union select id from deletes)) + (select count(*) from creates) as staged_changes",
)
def staged_changes(spark, sf_dir):
    return versions.staged_count(*_batch(spark, sf_dir))


@query(
    "unknown_change_ids",
    "select l_orderkey as id from lineitem where l_orderkey >= (select count(*) from events) "
    "union select o_orderkey from orders where o_orderstatus = 'P' and o_orderkey >= (select count(*) from events)",
)
def unknown_change_ids(spark, sf_dir):
    updates, deletes, _ = _batch(spark, sf_dir, known_only=False)
    return versions.unknown_ids(st.table(spark, sf_dir, "events").count(), updates, deletes)


@query(
    "version_diff",
    f"""with {_BATCH}, d as (
      select coalesce(b.row_uid, a.row_uid) as row_uid, case when b.row_uid is null then 'added' when a.row_uid is null then 'removed'
        when (b.time, b.amount, b.is_fraud) is distinct from (a.time, a.amount, a.is_fraud) then 'changed' end as change
      from t b full outer join after_ a on a.row_uid = b.row_uid)
    select * from d where change is not null""",
)
def version_diff(spark, sf_dir):
    base = _base(spark, sf_dir)
    after = versions.apply_changes(base, *_batch(spark, sf_dir), FIELDS)
    return versions.diff(base, after, "row_uid", ["time", "amount", "is_fraud"])


@query(
    "changed_fields",
    f"""with {_BATCH}, d as (
      select t.id, concat_ws(',', case when t.amount is distinct from k.amount then 'amount' end,
                             case when t.is_fraud is distinct from k.is_fraud then 'is_fraud' end) as changed
      from t join kept k on t.id = k.id)
    select * from d where changed <> ''""",
)
def changed_fields(spark, sf_dir):
    base = _base(spark, sf_dir)
    updates, deletes, _ = _batch(spark, sf_dir)
    edited = versions.changed_rows(base, updates, deletes, FIELDS)
    changed = versions.changed_fields(base, edited, "id", FIELDS)
    return changed.select("id", F.concat_ws(",", "changed").alias("changed"))


def _snapshots(spark, sf_dir):
    """Publish the raw rows, correct them, then roll back to the first version."""
    store = versions.Snapshots(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}")
    store.publish(_base(spark, sf_dir), "ingest")
    store.correct(0, *_batch(spark, sf_dir), FIELDS, user="analyst")
    store.roll_back(1, user="analyst")
    return store


@query("rollback_rows", f"with {_TX} select * from t")
def rollback_rows(spark, sf_dir):
    return _snapshots(spark, sf_dir).read()


@query("read_as_of", f"with {_BATCH} select * from after_")
def read_as_of(spark, sf_dir):
    return _snapshots(spark, sf_dir).read(2)


@query(
    "version_manifest",
    f"""with {_BATCH}, n as (select (select count(*) from t) as before_, (select count(*) from after_) as after_n,
      (select count(*) from creates) + (select count(*) from updates where id not in (select id from deletes)) + (select count(distinct id) from deletes) as changed)
    select 1 as version, 1 as snapshot, 0 as epoch, 'ingest' as kind, null::bigint as rows_changed, before_ as rows_total from n
    union all select 2, 2, 1, 'dashboard_edit', changed, after_n from n
    union all select 3, 1, 2, 'rollback', null, before_ from n""",
)
def version_manifest(spark, sf_dir):
    return _snapshots(spark, sf_dir).manifest().select("version", "snapshot", "epoch", "kind", "rows_changed", "rows_total")


def _history(spark, sf_dir):
    """Commit log from orders; recorded metadata from order lines."""
    orders, item = st.table(spark, sf_dir, "orders"), st.table(spark, sf_dir, "lineitem")
    sha = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    rows = (F.col("o_orderkey") % 900 + 1).cast("string")
    subject = F.when(
        F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("manual commit "), F.col("o_orderstatus"))
    ).otherwise(F.concat(F.lit("data: +"), rows, F.lit(" transactions (ingest)")))
    commits = orders.select(
        sha.alias("commit_sha"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
        F.concat(F.lit("author-"), F.col("o_custkey").cast("string")).alias("author"),
        subject.alias("subject"),
    )
    recorded = item.select(
        F.md5(F.col("l_orderkey").cast("string").cast("binary")).alias("commit_sha"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("user-"), F.col("l_suppkey").cast("string"))).alias("user"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")).alias("rows_changed"),
        F.col("l_partkey").alias("rows_total"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("edit "), F.col("l_linenumber").cast("string")))
        .otherwise(F.lit(""))
        .alias("summary"),
        F.col("l_returnflag").alias("kind"),
    )
    return commits, recorded


_HISTORY = """commits as (
  select md5(cast(o_orderkey as varchar)) as commit_sha, strftime(o_orderdate, '%Y-%m-%d') as timestamp, 'author-' || o_custkey as author,
         case when o_orderpriority = '5-LOW' then 'manual commit ' || o_orderstatus
              else 'data: +' || (o_orderkey % 900 + 1) || ' transactions (ingest)' end as subject
  from orders),
recorded as (
  select md5(cast(l_orderkey as varchar)) as commit_sha, case when l_returnflag = 'A' then 'user-' || l_suppkey end as user_,
         case when l_quantity > 25 then l_quantity::bigint end as rows_changed, l_partkey as rows_total,
         case when l_linestatus = 'O' then 'edit ' || l_linenumber else '' end as summary, l_returnflag as kind
  from lineitem
  qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) = 1),
listed as (
  select c.commit_sha, c.timestamp, c.author, r.user_ as "user",
         coalesce(r.rows_changed, nullif(regexp_extract(subject, 'data: \\+(\\d+) transactions', 1), '')::bigint) as rows_changed,
         r.rows_total, coalesce(nullif(r.summary, ''), c.subject) as summary, r.kind
  from commits c left join recorded r on r.commit_sha = c.commit_sha)"""


@query("version_list", f"with {_HISTORY} select * from listed")
def version_list(spark, sf_dir):
    return versions.version_list(*_history(spark, sf_dir), "pos")


@query("known_version", f"with {_HISTORY} select * from listed where starts_with(commit_sha, 'c4ca423')")
def known_version(spark, sf_dir):
    return versions.known_version(versions.version_list(*_history(spark, sf_dir), "pos"), "c4ca423")


# ---- registry: one training run per model and load, evaluated on the scored rows -------------------------------------


def _runs(spark, sf_dir):
    scored = st.scored_rows(spark, sf_dir).withColumn(
        "model", F.concat(F.lit("model-"), F.floor(F.col("user_id") / F.lit(20)).cast("string"))
    )
    metrics = evaluation.metrics(scored, groups=["model", "load_id"])
    floats = ["pr_auc", "roc_auc", "f1", "precision", "recall"]
    return metrics.select(
        F.concat_ws(":", "model", "load_id").alias("run_id"),
        "model",
        F.unix_date(F.to_date(F.substring("load_id", 6, 10))).alias("version"),
        *[C.rounded(F.col(c), 9).alias(c) for c in floats],
        "threshold",
        "true_positives",
        "false_positives",
    )


_RUNS = f"""{Q.SCORED}, named as (select *, 'model-' || (user_id // 20) as model from scored),
grouped as (
  select model, load_id, score, sum(case when label = 1 then 1 else 0 end)::bigint as pos,
         sum(case when label = 1 then 0 else 1 end)::bigint as neg from named group by 1, 2, 3),
pts as (
  select *, (sum(pos) over w)::bigint as tp, (sum(neg) over w)::bigint as fp,
         (sum(pos) over (partition by model, load_id))::bigint as total_pos, (sum(neg) over (partition by model, load_id))::bigint as total_neg
  from grouped window w as (partition by model, load_id order by score desc)),
rated as (
  select *, tp::double / (tp + fp) as p, case when total_pos > 0 then tp::double / total_pos else 1.0 end as r from pts),
pointed as (select *, 2 * p * r / (p + r + 1e-12) as f from rated),
areas as (
  select model, load_id, coalesce({Q.rounded('sum(case when total_pos > 0 then pos::double / total_pos * p end)', 9)}, 0) as pr_auc,
         {Q.rounded('sum(neg::double * (tp - pos + tp)::double / 2) / nullif(max(total_pos::double * total_neg::double), 0)', 9)} as roc_auc
  from rated group by 1, 2),
best as (select * from pointed qualify row_number() over (partition by model, load_id order by f desc, score) = 1),
runs as (
  select a.model || ':' || a.load_id as run_id, a.model, (cast(substr(a.load_id, 6) as date) - date '1970-01-01')::integer as version,
         pr_auc, roc_auc, {Q.rounded('(2 * tp)::double / (2 * tp + fp + total_pos - tp)', 9)} as f1,
         {Q.rounded('tp::double / (tp + fp)', 9)} as precision,
         coalesce({Q.rounded('tp::double / nullif(total_pos, 0)', 9)}, 0) as recall, score as threshold, tp as true_positives, fp as false_positives
  from areas a join best b on a.model = b.model and a.load_id = b.load_id)"""

_STAGED = f"""{_RUNS}, gated as (
  select *, max(pr_auc) over (partition by model order by version rows between unbounded preceding and 1 preceding) as production_metric from runs),
decided as (select *, production_metric is null or pr_auc > production_metric as promoted from gated),
staged as (
  select *, case when version = max(case when promoted then version end) over (partition by model) then 'Production'
                 when promoted then 'Archived' else 'Staging' end as stage from decided)"""


@query("model_runs", f"with {_RUNS} select * from runs")
def model_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(
    "promotion_decision",
    f"with {_STAGED} select model, version, pr_auc, production_metric, promoted, stage from staged",
)
def promotion_decision(spark, sf_dir):
    staged = registry.stages(registry.gate_replay(_runs(spark, sf_dir)))
    return staged.select("model", "version", "pr_auc", "production_metric", "promoted", "stage")


@query(
    "version_metrics",
    f"with {_STAGED} select s.run_id, s.model, s.version, s.stage, r.pr_auc, r.f1 from staged s join runs r on r.run_id = s.run_id",
)
def version_metrics(spark, sf_dir):
    """Registered versions with the metrics of their runs."""
    runs = _runs(spark, sf_dir)
    versions_ = registry.stages(registry.gate_replay(runs)).select("run_id", "model", "version", "stage")
    return registry.with_run_metrics(versions_, runs.select("run_id", "pr_auc", "f1"))


@query(
    "latest_per_stage",
    f"with {_STAGED} select model, stage, run_id, version, pr_auc from staged "
    "qualify row_number() over (partition by model, stage order by version desc) = 1",
)
def latest_per_stage(spark, sf_dir):
    staged = registry.stages(registry.gate_replay(_runs(spark, sf_dir)))
    return registry.latest_per_stage(staged).select("model", "stage", "run_id", "version", "pr_auc")


@query(
    "model_compare",
    f"""with {_STAGED}, latest as (select * from staged qualify row_number() over (partition by model, stage order by version desc) = 1),
    models as (select distinct model from staged)
    select m.model, c.version as candidate_version, p.version as production_version, """
    + ", ".join(f"{Q.rounded(f'c.{k} - p.{k}', 9)} as delta_{k}" for k in S.METRIC_KEYS)
    + """ from models m left join latest c on c.model = m.model and c.stage = 'Staging'
    left join latest p on p.model = m.model and p.stage = 'Production'""",
)
def model_compare(spark, sf_dir):
    compared = registry.compare(registry.stages(registry.gate_replay(_runs(spark, sf_dir))))
    return compared.withColumns({f"delta_{k}": C.rounded(F.col(f"delta_{k}"), 9) for k in S.METRIC_KEYS})


@query(
    "best_run",
    f"with {_RUNS} select model, run_id, pr_auc from runs qualify row_number() over (partition by model order by pr_auc desc, run_id) = 1",
)
def best_run(spark, sf_dir):
    return registry.best_run(_runs(spark, sf_dir), groups=["model"]).select("model", "run_id", "pr_auc")
