"""Gate, declared tests, contract check and quality report."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txquality import schema as S


class QualityError(ValueError):
    """A blocking quality rule failed."""


# ---- single tests as queries: a test passes when its query returns no row -------------------------------------------


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys seen more than once. Counts are combined before the shuffle, so a hot key travels once per task."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records")).filter("n_records > 1")


def unexpected_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the list with their row counts; NULL passes."""
    return (
        df.filter(~F.col(column).isin(values))
        .groupBy(F.col(column).alias("value_field"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def _range_broken(column: Column, low, high) -> Column:
    checks = ([column < low] if low is not None else []) + ([column > high] if high is not None else [])
    if not checks:
        raise ValueError("accepted_range needs min_value or max_value")
    return reduce(lambda a, b: a | b, checks)


def out_of_range(df: DataFrame, column: str, min_value=None, max_value=None) -> DataFrame:
    """Rows outside the inclusive range; NULL passes."""
    return df.filter(_range_broken(F.col(column), min_value, max_value))


# ---- gate -----------------------------------------------------------------------------------------------------------


def missing_columns(df: DataFrame) -> list[str]:
    return sorted(set(S.REQUIRED_RAW_COLUMNS) - set(df.columns))


def gate_report(df: DataFrame) -> DataFrame:
    """Gate checks in the order in which they block: (check_no, check_name, failures, row_count, status)."""
    missing = len(missing_columns(df))

    def count_of(name: str, rule) -> Column:
        return F.count_if(rule(F.col(name))) if name in df.columns else F.lit(0).cast("long")

    checks = [
        ("required_columns", F.lit(missing).cast("long")),
        ("null_amount", count_of("amount", lambda c: c.isNull())),
        ("null_class", count_of("class", lambda c: c.isNull())),
        ("class_domain", count_of("class", lambda c: ~c.isin(0, 1))),
        ("negative_amount", count_of("amount", lambda c: c < 0)),
    ]
    counts = df.agg(F.count(F.lit(1)).alias("row_count"), *[expr.alias(name) for name, expr in checks])
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("check_no"), F.lit(name).alias("check_name"), F.col(name).alias("failures"))
            for i, (name, _) in enumerate(checks)
        ]
    )
    return counts.select("row_count", F.inline(rows)).withColumn(
        "status", F.when(F.col("failures") == 0, F.lit("pass")).otherwise(F.lit("fail"))
    )


GATE_MESSAGES = {
    "required_columns": "{failures} required columns are missing",
    "null_amount": "amount is NULL in {failures} of {row_count} rows",
    "null_class": "class is NULL in {failures} of {row_count} rows",
    "class_domain": "class is neither 0 nor 1 in {failures} of {row_count} rows",
    "negative_amount": "amount is below zero in {failures} of {row_count} rows",
}


def enforce_gate(df: DataFrame) -> int:
    """Raise on the first failing row of the gate report, in gate order; return the row count."""
    report = sorted(gate_report(df).collect(), key=lambda r: r["check_no"])  # five rows
    for row in report:
        if row["failures"]:
            names = f": {missing_columns(df)}" if row["check_name"] == "required_columns" else ""
            raise QualityError(GATE_MESSAGES[row["check_name"]].format(**row.asDict()) + names)
    return report[0]["row_count"]


# ---- declared suite -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    model: str
    column: str
    kind: str
    args: dict = field(default_factory=dict, hash=False)

    def broken(self) -> Column:
        col = F.col(self.column)
        if self.kind == "not_null":
            return col.isNull()
        if self.kind == "accepted_values":
            return ~col.isin(self.args["values"])
        if self.kind == "accepted_range":
            return _range_broken(col, self.args.get("min_value"), self.args.get("max_value"))
        if self.kind == "non_negative":
            return col < 0
        raise ValueError(f"unknown check {self.kind}")


def declared_checks() -> list[Check]:
    labels = {"values": [0, 1]}
    return [
        Check("stg_transactions", "transaction_id", "unique"),
        Check("stg_transactions", "transaction_id", "not_null"),
        Check("stg_transactions", "time_seconds", "not_null"),
        Check("stg_transactions", "amount", "not_null"),
        Check("stg_transactions", "is_fraud", "not_null"),
        Check("stg_transactions", "is_fraud", "accepted_values", labels),
        Check("fct_transactions_clean", "transaction_id", "unique"),
        Check("fct_transactions_clean", "transaction_id", "not_null"),
        Check("fct_transactions_clean", "amount", "not_null"),
        Check("fct_transactions_clean", "is_fraud", "not_null"),
        Check("fct_transactions_clean", "is_fraud", "accepted_values", labels),
        Check("fct_transactions_features", "transaction_id", "unique"),
        Check("fct_transactions_features", "transaction_id", "not_null"),
        Check("fct_transactions_features", "hour_of_day", "not_null"),
        Check("fct_transactions_features", "hour_of_day", "accepted_range", {"min_value": 0, "max_value": 23}),
        Check("fct_transactions_features", "amount_bucket", "not_null"),
        Check("fct_transactions_features", "amount_bucket", "accepted_values", {"values": S.BUCKETS}),
        Check("fct_transactions_features", "log_amount", "not_null"),
        Check("fct_transactions_features", "log_amount", "accepted_range", {"min_value": 0}),
        Check("agg_fraud_hourly_summary", "hour_of_day", "unique"),
        Check("agg_fraud_hourly_summary", "hour_of_day", "not_null"),
        Check("agg_fraud_hourly_summary", "fraud_rate", "not_null"),
        Check("fct_transactions_clean", "amount", "non_negative"),
    ]


def run_suite(models: dict[str, DataFrame], checks: list[Check] | None = None) -> DataFrame:
    """(model, column_name, test, failures, status), one row per declared check.

    Row-level checks of a model share one aggregation. All uniqueness checks share one shuffle: keys are tagged with
    their check and counted together, with partial counts before the exchange.
    """
    checks = checks or declared_checks()
    parts: list[DataFrame] = []
    for model, df in models.items():
        row_checks = [c for c in checks if c.model == model and c.kind != "unique"]
        if row_checks:
            counts = df.agg(*[F.count_if(c.broken()).alias(f"c{i}") for i, c in enumerate(row_checks)])
            parts.append(
                counts.select(
                    F.inline(
                        F.array(
                            *[
                                F.struct(
                                    F.lit(c.model).alias("model"),
                                    F.lit(c.column).alias("column_name"),
                                    F.lit(c.kind).alias("test"),
                                    F.col(f"c{i}").alias("failures"),
                                )
                                for i, c in enumerate(row_checks)
                            ]
                        )
                    )
                )
            )
    keyed = [
        models[c.model].select(
            F.lit(c.model).alias("model"), F.lit(c.column).alias("column_name"), F.col(c.column).cast("string").alias("k")
        )
        for c in checks
        if c.kind == "unique"
    ]
    if keyed:
        tagged = reduce(DataFrame.unionByName, keyed)
        counted = tagged.groupBy("model", "column_name", "k").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            counted.groupBy("model", "column_name")
            .agg(F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("failures"))
            .select("model", "column_name", F.lit("unique").alias("test"), "failures")
        )
    return reduce(DataFrame.unionByName, parts).withColumn(
        "status", F.when(F.col("failures") == 0, F.lit("pass")).otherwise(F.lit("fail"))
    )


def roll_up(results: DataFrame) -> DataFrame:
    passed, total = F.count_if(F.col("status") == "pass"), F.count(F.lit(1))
    return results.agg(
        passed.alias("passed"),
        total.alias("total"),
        F.when(total == 0, F.lit("unknown")).otherwise(F.format_string("%d/%d PASS", passed, total)).alias("summary"),
    )


# ---- contract -------------------------------------------------------------------------------------------------------


def contract_check(df: DataFrame) -> DataFrame:
    """(column_name, type_ok, null_rows, duplicate_keys, out_of_domain, ok) for every contract column."""
    types = dict(df.dtypes)
    present = [c for c in S.CONTRACT if c[0] in types]
    aggs = []
    for name, _, _, _, domain, _ in present:
        aggs.append(F.count_if(F.col(name).isNull()).alias(f"{name}__null"))
        aggs.append((F.count_if(~F.expr(domain)) if domain else F.lit(0).cast("long")).alias(f"{name}__dom"))
    counts = df.agg(*aggs)
    rows = []
    for name, kind, nullable, is_unique, _, _ in S.CONTRACT:
        known = name in types
        zero = F.lit(0).cast("long")
        nulls = F.col(f"{name}__null") if known and not nullable else zero
        dup = duplicate_keys(df, name).agg(F.count(F.lit(1))).scalar() if known and is_unique else zero
        dom = F.col(f"{name}__dom") if known else zero
        type_ok = F.lit(types.get(name) == kind)
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                type_ok.alias("type_ok"),
                nulls.alias("null_rows"),
                dup.alias("duplicate_keys"),
                dom.alias("out_of_domain"),
                (type_ok & (nulls + dup + dom == 0)).alias("ok"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def documentation_gaps(df: DataFrame) -> list[str]:
    """Exposed columns without a description in the contract."""
    described = {name for name, *_, text in S.CONTRACT if text}
    return sorted(set(df.columns) - described)


def derived_consistency(feats: DataFrame) -> DataFrame:
    """Rows whose log_amount cannot be recomputed from amount."""
    gap = F.abs(F.col("log_amount") - F.ln(F.col("amount") + 1))
    return feats.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(gap > 1e-9).alias("inconsistent_rows"))


def dimensions(df: DataFrame) -> DataFrame:
    """Eleven quality dimensions as (dimension_no, dimension, violations, status); one scan plus one key count."""
    allowed = F.col("amount_bucket").isin(S.BUCKETS)
    invalid = (
        F.count_if(~F.col("is_fraud").isin(0, 1))
        + F.count_if(F.col("amount") < 0)
        + F.count_if(~F.col("hour_of_day").between(0, 23))
        + F.count_if(~allowed)
    )
    missing = F.count_if(F.col("amount").isNull()) + F.count_if(F.col("is_fraud").isNull())
    missing = missing + F.count_if(F.col("time_seconds").isNull()) + F.count_if(F.col("transaction_id").isNull())
    counts = df.agg(
        missing.alias("completeness"),
        invalid.alias("validity"),
        F.count_if(F.abs(F.col("log_amount") - F.ln(F.col("amount") + 1)) > 1e-9).alias("consistency"),
        F.count_if(F.col("amount") < 0).alias("business_consistency"),
        F.count_if(F.col("load_id").isNull()).alias("traceability"),
        F.count_if(F.col("time_seconds") < 0).alias("uniformity"),
    )
    duplicates = duplicate_keys(df, "transaction_id").agg(F.count(F.lit(1))).scalar()
    names = [
        "completeness",
        "validity",
        "consistency",
        "business_consistency",
        "uniqueness",
        "accuracy",
        "freshness",
        "integrity",
        "traceability",
        "uniformity",
        "documentation",
    ]
    fixed = {"accuracy": "not verifiable", "freshness": "not applicable", "integrity": "not applicable"}
    gaps = len(documentation_gaps(df))
    rows = []
    for i, name in enumerate(names):
        if name in fixed:
            value, status = F.lit(None).cast("long"), F.lit(fixed[name])
        else:
            value = F.lit(gaps).cast("long") if name == "documentation" else F.col(name)
            status = F.when(value == 0, F.lit("pass")).otherwise(F.lit("fail"))
        rows.append(
            F.struct(
                F.lit(i + 1).alias("dimension_no"),
                F.lit(name).alias("dimension"),
                value.alias("violations"),
                status.alias("status"),
            )
        )
    return counts.withColumn("uniqueness", duplicates).select(F.inline(F.array(*rows)))


def suite_models(raw: DataFrame) -> dict[str, DataFrame]:
    from txquality.plans import marts

    stg = marts.staging(raw)
    cleaned = marts.clean(stg)
    feats = marts.features(cleaned)
    return {
        "stg_transactions": stg,
        "fct_transactions_clean": cleaned,
        "fct_transactions_features": feats,
        "agg_fraud_hourly_summary": marts.hourly_summary(feats),
    }


def enforce_suite(spark: SparkSession, models: dict[str, DataFrame]) -> str:
    """Run the declared checks and raise when one fails; returns the roll-up text."""
    results = run_suite(models).collect()
    failed = [f"{r['test']}({r['model']}.{r['column_name']})={r['failures']}" for r in results if r["status"] != "pass"]
    if failed:
        raise QualityError("; ".join(sorted(failed)))
    return f"{len(results)}/{len(results)} PASS"
