"""Admission rule for inbound rows, labelled (ingestion) or not (scoring)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from txquality import schema as S


def _missing(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(F.col(name))


def rules(label: str | None = "is_fraud") -> dict[str, Column]:
    """Conditions that break the admission rule. NaN counts as missing, which is stricter than NULL alone."""
    broken = {
        "time_missing": _missing("time"),
        "time_negative": F.col("time") < 0,
        "amount_missing": _missing("amount"),
        "amount_negative": F.col("amount") < 0,
        "component_missing": F.coalesce(*[F.when(_missing(v), F.lit(True)) for v in S.V_COLUMNS], F.lit(False)),
    }
    if label:
        broken["label_missing"] = F.col(label).isNull()
        broken["label_out_of_domain"] = ~F.col(label).isin(0, 1)
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in broken.items()}


def valid(label: str | None = "is_fraud") -> Column:
    return ~reduce(lambda a, b: a | b, rules(label).values())


def judged(df: DataFrame, label: str | None = "is_fraud") -> DataFrame:
    """Add ``is_valid`` and ``reasons``, the array of broken rules. Rules are evaluated once, in generated code."""
    flags = rules(label)
    marked = df.withColumns({f"_broken_{name}": rule for name, rule in flags.items()})
    names = F.array(*[F.when(F.col(f"_broken_{name}"), F.lit(name)) for name in flags])
    any_broken = reduce(lambda a, b: a | b, [F.col(f"_broken_{name}") for name in flags])
    return marked.withColumns({"reasons": F.array_compact(names), "is_valid": ~any_broken}).drop(
        *[f"_broken_{name}" for name in flags]
    )


def batch_verdict(df: DataFrame, batch_keys: list[str], label: str | None = "is_fraud") -> DataFrame:
    """All-or-nothing: one bad row refuses its batch."""
    bad = F.count_if(~valid(label))
    return (
        df.groupBy(*batch_keys)
        .agg(F.count(F.lit(1)).alias("row_count"), bad.alias("bad_rows"), (bad == 0).alias("accepted"))
    )


def reason_counts(df: DataFrame, label: str | None = "is_fraud") -> DataFrame:
    counts = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules(label).items()])
    rows = F.array(
        *[F.struct(F.lit(name).alias("reason"), F.col(name).alias("row_count")) for name in rules(label)]
    )
    return counts.select(F.inline(rows)).filter("row_count > 0")
