"""Drift of recent rows against a reference: modes, index per feature, summary, history and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from txquality import schema as S
from txquality.functions import columns as C
from txquality.operators import psi, ranks, sequences
from txquality.sources import files


def drift_features(df: DataFrame) -> DataFrame:
    """time_seconds, amount and the derived features; other columns are kept."""
    return df.withColumns(
        {"log_amount": C.log_amount(F.col("amount")), "hour_of_day": C.hour_of_day(F.col("time_seconds"))}
    )


@dataclass
class Sides:
    """Rows marked ``is_recent``, the mode that split them and the cut between the sides."""

    mode: str
    cut: float | None
    rows: DataFrame

    @property
    def reference(self) -> DataFrame:
        return self.rows.filter(~F.col("is_recent"))


def split_sides(df: DataFrame, new_data_after: float | None = None) -> Sides:
    """Halves at the median time, or old against new rows when ``new_data_after`` is given.

    The mode is the caller's choice at every size; results carry ``recent_rows``, from which to judge a thin new side.
    """
    time = F.col("time_seconds")
    if new_data_after is not None:
        return Sides("new_data", new_data_after, df.withColumn("is_recent", time > new_data_after))
    median = ranks.exact_quantiles(df, ["time_seconds"], [0.5])["time_seconds"]
    cut = median[0] if median else None
    return Sides("halves", cut, df.withColumn("is_recent", time >= F.lit(cut).cast("double")))


def index_by_feature(sides: Sides, edges: psi.Edges, features: list[str]) -> DataFrame:
    """(feature, psi, level, verdict, reference_rows, recent_rows); a feature too uniform to be cut has index zero."""
    usable = {c: edges[c] for c in features if edges.get(c)}
    if not usable:
        sizes = sides.rows.agg(
            F.count_if(~F.col("is_recent")).alias("reference_rows"), F.count_if(F.col("is_recent")).alias("recent_rows")
        )
        names = F.explode(F.array(*[F.lit(c) for c in features])).alias("feature")
        return psi.with_level(sizes.select(names, F.lit(0.0).alias("psi"), "reference_rows", "recent_rows"))
    indexes = psi.psi_of(psi.two_sided(sides.rows, usable), ["feature", "reference_rows", "recent_rows"])
    if len(usable) == len(features):
        return psi.with_level(indexes)
    sizes = indexes.agg(F.max("reference_rows").alias("reference_rows"), F.max("recent_rows").alias("recent_rows"))
    names = F.explode(F.array(*[F.lit(c) for c in features if c not in usable])).alias("feature")
    flat = sizes.select(names, F.lit(0.0).alias("psi"), "reference_rows", "recent_rows")
    return psi.with_level(indexes.unionByName(flat))


def drift_by_feature(
    df: DataFrame, new_data_after: float | None = None, features: list[str] | None = None
) -> DataFrame:
    features = features or S.MONITORED
    sides = split_sides(drift_features(df), new_data_after)
    edges = psi.bin_edges(sides.reference, features)
    return index_by_feature(sides, edges, features).withColumn("mode", F.lit(sides.mode))


def distribution(df: DataFrame, new_data_after: float | None = None, features: list[str] | None = None) -> DataFrame:
    """Shares of both sides per bin, for charts: (feature, bin, bucket, reference, recent)."""
    features = features or S.MONITORED
    sides = split_sides(drift_features(df), new_data_after)
    edges = psi.bin_edges(sides.reference, features)
    usable = {c: edges[c] for c in features if edges.get(c)}
    bins = psi.bin_table(df, usable)
    if not usable:
        return bins.withColumns({"reference": F.lit(0.0), "recent": F.lit(0.0)})
    shares = psi.two_sided(sides.rows, usable).select("feature", "bin", "reference", "recent")
    return bins.join(shares, ["feature", "bin"], "left").fillna(0.0, ["reference", "recent"])


def summary(
    df: DataFrame, new_data_after: float | None = None, psi_threshold: float = S.PSI_HIGH
) -> DataFrame:
    """One row: mode, side sizes, highest index, threshold, alert and the index per feature."""
    return summarised(drift_by_feature(df, new_data_after, S.MONITORED), psi_threshold)


def summarised(indexes: DataFrame, psi_threshold: float = S.PSI_HIGH) -> DataFrame:
    per_feature = [F.max(F.when(F.col("feature") == c, F.col("psi"))).alias(f"psi_{c}") for c in S.MONITORED]
    return indexes.agg(
        F.first("mode").alias("mode"),
        F.max("reference_rows").alias("reference_rows"),
        F.max("recent_rows").alias("recent_rows"),
        F.max("psi").alias("max_psi"),
        F.lit(psi_threshold).alias("psi_threshold"),
        (F.max("psi") >= psi_threshold).alias("alert"),
        *per_feature,
    )


def live_drift(df: DataFrame, live: DataFrame) -> DataFrame:
    """Index of logged amounts against the reference half, with the number of logged rows."""
    sides = split_sides(drift_features(df))
    reference = sides.reference.select("amount")
    edges = psi.bin_edges(reference, ["amount"])
    both = reference.withColumn("is_recent", F.lit(False)).unionByName(
        live.select("amount").withColumn("is_recent", F.lit(True))
    )
    return index_by_feature(Sides("live", sides.cut, both), edges, ["amount"])


def drift_by_group(df: DataFrame, groups: list[str]) -> DataFrame:
    """Highest index per group of rows (e.g. per load) against the reference half: (groups, max_psi, psi_<feature>)."""
    rows = drift_features(df)
    sides = split_sides(rows)
    edges = psi.bin_edges(sides.reference, S.MONITORED)
    table = psi.compared(sides.reference, rows, edges, groups)
    indexes = psi.psi_of(table, [*groups, "feature"])
    per_feature = [F.max(F.when(F.col("feature") == c, F.col("psi"))).alias(f"psi_{c}") for c in S.MONITORED]
    return indexes.groupBy(*groups).agg(F.max("psi").alias("max_psi"), *per_feature)


def history(checks: DataFrame, fingerprint: str, pos: str) -> DataFrame:
    """Keep a check only when the dataset changed since the check before it in the log."""
    return sequences.changes_only(checks, fingerprint, pos)


def record_check(summary_df: DataFrame, fingerprint: str, source: str, path: str) -> bool:
    """Append a check to the history unless the newest record is of the same dataset version; tells whether it did."""
    spark = summary_df.sparkSession
    log = files.read_or_empty(spark, "json", path, S.DRIFT_SCHEMA)
    last = log.agg(F.max_by("fingerprint", "timestamp")).first()[0]
    if last == fingerprint:
        return False
    psi_map = F.map_from_arrays(
        F.array(*[F.lit(c) for c in S.MONITORED]), F.array(*[F.col(f"psi_{c}") for c in S.MONITORED])
    )
    record = summary_df.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"),
        F.lit(source).alias("source"),
        F.lit(fingerprint).alias("fingerprint"),
        "mode",
        "recent_rows",
        "max_psi",
        psi_map.alias("psi"),
    )
    files.append_jsonl(record, path)
    return True


def retrain_rule(max_psi: Column, psi_threshold: float = S.PSI_HIGH, enabled: bool = False, busy: Column | None = None) -> Column:
    busy = F.lit(False) if busy is None else busy
    return F.lit(enabled) & (max_psi >= F.lit(psi_threshold)) & ~busy


def report_lines(indexes: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Drift report as numbered text lines; every input has a few rows."""
    head = summarised(indexes).select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("line_no"), F.lit("# Drift report").alias("line")),
                F.struct(F.lit(1).alias("line_no"), F.lit("").alias("line")),
                F.struct(
                    F.lit(2).alias("line_no"),
                    F.format_string(
                        "Mode %s: %d reference rows, %d recent rows.", "mode", "reference_rows", "recent_rows"
                    ).alias("line"),
                ),
                F.struct(F.lit(3).alias("line_no"), F.lit("").alias("line")),
                F.struct(F.lit(4).alias("line_no"), F.lit("| Column | PSI | Verdict |").alias("line")),
                F.struct(F.lit(5).alias("line_no"), F.lit("|---|---|---|").alias("line")),
            )
        )
    )
    order = F.array_position(F.array(*[F.lit(c) for c in S.MONITORED]), F.col("feature")).cast("int")
    body = indexes.select(
        (order + 5).alias("line_no"), F.format_string("| %s | %.4f | %s |", "feature", "psi", "verdict").alias("line")
    )
    lines = head.unionByName(body)
    if live is not None:
        lines = lines.unionByName(
            live.select(
                F.lit(9).alias("line_no"),
                F.format_string("| amount (live, n=%d) | %.4f | %s |", "recent_rows", "psi", "verdict").alias("line"),
            )
        )
    return lines.orderBy("line_no")
