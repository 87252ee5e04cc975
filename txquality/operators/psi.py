"""Population stability index over binned counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from txquality import schema as S
from txquality.functions import columns as C
from txquality.operators import ranks

Edges = dict[str, list[float] | None]


def quantile_levels(bins: int = S.PSI_BINS) -> list[float]:
    """Evenly spaced levels 0..1 with the rounding that data-frame libraries give them: step * i, by way of per cent."""
    return [i * (1.0 / bins) * 100 / 100 for i in range(bins)] + [1.0]


def distinct_quantiles(reference: DataFrame, columns: list[str], bins: int = S.PSI_BINS) -> dict[str, list[float]]:
    quantiles = ranks.exact_quantiles(reference, columns, quantile_levels(bins))
    return {c: sorted(set(v)) for c, v in quantiles.items()}


def bin_edges(reference: DataFrame, columns: list[str], bins: int = S.PSI_BINS) -> Edges:
    """Bin edges per column from the reference, open at both ends; None when it is too uniform to be cut."""
    edges: Edges = {}
    for name, values in distinct_quantiles(reference, columns, bins).items():
        edges[name] = [-math.inf, *values[1:-1], math.inf] if len(values) >= 3 else None
    return edges


def bin_of(column: Column, edges: list[float]) -> Column:
    """Half-open bins, the last one closed; NULL and NaN are in no bin."""
    number = F.lit(len(edges) - 2)
    for i in reversed(range(len(edges) - 2)):
        number = F.when(column < F.lit(edges[i + 1]), F.lit(i)).otherwise(number)
    return F.when(column.isNotNull() & ~F.isnan(column.cast("double")), number)


def binned_counts(df: DataFrame, edges: Edges, groups: list[str]) -> DataFrame:
    """(groups, feature, bin, n) with NULL bins kept, so that n adds up to all rows.

    All features are binned in one pass and counted together; the aggregation state is bounded by the product of the
    bin numbers, and no row is multiplied before it is aggregated.
    """
    usable = {c: e for c, e in edges.items() if e}
    bins = [bin_of(F.col(c), e).alias(f"_bin_{c}") for c, e in usable.items()]
    names = [f"_bin_{c}" for c in usable]
    together = df.select(*groups, *bins).groupBy(*groups, *names).agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_bin_{c}").alias("bin")) for c in usable])
    return together.select(*groups, "n", F.inline(rows)).groupBy(*groups, "feature", "bin").agg(F.sum("n").alias("n"))


def bin_label(edges: list[float], number: int) -> str:
    """Text of a bin; the outer bins are open."""
    place = "first" if number == 0 else "last" if number == len(edges) - 2 else "inner"
    return S.BIN_LABELS[place].format(low=edges[number], high=edges[number + 1])


def bin_table(df: DataFrame, edges: Edges) -> DataFrame:
    """(feature, bin, bucket) for every bin: a few dozen rows."""
    rows = [
        (c, i, bin_label(e, i)) for c, e in edges.items() if e for i in range(len(e) - 1)
    ]
    return df.sparkSession.createDataFrame(rows, "feature string, bin int, bucket string")


def shares(counts: DataFrame, bins: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Share of every bin in its side, zero for empty bins: (groups, feature, bin, bucket, share, side_rows)."""
    groups = groups or []
    totals = counts.groupBy(*groups, "feature").agg(F.sum("n").alias("side_rows"))
    frame = totals.join(F.broadcast(bins), "feature")
    filled = frame.join(counts.filter(F.col("bin").isNotNull()), [*groups, "feature", "bin"], "left")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.greatest(F.col("side_rows"), F.lit(1))
    return filled.select(*groups, "feature", "bin", "bucket", share.alias("share"), "side_rows")


def compared(reference: DataFrame, recent: DataFrame, edges: Edges, groups: list[str] | None = None) -> DataFrame:
    """(groups, feature, bin, bucket, reference, recent) shares of two sides; groups split the recent side."""
    groups = groups or []
    bins = bin_table(reference, edges)
    left = shares(binned_counts(reference, edges, []), bins).select("feature", "bin", F.col("share").alias("reference"))
    right = shares(binned_counts(recent, edges, groups), bins, groups).withColumnRenamed("share", "recent")
    return right.join(F.broadcast(left), ["feature", "bin"])  # as many rows as bins


def two_sided(rows: DataFrame, edges: Edges) -> DataFrame:
    """Counts of both sides per bin in one scan: (feature, bin, reference, recent, reference_rows, recent_rows).

    ``rows`` carries a boolean ``is_recent``. Only bins with rows appear; an empty pair of bins adds nothing to the index.
    """
    bins = [bin_of(F.col(c), e).alias(f"_bin_{c}") for c, e in edges.items()]
    together = rows.select("is_recent", *bins).groupBy("is_recent", *[f"_bin_{c}" for c in edges]).agg(
        F.count(F.lit(1)).alias("n")
    )
    long = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_bin_{c}").alias("bin")) for c in edges])
    sides = together.select("is_recent", "n", F.inline(long)).groupBy("feature", "bin").agg(
        F.sum(F.when(~F.col("is_recent"), F.col("n")).otherwise(0)).alias("n_ref"),
        F.sum(F.when(F.col("is_recent"), F.col("n")).otherwise(0)).alias("n_cur"),
    )
    per_feature = Window.partitionBy("feature")  # a dozen rows each
    return (
        sides.withColumns(
            {"reference_rows": F.sum("n_ref").over(per_feature), "recent_rows": F.sum("n_cur").over(per_feature)}
        )
        .filter(F.col("bin").isNotNull())
        .select(
            "feature",
            "bin",
            (F.col("n_ref") / F.greatest("reference_rows", F.lit(1))).alias("reference"),
            (F.col("n_cur") / F.greatest("recent_rows", F.lit(1))).alias("recent"),
            "reference_rows",
            "recent_rows",
        )
    )


def psi_of(shares_table: DataFrame, keys: list[str]) -> DataFrame:
    """Index per key set from a table with ``reference`` and ``recent`` shares."""
    c = F.greatest(F.col("recent"), F.lit(S.PSI_FLOOR))
    r = F.greatest(F.col("reference"), F.lit(S.PSI_FLOOR))
    return shares_table.groupBy(*keys).agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def with_level(df: DataFrame) -> DataFrame:
    return df.withColumns({"level": C.psi_level(F.col("psi")), "verdict": C.psi_verdict(F.col("psi"))})
