"""Exact stratified split, repeatable from row ids alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from txquality import schema as S
from txquality.functions import columns as C
from txquality.operators import ranks


def class_test_sizes(counts: dict, test_share: float) -> dict:
    """Test rows per class: ceil(n * share) in all, shared out by largest remainder (larger class first on ties)."""
    total = sum(counts.values())
    wanted = math.ceil(total * test_share)
    exact = {c: n * wanted / total for c, n in counts.items()}
    sizes = {c: math.floor(x) for c, x in exact.items()}
    left = wanted - sum(sizes.values())
    for c in sorted(counts, key=lambda c: (-(exact[c] - sizes[c]), -counts[c], c))[:left]:
        sizes[c] += 1
    return sizes


def stratified_split(
    df: DataFrame, label: str, row_id: str, test_share: float = S.TEST_SHARE, seed: int = S.SPLIT_SEED
) -> DataFrame:
    """Add ``fold`` ('train' or 'test'). Sizes are exact per class; no row is moved to decide its fold."""
    hashed = df.withColumn("_hash", C.hash32(seed, F.col(row_id)))
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a few classes
    if not counts:
        return df.withColumn("fold", F.lit("train"))
    chosen = ranks.smallest_per_class(hashed, label, "_hash", row_id, class_test_sizes(counts, test_share))
    return hashed.withColumn("fold", F.when(chosen, F.lit("test")).otherwise(F.lit("train"))).drop("_hash")


def split_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("fold", label).agg(F.count(F.lit(1)).alias("row_count"))


def split_overlap(df: DataFrame, row_id: str) -> DataFrame:
    """Ids found in both folds (none in a sound split)."""
    in_test = F.max(F.when(F.col("fold") == "test", 1).otherwise(0))
    in_train = F.max(F.when(F.col("fold") == "train", 1).otherwise(0))
    return df.groupBy(row_id).agg(in_test.alias("a"), in_train.alias("b")).filter("a = 1 and b = 1").select(row_id)
