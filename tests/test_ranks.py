from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txquality.functions import columns as C
from txquality.operators import psi, ranks, sequences
from txquality.plans import splits


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, some are NULL."""
    rng = np.random.default_rng(1)
    values = np.round(rng.exponential(50, 6000), 2)
    values[:2000] = 10.0
    rows = [(i, float(v) if i % 97 else None, int(i % 3)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, v double, g long").repartition(5).cache()


@pytest.mark.parametrize("buckets", [1, 16])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_a_global_sum(skewed, buckets, descending):
    df = skewed.filter("v is not null").withColumn("n", F.lit(1).cast("long"))
    got = ranks.running_totals(df, "v", ["n"], ["g"], descending, buckets).toPandas()
    pdf = df.toPandas().groupby(["g", "v"], as_index=False)["n"].sum().sort_values("v", ascending=not descending)
    pdf["cum_n"] = pdf.groupby("g")["n"].cumsum()
    merged = got.merge(pdf, on=["g", "v"], suffixes=("", "_want"))
    assert len(merged) == len(got) == len(pdf)
    assert (merged["cum_n"] == merged["cum_n_want"]).all()
    assert (got.groupby("g")["n"].sum() == got.groupby("g")["total_n"].max()).all()


def test_running_totals_without_groups(skewed):
    df = skewed.filter("v is not null").withColumn("n", F.lit(1).cast("long"))
    one = ranks.running_totals(df, "v", ["n"], buckets=1).orderBy("v").collect()
    many = ranks.running_totals(df, "v", ["n"], buckets=9).orderBy("v").collect()
    assert one == many


def test_dense_index_closes_gaps(spark):
    df = spark.range(1000).filter("id % 7 <> 0")
    got = ranks.dense_index(df, "id", "n", bucket_rows=50).orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(len(got)))


@pytest.mark.parametrize("order_rows, cells", [(10**6, 1024), (500, 16), (0, 64)])
def test_exact_quantiles_equal_numpy(skewed, monkeypatch, order_rows, cells):
    """Same numbers whether the column is ordered at once or narrowed down to single values."""
    monkeypatch.setattr(ranks, "CELLS", cells)
    df = skewed.withColumn("w", F.ln(F.col("v") + 1)).withColumn("none", F.lit(None).cast("double"))
    got = ranks.exact_quantiles(df, ["v", "w", "none"], psi.quantile_levels(), order_rows)
    pdf = df.toPandas()
    for c in ("v", "w"):
        assert np.array_equal(got[c], pd.Series(pdf[c]).quantile(np.linspace(0, 1, 11)).values)
    assert got["none"] == []


def test_close_gaps_equals_dense_index(spark):
    gone = spark.range(1000).filter("id % 7 = 0 or id between 200 and 420")
    kept = spark.range(1000).join(gone, "id", "left_anti")
    got = ranks.close_gaps(kept, gone, "id", "n", 1000, bucket_rows=50).orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(len(got)))


def test_quantiles_leave_out_nan_and_bear_infinity(spark):
    values = [float(i) for i in range(40)] + [float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranks.exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 1.0], order_rows=5)
    assert got["v"] == [0.0, 10.0, 20.0, float("inf")]
    assert ranks.running_totals(df.filter("v is not null").withColumn("n", F.lit(1)), "v", ["n"], buckets=4).count() == 42


def test_quantiles_of_values_over_many_magnitudes(spark):
    df = spark.range(4000).select(F.exp((F.col("id") - 2000) / 3.0).alias("v"), (-F.col("id") % 5 * 0.0).alias("zero"))
    got = ranks.exact_quantiles(df, ["v", "zero"], [0.0, 0.3, 0.5, 0.9, 1.0], order_rows=3)
    want = np.sort(df.toPandas()["v"].to_numpy())
    assert got["v"] == [ranks.lerp(want[a], want[b], t) for a, b, t in (ranks.quantile_ranks(4000, p) for p in (0.0, 0.3, 0.5, 0.9, 1.0))]
    assert got["zero"] == [0.0] * 5


@pytest.mark.parametrize("descending", [False, True])
def test_null_groups_null_keys_and_nan_are_kept(spark, descending):
    rows = [(g, v, 1) for g in ("a", None) for v in [None, float("nan"), float("inf"), -1.0, *[float(i % 7) for i in range(20)]]]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    one, four = ({tuple(map(str, r)) for r in ranks.running_totals(df, "v", ["n"], ["g"], descending, b).collect()} for b in (1, 4))
    assert one == four and len(one) == 2 * 11
    last = [r for r in ranks.running_totals(df, "v", ["n"], ["g"], descending, 4).collect() if r["v"] is None]
    assert [(r["cum_n"], r["total_n"]) for r in last] == [(24, 24)] * 2


def test_changes_keep_rows_without_position(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (9, "b"), (None, "c")], "pos long, f string")
    for buckets in (1, 3):
        kept = sequences.changes_only(df, "f", "pos", buckets).collect()
        assert {(r["pos"], r["f"]) for r in kept} == {(1, "a"), (3, "b"), (None, "c")}


def test_cuts_are_balanced_despite_a_hot_value(skewed):
    df = skewed.filter("v is not null")
    cuts = ranks.balanced_cuts(df, "v", 10)
    sizes = ranks.with_key_buckets(df, "v", 10).groupBy("_bucket").count().toPandas()["count"].sort_values()
    assert cuts == sorted(set(cuts)) and 10.0 in cuts
    assert sizes.iloc[-1] < 2100 and sizes.iloc[-2] <= 2 * df.count() / 10


def test_split_is_exact_disjoint_and_repeatable(spark, skewed):
    df = skewed.select("id", (F.col("id") % 50 == 0).cast("long").alias("is_fraud"))
    split = splits.stratified_split(df, "is_fraud", "id")
    counts = {(r["fold"], r["is_fraud"]): r["row_count"] for r in splits.split_counts(split, "is_fraud").collect()}
    assert counts == {("test", 0): 1176, ("train", 0): 4704, ("test", 1): 24, ("train", 1): 96}
    assert splits.split_overlap(split, "id").count() == 0
    again = splits.stratified_split(df.repartition(3), "is_fraud", "id")
    assert split.exceptAll(again).count() == 0


def test_split_equals_a_sort(spark):
    df = spark.range(5000).withColumn("c", (F.col("id") % 4 == 0).cast("long"))
    hashed = df.withColumn("h", C.hash32(42, F.col("id"))).toPandas()
    want = set()
    sizes = splits.class_test_sizes({0: 3750, 1: 1250}, 0.2)
    for c, size in sizes.items():
        want |= set(hashed[hashed.c == c].sort_values(["h", "id"]).head(size)["id"])
    got = splits.stratified_split(df, "c", "id").filter("fold = 'test'").select("id").collect()
    assert {r["id"] for r in got} == want


def test_class_sizes_of_the_known_split():
    sizes = splits.class_test_sizes({0: 284_315, 1: 492}, 0.2)
    assert sum(sizes.values()) == 56_962 and sizes[1] == 98


def test_changes_only_across_buckets(spark):
    rows = [(i, v) for i, v in enumerate("aabbbacc")] + [(30, "c"), (31, None), (50, None), (51, "c")]
    df = spark.createDataFrame(rows, "pos long, f string")
    for buckets in (1, 4):
        kept = sequences.changes_only(df, "f", "pos", buckets).orderBy("pos").collect()
        assert [r["pos"] for r in kept] == [0, 2, 5, 6, 31, 51]


def test_counter_with_reset(spark):
    rows = [("d", i, n) for i, n in enumerate([40, 50, 20, 99, 1, 250])]
    df = spark.createDataFrame(rows, "s string, b long, n long")
    got = sequences.counter_with_reset(df, "s", "b", "n", 100).orderBy("b").collect()
    assert [r["triggered"] for r in got] == [False, False, True, False, True, True]
    assert [r["pending_after"] for r in got] == [40, 90, 0, 99, 0, 0]


def _folded(sizes, threshold):
    pending, out = 0, []
    for n in sizes:
        before, pending = pending, pending + n
        fired = pending >= threshold
        pending = 0 if fired else pending
        out.append((before, pending, fired))
    return out


def test_counter_with_reset_equals_a_fold(spark):
    draw = random.Random(3)
    series = {"a": [draw.choice([0, 0, 1, 7, 40, 250]) for _ in range(300)], None: [0, 0, 5], "c": [1000] * 20, "d": [1] * 64}
    rows = [(s, i, n) for s, sizes in series.items() for i, n in enumerate(sizes)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, b long, n int").repartition(5)
    for threshold, bucket_rows in ((100, 50), (1, 1000), (3, 60), (10_000, 100)):
        got = {}
        for r in sorted(sequences.counter_with_reset(df, "s", "b", "n", threshold, bucket_rows).collect(), key=lambda r: r["b"]):
            got.setdefault(r["s"], []).append((r["pending_before"], r["pending_after"], r["triggered"]))
        assert got == {s: _folded(sizes, threshold) for s, sizes in series.items()}
    assert all(r["triggered"] for r in sequences.counter_with_reset(df, "s", "b", "n", 0).collect())
    assert sequences.counter_with_reset(df.limit(0), "s", "b", "n", 5).collect() == []


def test_islands_across_segments(spark):
    draw = random.Random(5)
    rows = [(s, t, draw.choice([True, True, False, None])) for s in ("x", None) for t in draw.sample(range(0, 500), 120)]
    df = spark.createDataFrame(rows, "s string, t long, hot boolean")
    want, last = {}, {}
    for s, t, hot in sorted(rows, key=lambda r: r[1]):
        last[s] = (last.get(s) if last.get(s) is not None else t) if hot else None
        want[s, t] = last[s]
    for span in (7, 100, 86_400):
        got = sequences.islands(df, ["s"], "t", F.col("hot"), span)
        assert got.columns == ["s", "t", "hot", "active", "active_since"]
        assert {(r["s"], r["t"]): r["active_since"] for r in got.collect()} == want


def test_row_before_across_segments(spark):
    df = spark.createDataFrame([("x", t, v) for t, v in [(1, 5), (9, None), (40, 7), (41, 8)]], "s string, t long, v long")
    for span in (5, 1000):
        got = sequences.row_before(df, ["s"], "t", ["v"], "p", span).orderBy("t").collect()
        assert [r["p"] and r["p"]["v"] for r in got] == [None, 5, None, 7] and got[2]["p"] is not None


def test_value_at_rank(spark):
    draw = random.Random(1)
    values = [draw.choice([0.0, 1.5, -2.0, draw.uniform(-1e6, 1e6), float("inf"), float("nan"), None]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for down in (False, True):
        order = F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_last()
        ordered = [repr(r["v"]) for r in df.orderBy(order).collect()]
        for rank in (0, 57, 200, 333, 399):
            for order_rows in (10, 1000):
                value, before = ranks.value_at_rank(df, "v", rank, down, order_rows)
                assert repr(value) == ordered[rank] and before == ordered.index(ordered[rank])
    assert ranks.value_at_rank(df, "v", 400) is None
