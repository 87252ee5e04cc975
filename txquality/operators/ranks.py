"""Exact ranks, running totals and quantiles without a global window.

A window ordered over a whole table runs in one task. These operators order rows inside bounded buckets only and add
an offset per bucket. Values are cut at doubles that lie evenly in the order of their 64-bit forms, so every round of
counting fixes some more bits and a few rounds reach single values, whatever the distribution.
"""

from __future__ import annotations

import math
import struct

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 1_000_000
CELLS = 1024  # per column and round; they are handed over to the JVM one by one


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return max(1, math.ceil(rows / bucket_rows))


def _place(value: float) -> int:
    """Whole number in the order of doubles; both zeros are 0."""
    bits = struct.unpack("<q", struct.pack("<d", value))[0]
    return bits if bits >= 0 else -(bits & 0x7FFF_FFFF_FFFF_FFFF)


def _double(place: int) -> float:
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(place)))[0], 1 if place >= 0 else -1)


def _splits(low: float, high: float) -> bool:
    """Whether a cut lies between the two: not between the largest finite double and infinity."""
    return low < min(high, _double(_place(math.inf) - 1))


def _cuts(low: float, high: float, cells: int) -> list[float]:
    """Lower bounds of at most ``cells`` cells of the closed interval, evenly spaced in the order of doubles."""
    first, last = _place(low), _place(high)
    return [_double(p) for p in range(first, last + 1, max(1, -(-(last + 1 - first) // cells)))]


def _cell_counts(df: DataFrame, intervals: dict[str, list[tuple[float, float]]], cells: int) -> dict:
    """Rows per cell of closed, disjoint value intervals: {(column, interval): [(n, min, max), ...]}.

    One scan for all columns. Counts are combined before the shuffle and at most ``cells`` rows per interval come back,
    each with the smallest and largest value seen, so later bounds are real values and no rounding is involved.
    """
    splits, owners = [], {}
    for name, spans in intervals.items():
        bounds: list[tuple[float, int]] = [(-math.inf, -1)]
        for i, (low, high) in sorted(enumerate(spans), key=lambda s: s[1]):
            bounds += [(cut, i) for cut in _cuts(low, high, max(16, cells // len(spans)))]
            if high < math.inf:
                bounds.append((math.nextafter(high, math.inf), -1))
        # A span that starts where another ends takes the cut over. Infinity lies in the cell of the largest finite cut.
        merged = {cut: i for cut, i in bounds if cut < math.inf}
        ordered = sorted(merged)
        splits.append([*ordered, math.inf])
        owners[name] = [merged[cut] for cut in ordered]
    names = list(intervals)
    values = df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in names])
    numbered = Bucketizer(
        splitsArray=splits, inputCols=names, outputCols=[f"_cell_{c}" for c in names], handleInvalid="keep"
    ).transform(values.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names]))
    parts = [
        F.struct(F.lit(c).alias("feature"), F.col(f"_cell_{c}").cast("int").alias("cell"), F.col(c).alias("v")) for c in names
    ]
    counted = (
        numbered.select(F.inline(F.array(*parts)))
        .filter(F.col("v").isNotNull())
        .groupBy("feature", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    found: dict = {}
    for row in sorted(counted.collect(), key=lambda r: (r["feature"], r["cell"])):
        span = owners[row["feature"]][row["cell"]]
        if span >= 0:
            found.setdefault((row["feature"], span), []).append((row["n"], row["low"], row["high"]))
    return found


def balanced_cuts(df: DataFrame, key: str, buckets: int) -> list[float]:
    """Cut points that leave about equally many rows between them; cells with too many rows are looked at again."""
    value = F.nanvl(F.col(key).cast("double"), F.lit(None).cast("double"))
    keyed = df.select(value.alias(key))
    span = keyed.agg(F.min(key), F.max(key), F.count(key)).first()
    if not span[2] or span[0] == span[1]:
        return []
    target = span[2] / buckets
    cells = _cell_counts(keyed, {key: [(span[0], span[1])]}, CELLS)[(key, 0)]
    while heavy := [(low, high) for n, low, high in cells if n > 2 * target and _splits(low, high)]:
        finer = _cell_counts(keyed, {key: heavy}, CELLS)
        cells = sorted(
            [c for c in cells if (c[1], c[2]) not in heavy] + [c for part in finer.values() for c in part],
            key=lambda c: c[1],
        )
    cuts, filled = [], 0
    for n, low, _ in cells:
        if filled and filled + n > target:
            cuts.append(low)
            filled = 0
        filled += n
    return cuts


def with_key_buckets(df: DataFrame, key: str, buckets: int, name: str = "_bucket") -> DataFrame:
    """Number rows by the interval of ``key`` they fall in; intervals hold about equally many rows.

    NaN is in the highest bucket. A NULL key has a NULL bucket, which comes last in both directions.
    """
    cuts = balanced_cuts(df, key, buckets) if buckets > 1 else []
    value = F.col(key).cast("double")
    if not cuts:
        return df.withColumn(name, F.when(value.isNotNull(), F.lit(0)))
    filled = df.withColumn("_key", F.when(F.isnan(value), F.lit(math.inf)).otherwise(value + F.lit(0.0)))
    bucketizer = Bucketizer(splits=[-math.inf, *[c for c in cuts if math.isfinite(c)], math.inf], inputCol="_key", outputCol=name, handleInvalid="keep")
    return bucketizer.transform(filled).withColumn(name, F.when(F.col(key).isNotNull(), F.col(name).cast("int"))).drop("_key")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns in which NULL equals NULL; on the right they carry an underscore before."""
    together = F.lit(True)
    for name in names:
        together = together & left[name].eqNullSafe(right[f"_{name}"])
    return together


def running_totals(
    df: DataFrame,
    key: str,
    measures: list[str],
    groups: list[str] | None = None,
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running totals of ``measures`` over ``key`` (and their totals), one row per group and key.

    Rows with the same key are first added up (combined before the shuffle), so ties share one value. A NULL group is a
    group; a NULL key comes last, and NaN counts as the largest key. Result columns: groups, key, the measures,
    ``cum_<m>`` and ``total_<m>``.
    """
    groups = groups or []
    keyed = df.groupBy(*groups, key).agg(*[F.sum(m).alias(m) for m in measures])
    if buckets is None:
        keyed = keyed.persist()
        buckets = bucket_count(keyed.count())
    summed = with_key_buckets(keyed, key, buckets)

    def ordered(name: str) -> Column:
        return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()

    inner = Window.partitionBy(*groups, "_bucket").orderBy(ordered(key)).rowsBetween(Window.unboundedPreceding, 0)
    totals = summed.groupBy(*groups, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    before = Window.partitionBy(*groups).orderBy(ordered("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    all_buckets = Window.partitionBy(*groups)
    offsets = totals.select(
        *[F.col(g).alias(f"_{g}") for g in groups],
        F.col("_bucket").alias("__bucket"),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(all_buckets).alias(f"total_{m}") for m in measures],
    )
    return summed.join(offsets, _same(summed, offsets, [*groups, "_bucket"])).select(
        *groups,
        key,
        *measures,
        *[(F.sum(m).over(inner) + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def dense_index(df: DataFrame, key: str, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Dense 0-based number in the order of a unique, non-negative integer key that is itself nearly dense.

    The key range is cut into intervals of ``bucket_rows`` keys, so buckets are even and their offsets few.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(key) / F.lit(bucket_rows)).cast("long"))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_bucket").orderBy(key)
    return (
        bucketed.join(offsets, "_bucket").withColumn(name, F.row_number().over(inner) - 1 + F.col("_off")).drop("_bucket", "_off")
    )


def close_gaps(
    kept: DataFrame, gone: DataFrame, key: str, name: str, rows: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Dense number for the rows left of ids 0..rows-1 after the distinct ids in ``gone`` were taken out.

    Offsets need only the removed ids: a bucket starts at its first id less the ids removed before it.
    """
    width = max(bucket_rows, 1)
    bucket = F.floor(F.col(key) / F.lit(width)).cast("long")
    spark = kept.sparkSession
    removed = gone.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    every = spark.range(math.ceil(rows / width)).select(F.col("id").alias("_bucket"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = every.join(removed, "_bucket", "left").select(
        "_bucket",
        (F.col("_bucket") * F.lit(width) - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_off"),
    )
    inner = Window.partitionBy("_bucket").orderBy(key)
    return (
        kept.withColumn("_bucket", bucket)
        .join(offsets, "_bucket")
        .withColumn(name, F.row_number().over(inner) - 1 + F.col("_off"))
        .drop("_bucket", "_off")
    )


def smallest_per_class(
    df: DataFrame, class_col: str, hash_col: str, id_col: str, sizes: dict, hash_bits: int = 32, bits_a_round: int = 16
) -> Column:
    """Condition that holds for exactly the ``sizes[c]`` rows of class ``c`` with the smallest (hash, id).

    Counts per class and hash prefix find the one prefix in which a class reaches its size, some bits more in every round, until
    the whole hash is known; only rows that share that hash are ordered. Each class then needs one limit pair, and
    choosing rows is a comparison without a shuffle.
    """
    rows = df.select(F.col(class_col).alias("_c"), F.col(hash_col).alias("_h"), F.col(id_col).alias("_i"))
    take = {c: n for c, n in sizes.items() if n > 0}
    prefix: dict = {}
    known = 0
    while take and known < hash_bits:
        shift = max(0, hash_bits - known - bits_a_round)
        inside = F.lit(False)
        for c in take:
            own = F.col("_c") == F.lit(c)
            inside = inside | (own & (F.shiftright("_h", hash_bits - known) == prefix[c]) if known else own)
        counts = rows.filter(inside).groupBy("_c", F.shiftright("_h", shift).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        reached = F.sum("_n").over(Window.partitionBy("_c").orderBy("_b"))
        wanted = F.lit(None).cast("long")
        for c, n in take.items():
            wanted = F.when(F.col("_c") == F.lit(c), F.lit(n).cast("long")).otherwise(wanted)
        edge = counts.select("_c", "_b", reached.alias("_cum"), "_n")
        edge = edge.filter((F.col("_cum") >= wanted) & (F.col("_cum") - F.col("_n") < wanted))
        found = edge.select("_c", "_b", (wanted - (F.col("_cum") - F.col("_n"))).alias("_take")).collect()  # one row per class
        prefix, take = {r["_c"]: r["_b"] for r in found}, {r["_c"]: r["_take"] for r in found}
        known = hash_bits - shift
    condition = F.lit(False)
    for c, h in prefix.items():
        tied = rows.filter((F.col("_c") == F.lit(c)) & (F.col("_h") == F.lit(h))).select("_i").orderBy("_i").limit(take[c])
        last = tied.agg(F.max("_i")).first()[0]
        below = (F.col(hash_col) < h) | ((F.col(hash_col) == h) & (F.col(id_col) <= last))
        condition = condition | ((F.col(class_col) == F.lit(c)) & below)
    return condition


def quantile_ranks(n: int, p: float) -> tuple[int, int, float]:
    """Lower rank, upper rank (0-based) and weight of the linear quantile."""
    position = (n - 1) * p
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def lerp(a: float, b: float, t: float) -> float:
    """Linear interpolation that starts from the nearer end, as numerical libraries do."""
    if a == b:
        return a
    return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], order_rows: int = BUCKET_ROWS
) -> dict[str, list[float]]:
    """Exact linear quantiles of several columns; only counts and the quantiles reach the driver.

    A column is narrowed down to the cells that hold the wanted ranks by counting rows per cell, for as many rounds as it
    takes until the cells with more than one value hold ``order_rows`` rows at most; the distinct values of these are then
    ordered. A value that very many rows share needs no ordering. NULL and NaN have no rank; infinities have.
    """
    df = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    facts = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[F.max(c).alias(f"hi_{c}") for c in columns],
    ).first()
    sizes = {c: facts[f"n_{c}"] for c in columns}
    ranks = {c: sorted({r for p in probabilities for r in quantile_ranks(sizes[c], p)[:2]}) for c in columns if sizes[c]}
    # Spans per column: (low, high, rows below, rows inside), the parts of the column that hold wanted ranks.
    spans = {c: [(facts[f"lo_{c}"], facts[f"hi_{c}"], 0, sizes[c])] for c in ranks}

    def open_parts() -> dict[str, list]:
        """Per column the spans with several values, if they hold too many rows to be ordered."""
        parts = {c: [s for s in own if _splits(s[0], s[1])] for c, own in spans.items()}
        return {c: own for c, own in parts.items() if sum(s[3] for s in own) > order_rows}

    while wide := open_parts():
        counted = _cell_counts(df, {c: [(s[0], s[1]) for s in parts] for c, parts in wide.items()}, CELLS)
        for c, parts in wide.items():
            kept = [s for s in spans[c] if not _splits(*s[:2])]
            for i, (_, _, below, _) in enumerate(parts):
                for n, low, high in counted[(c, i)]:
                    if any(below <= r < below + n for r in ranks[c]):
                        kept.append((low, high, below, n))
                    below += n
            spans[c] = kept
    found = _order_statistics(df, spans, ranks)
    result: dict[str, list[float]] = {c: [] for c in columns}
    for c in ranks:
        for p in probabilities:
            low, high, t = quantile_ranks(sizes[c], p)
            result[c].append(lerp(found[c][low], found[c][high], t))
    return result


def value_at_rank(
    df: DataFrame, column: str, rank: int, descending: bool = False, order_rows: int = BUCKET_ROWS
) -> tuple[float | None, int] | None:
    """Value of the row at the 0-based ``rank`` in the order of a numeric column, and the rows that come before that value.

    Cells are counted until the one that holds the rank has ``order_rows`` rows or a single value; only its distinct values are
    ordered. NaN is the largest value and NULL comes last in both directions; past the last row the result is None. Whole
    numbers beyond 2^53 are compared as doubles.
    """
    value = F.col(column).cast("double")
    number = F.nanvl(value, F.lit(None).cast("double"))
    nan = F.count_if(F.coalesce(F.isnan(value), F.lit(False)))
    rows, nans, n, low, high = df.agg(F.count(F.lit(1)), nan, F.count(number), F.min(number), F.max(number)).first()
    if rank >= rows:
        return None
    if rank >= n + nans:
        return None, n + nans
    ahead = nans if descending else 0
    if not ahead <= rank < ahead + n:
        return math.nan, 0 if descending else n
    wanted = n - 1 - (rank - ahead) if descending else rank
    values, below, inside = df.select(number.alias("v")), 0, n
    while inside > order_rows and _splits(low, high):
        for size, first, last in _cell_counts(values, {"v": [(low, high)]}, CELLS)[("v", 0)]:
            if wanted < below + size:
                low, high, inside = first, last, size
                break
            below += size
    if low != high:
        counts = values.filter((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # the values of one cell
        low, inside, reached = counts.withColumn("cum", upto).filter(F.col("cum") > wanted - below).orderBy("v").first()
        below += reached - inside
    return low, ahead + n - below - inside if descending else below


def _order_statistics(df: DataFrame, spans: dict, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """Values at the wanted ranks, from the rows inside the spans that hold more than one value."""
    found: dict[str, dict[int, float]] = {c: {} for c in spans}
    open_spans: dict[str, list] = {}
    for c, parts in spans.items():
        for low, high, below, n in parts:
            if low == high:
                found[c].update({r: low for r in ranks[c] if below <= r < below + n})
            elif any(below <= r < below + n for r in ranks[c]):
                open_spans.setdefault(c, []).append((low, high, below))
    if not open_spans:
        return found
    parts = []
    for c, bounds in open_spans.items():
        value = F.col(c).cast("double")
        offset = F.lit(None).cast("long")
        for low, high, below in bounds:
            offset = F.when((value >= F.lit(low)) & (value <= F.lit(high)), F.lit(below).cast("long")).otherwise(offset)
        parts.append(F.struct(F.lit(c).alias("feature"), offset.alias("below"), value.alias("value")))
    table = (
        df.select(F.inline(F.array(*parts)))
        .filter(F.col("below").isNotNull())
        .groupBy("feature", "below", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inner = Window.partitionBy("feature", "below").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = table.withColumn("cum", F.sum("n").over(inner) + F.col("below"))
    wanted = F.lit(False)
    for c in open_spans:
        # Wanted ranks r with cum - n <= r < cum: the distinct value that holds the row of that rank.
        at = F.exists(
            F.array(*[F.lit(r).cast("long") for r in ranks[c]]),
            lambda r: (F.col("cum") > r) & (F.col("cum") - F.col("n") <= r),
        )
        wanted = wanted | ((F.col("feature") == c) & at)
    for row in ranked.filter(wanted).select("feature", "value", "n", "cum").collect():  # one row per wanted rank at most
        c = row["feature"]
        found[c].update({r: row["value"] for r in ranks[c] if row["cum"] - row["n"] <= r < row["cum"]})
    return found
