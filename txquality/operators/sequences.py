"""Ordered-state operators: latest record, tails, changes along a log, gaps and islands, counters with reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from txquality.operators import ranks
from txquality.session import checkpointed

DAY = 86_400


def latest_per_key(df: DataFrame, keys: list[str], pos: str, first_name: str | None = None) -> DataFrame:
    """Last record of every key by ``pos``. An aggregate, so a hot key is reduced before the shuffle."""
    others = [pos, *[c for c in df.columns if c not in keys and c != pos]]
    sortable = not any("map<" in dtype for _, dtype in df.dtypes)
    # The maximum of a struct that starts with the position is the cheaper form; maps have no order and need max_by.
    last = F.max(F.struct(*others)) if sortable else F.max_by(F.struct(*others), F.col(pos))
    aggs = [last.alias("_last")]
    if first_name:
        aggs.append(F.min(pos).alias(first_name))
    grouped = df.groupBy(*keys).agg(*aggs)
    return grouped.select(*keys, "_last.*", *([first_name] if first_name else []))


def tail(df: DataFrame, order: str, count: int) -> DataFrame:
    """Last rows of a log in log order; a top-k, not a sort of the log."""
    return df.orderBy(F.col(order).desc()).limit(count).orderBy(order)


def changes_only(df: DataFrame, value: str, pos: str, buckets: int | None = None) -> DataFrame:
    """Rows whose value differs from the row before them in the order of ``pos``, a unique log position.

    Positions are cut into even buckets, whatever the times at which rows arrived. Rows are compared inside buckets; the
    first row of a bucket is compared with the last value of the bucket before it, taken from one row per bucket. Rows
    without a position come last, in no defined order.
    """
    if buckets is None:
        buckets = ranks.bucket_count(df.count())
    marked = ranks.with_key_buckets(df, pos, buckets, "_b")
    boxed = F.struct(F.col(value).alias("v"))
    compared = marked.withColumn("_before", F.lag(boxed).over(Window.partitionBy("_b").orderBy(pos)))
    last = marked.groupBy("_b").agg(F.coalesce(F.max_by(boxed, pos), F.last(boxed)).alias("_last"))
    carried = last.select(F.col("_b").alias("_of"), F.lag("_last").over(Window.orderBy(F.col("_b").asc_nulls_last())).alias("_carry"))
    compared = compared.join(carried, F.col("_b").eqNullSafe(F.col("_of")))
    before = F.coalesce("_before", "_carry")
    changed = before.isNull() | ~F.col(value).eqNullSafe(before["v"])
    return compared.filter(changed).drop("_b", "_of", "_carry", "_before")


def carried_last(
    df: DataFrame, series: list[str], order: list[str], segment: str, value: Column, name: str,
    inclusive: bool = True, descending: bool = False,
) -> DataFrame:
    """Add ``name``: the last ``value`` that is not NULL in a row's series, up to the row or (not ``inclusive``) before it.

    A segmented scan: the column ``segment`` grows with the order and cuts a series into parts. A window looks back inside a part; what
    the parts before it hand on is one row per part. So a task holds one part of a series and never all of it.
    ``order`` must tell the rows of a series apart. A NULL series is a series; NULL order and segment come first.
    """
    back = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inner = Window.partitionBy(*series, segment).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    held = df.withColumn("_held", value)
    place = F.when(F.col("_held").isNotNull(), F.struct(*order))
    end = F.min_by("_held", place) if descending else F.max_by("_held", place)
    ends = held.groupBy(*series, segment).agg(end.alias("_end"))
    of = F.col(segment).desc() if descending else F.col(segment).asc()
    before = Window.partitionBy(*series).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    carry = ends.select(
        *[F.col(c).alias(f"_{c}") for c in (*series, segment)], F.last("_end", ignorenulls=True).over(before).alias("_carry")
    )
    together = F.lit(True)
    for c in (*series, segment):
        together = together & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = held.join(carry, together)
    found = joined.withColumn(name, F.coalesce(F.last("_held", ignorenulls=True).over(inner), F.col("_carry")))
    return found.drop("_held", "_carry", *[f"_{c}" for c in (*series, segment)])


def by_span(df: DataFrame, order: str, span: int) -> DataFrame:
    """Add ``segment``, the number of the interval of ``span`` units that a numeric ``order`` falls in."""
    return df.withColumn("segment", F.floor(F.col(order) / F.lit(span)))


def islands(df: DataFrame, series: list[str], order: str, active: Column, span: int = DAY) -> DataFrame:
    """Add ``active`` and, for active rows, ``active_since``: start of the unbroken run of active samples.

    Series are cut by ``span`` units of the numeric ``order``, seconds by the day, and scanned part by part.
    """
    marked = by_span(df.withColumn("active", F.coalesce(active, F.lit(False))), order, span)
    known = carried_last(marked, series, [order], "segment", F.col("active"), "_before", inclusive=False)
    start = F.when(F.col("active") & ~F.coalesce("_before", F.lit(False)), F.col(order))
    since = carried_last(known, series, [order], "segment", start, "active_since")
    return since.withColumn("active_since", F.when(F.col("active"), F.col("active_since"))).drop("_before", "segment")


def row_before(df: DataFrame, series: list[str], order: str, columns: list[str], name: str, span: int = DAY) -> DataFrame:
    """Add ``name``: a struct of ``columns`` of the row before in its series, NULL for the first."""
    parts = by_span(df, order, span)
    return carried_last(parts, series, [order], "segment", F.struct(*columns), name, inclusive=False).drop("segment")


def counter_with_reset(
    batches: DataFrame, series: str, order: str, size: str, threshold: int, bucket_rows: int = ranks.BUCKET_ROWS
) -> DataFrame:
    """Running count of pending rows per series that returns to zero once it reaches the threshold.

    ``batches`` holds one row per series and batch; ``order`` is a number or a timestamp, ``size`` is not negative (NULL counts as
    zero, a repeated batch is added up). No series is folded in one task. With running sums, the trigger that follows a
    trigger is the first batch whose sum is larger by the threshold; one scan by sums finds it for every batch. The triggers met
    from the start of a series are then collected by pointer doubling: each round doubles the length of the jumps and the
    triggers known, so a series of m batches takes log2(m) rounds of joins by row number. A threshold below one fires always.
    Result: series, order, size, pending_before, pending_after, triggered.
    """
    kind = dict(batches.dtypes)[size]
    sized = batches.select(series, order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size))
    if threshold < 1:
        added = sized.groupBy(series, order).agg(F.sum(size).cast(kind).alias(size))
        return added.withColumns({"pending_before": F.lit(0).cast("long"), "pending_after": F.lit(0).cast("long"), "triggered": F.lit(True)})
    sized = checkpointed(sized)  # what the batches are counted from is read once
    buckets = ranks.bucket_count(sized.count(), bucket_rows)
    totals = ranks.running_totals(sized, order, [size], [series], buckets=buckets)
    sums = checkpointed(totals.select(series, order, size, F.col(f"cum_{size}").alias("_sum"), F.monotonically_increasing_id().alias("_row")))

    # Seen from above, the batch that answers a wanted sum is the last one met; a batch comes after the wishes for its own sum.
    place = [F.col(c) for c in (series, order)]
    answers = sums.select(*place, F.col("_sum").alias("_at"), F.lit(1).alias("_answer"), "_row")
    wishes = sums.select(*place, (F.col("_sum") + F.lit(threshold)).alias("_at"), F.lit(0).alias("_answer"), "_row")
    nothing = sums.select(series).distinct().select(
        series, F.lit(None).cast(dict(sums.dtypes)[order]).alias(order), F.lit(threshold).cast("long").alias("_at"),
        F.lit(0).alias("_answer"), F.lit(None).cast("long").alias("_row"),
    )
    asked = ranks.with_key_buckets(answers.unionByName(wishes).unionByName(nothing), "_at", buckets, "segment")
    answer = F.when(F.col("_answer") == 1, F.col("_row"))
    met = carried_last(asked, [series], ["_at", "_answer", order], "segment", answer, "_next", descending=True)
    pointers = checkpointed(met.filter((F.col("_answer") == 0) & F.col("_next").isNotNull()).select("_row", "_next"))

    fired = pointers.filter(F.col("_row").isNull()).select(F.col("_next").alias("_row"))
    jumps = pointers.filter(F.col("_row").isNotNull())
    while True:
        further = checkpointed(fired.join(jumps, "_row").select(F.col("_next").alias("_row")))
        if further.isEmpty():
            break
        fired = checkpointed(fired.unionByName(further))
        twice = jumps.select(F.col("_row").alias("_next"), F.col("_next").alias("_then"))
        jumps = checkpointed(jumps.join(twice, "_next").select("_row", F.col("_then").alias("_next")))

    marked = sums.join(fired.withColumn("triggered", F.lit(True)), "_row", "left").fillna(False, ["triggered"])
    cut = ranks.with_key_buckets(marked, order, buckets, "segment")
    last = carried_last(cut, [series], [order], "segment", F.when(F.col("triggered"), F.col("_sum")), "_reset", inclusive=False)
    reset = F.coalesce("_reset", F.lit(0))
    return last.select(
        series,
        order,
        F.col(size).cast(kind).alias(size),
        (F.col("_sum") - F.col(size) - reset).alias("pending_before"),
        F.when(F.col("triggered"), F.lit(0)).otherwise(F.col("_sum") - reset).cast("long").alias("pending_after"),
        "triggered",
    )
