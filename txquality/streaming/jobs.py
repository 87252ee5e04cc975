"""Streams over arriving files: ingestion with trigger, scoring, hourly summary and drift per day.

Sinks are written so that a repeated micro-batch gives the same result: data folders and control rows are named after
the batch and overwritten, never appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from txquality.functions import columns as C
from txquality import schema as S
from txquality.operators import admission, psi
from txquality.plans import drift, metrics, runs, training
from txquality.sources import files


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, name_filter: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def _start(df: DataFrame, checkpoint: str, mode: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )


def ingest(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write every batch once, admitted and refused rows in folders of their own; both keep their reasons."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = admission.judged(batch)
        judged.write.mode("overwrite").partitionBy("is_valid").parquet(f"{target}/batch_id={batch_id}")

    return _start(rows, checkpoint, "append", handle)


def ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).withColumn("is_valid", F.col("is_valid").cast("boolean"))


def admitted(spark: SparkSession, target: str) -> DataFrame:
    return ingested(spark, target).filter("is_valid").drop("reasons", "is_valid")


def refused(spark: SparkSession, target: str) -> DataFrame:
    return ingested(spark, target).filter("not is_valid")


def pending_state(spark: SparkSession, target: str, threshold: int) -> DataFrame:
    """Pending counter and trigger decision after every batch, replayed from the admitted rows of each batch."""
    sizes = ingested(spark, target).groupBy("batch_id").agg(F.count_if(F.col("is_valid")).alias("row_count"))
    batches = sizes.withColumn("dataset", F.lit("transactions"))
    return runs.volume_trigger(batches, "dataset", "batch_id", "row_count", threshold)


def unscorable(rows: DataFrame):
    """Condition of rows in which a monitored feature is NULL."""
    empty = F.lit(False)
    for name in S.MONITORED:
        empty = empty | F.col(name).isNull()
    return empty


def score_stream(rows: DataFrame, model: PipelineModel, threshold: float, version: str, target: str, checkpoint: str) -> StreamingQuery:
    """Score and log every row that has all features: JSON lines of the prediction log. Rows with a NULL feature cannot be
    scored; ``unscorable`` selects them for a sink of their own."""
    records = files.prediction_records(training.score(model, rows.filter(~unscorable(rows))), version, threshold)
    return (
        records.writeStream.format("json")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )


def missing_features() -> Column:
    """Names of the monitored features that are NULL, in their order."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in S.MONITORED]))


def score_or_refuse(rows: DataFrame, model: PipelineModel, threshold: float, version: str, target: str, checkpoint: str) -> StreamingQuery:
    """Two sinks from every micro-batch: rows with all features are scored, the others are kept with the names of those they lack.

    Both folders are named after the batch and overwritten when it is repeated, so every row is in exactly one of them, once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("reasons", missing_features()).persist()
        try:
            scored = training.score(model, judged.filter(F.size("reasons") == 0).drop("reasons"))
            decided = files.rounded_predictions(scored, threshold).withColumns({"threshold": F.lit(threshold), "model_version": F.lit(version)})
            decided.write.mode("overwrite").parquet(f"{target}/scored/batch_id={batch_id}")
            judged.filter(F.size("reasons") > 0).write.mode("overwrite").parquet(f"{target}/refused/batch_id={batch_id}")
        finally:
            judged.unpersist()

    return _start(rows, checkpoint, "append", handle)


def scored_and_refused(spark: SparkSession, target: str) -> DataFrame:
    """Rows of both sinks with ``is_scored``; a score has no reasons, a refused row no score."""
    scored = spark.read.parquet(f"{target}/scored").withColumn("is_scored", F.lit(True))
    refused = spark.read.parquet(f"{target}/refused").withColumn("is_scored", F.lit(False))
    return scored.unionByName(refused, allowMissingColumns=True)


def hourly_summary(feats: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Hour-of-day summary over all rows so far. State: 24 keys."""
    total, fraud = F.count(F.lit(1)), F.sum("is_fraud")
    summary = feats.groupBy("hour_of_day").agg(
        total.alias("nb_transactions"),
        fraud.alias("nb_fraud"),
        C.rounded(F.try_divide(fraud.cast("double"), total.cast("double")), 6).alias("fraud_rate"),
        C.rounded(F.avg("amount"), 2).alias("avg_amount"),
    )
    return _start(summary, checkpoint, "complete", _state_per_batch(target))


#: Files that the state after a batch is written to.
STATE_FILES = 8


def _state_per_batch(target: str) -> Callable[[DataFrame, int], None]:
    """Write the state after every batch into a folder of the batch's name; readers take the newest.

    The rows are dealt out before they are written, so that every partition of the state has a task of its own: fewer partitions
    without a shuffle would give one task the tables in memory of all of them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.repartition(STATE_FILES).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return handle


def newest(spark: SparkSession, target: str) -> DataFrame:
    """State after the last batch that was written to its end."""
    states = spark.read.parquet(target)
    return states.filter(F.col("batch_id") == states.agg(F.max("batch_id")).scalar()).drop("batch_id")


def windowed_summary(events: DataFrame, target: str, checkpoint: str, ts: str = "ts", lateness: str = "1 hour") -> StreamingQuery:
    """Tumbling hours by event time; a window is written once the watermark has passed it, later rows are dropped."""
    windows = (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("nb_transactions"), F.sum("is_fraud").alias("nb_fraud"), F.max("amount").alias("max_amount"))
        .select(F.col("w.start").alias("window_start"), "nb_transactions", "nb_fraud", "max_amount")
    )
    return (
        windows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )


def drift_counts(rows: DataFrame, edges: psi.Edges, group: str, target: str, checkpoint: str) -> StreamingQuery:
    """Bin counts per group against frozen edges. State: one row per group, feature and bin, whatever the rows of a batch."""
    usable = {c: e for c, e in edges.items() if e}
    long = F.array(*[F.struct(F.lit(c).alias("feature"), psi.bin_of(F.col(c), e).alias("bin")) for c, e in usable.items()])
    binned = drift.drift_features(rows).select(group, F.inline(long))
    counts = binned.groupBy(group, "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    return _start(counts, checkpoint, "complete", _state_per_batch(target))


def late_and_on_time(
    events: DataFrame, target: str, checkpoint: str, ts: str = "ts", window: str = "1 hour", lateness: str = "1 hour"
) -> StreamingQuery:
    """Every row of every batch, stored with ``is_late``: whether its window had closed when the batch began.

    The watermark of a batch is the largest event time of the batches before it less the lateness; it is kept as one row per batch,
    so a repeated batch finds the same one. On-time rows are those that ``windowed_summary`` counts, late ones those it drops.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = files.read_or_empty(spark, "parquet", f"{target}-marks", "newest timestamp, batch_id int")
        newest = marks.filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        closes = F.window(ts, window)["end"]
        mark = F.lit(newest) - F.expr(f"interval {lateness}") if newest is not None else F.lit(None).cast("timestamp")
        judged = batch.withColumn("is_late", F.coalesce(closes <= mark, F.lit(False)))
        judged.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        spark.read.parquet(f"{target}/batch_id={batch_id}").agg(F.max(ts).alias("newest")).coalesce(1).write.mode("overwrite").parquet(
            f"{target}-marks/batch_id={batch_id}"
        )

    return _start(events, checkpoint, "append", handle)


def daily_drift_counts(
    rows: DataFrame, edges: psi.Edges, target: str, checkpoint: str, ts: str = "ts", lateness: str = "1 day"
) -> StreamingQuery:
    """Bin counts per calendar day against frozen edges, in update mode: a batch writes the rows that it changed.

    State: one row per day, feature and bin for the days that the watermark has not passed; older days are final and leave the state.
    """
    usable = {c: e for c, e in edges.items() if e}
    long = F.array(*[F.struct(F.lit(c).alias("feature"), psi.bin_of(F.col(c), e).alias("bin")) for c, e in usable.items()])
    binned = drift.drift_features(rows.withWatermark(ts, lateness)).select(ts, F.inline(long))
    counts = binned.groupBy(F.window(ts, "1 day").alias("w"), "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    days = counts.select(F.col("w.start").alias("day"), "feature", "bin", "n")
    return _start(days, checkpoint, "update", _state_per_batch(target))


def newest_per_key(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last row written for every key by batches that write what changed."""
    states = spark.read.parquet(target)
    others = [c for c in states.columns if c not in (*keys, "batch_id")]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("batch_id")).alias("s")).select(*keys, "s.*")


def alert_sessions(samples: DataFrame, series: list[str], gap: str, target: str, checkpoint: str, lateness: str = "10 minutes") -> StreamingQuery:
    """Stretches in which a declared rule was active without a break, and whether that was long enough to fire.

    Wide samples with a timestamp ``ts`` become one row per series and active rule. Active samples less than ``gap`` apart are one event-time
    session; give a gap between one and two sampling intervals, so that an inactive or missing sample ends it. A session is written once
    the watermark has passed its end; samples that come late within ``lateness`` still join it. It fired if it lasted as long
    as the rule's hold time. State: one row per series, rule and open session.
    """
    active = metrics.active_rules(samples.withWatermark("ts", lateness).withColumn("second", F.unix_seconds("ts")), [*series, "ts"])
    sessions = active.groupBy(*series, "alert", "hold", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("active_since"), F.max("ts").alias("last_active"), F.count(F.lit(1)).alias("samples")
    )
    lasted = F.unix_micros("last_active") - F.unix_micros("active_since")
    fired = sessions.select(*series, "alert", "active_since", "last_active", "samples", (lasted >= F.col("hold") * 1_000_000).alias("fired"))
    return (
        fired.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )


def drift_from_counts(counts: DataFrame, reference: DataFrame, edges: psi.Edges, group: str) -> DataFrame:
    """(group, feature, psi) from streamed counts and the reference rows."""
    bins = psi.bin_table(reference, edges)
    left = psi.shares(psi.binned_counts(reference, edges, []), bins).select("feature", "bin", F.col("share").alias("reference"))
    right = psi.shares(counts, bins, [group]).withColumnRenamed("share", "recent")
    return psi.psi_of(right.join(F.broadcast(left), ["feature", "bin"]), [group, "feature"])


def metric_samples(rows: DataFrame, series: str, target: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Gauge rows of every micro-batch as a long table: rows seen, frauds and largest amount per series.

    A sample's time is the largest event time of its rows, so a repeated batch gives the same samples; its folder is overwritten.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        sizes = batch.groupBy(F.col(series).cast("string").alias("series")).agg(
            F.max(ts).alias("ts"), F.count(F.lit(1)).alias("batch_rows"), F.sum("is_fraud").alias("batch_frauds"), F.max("amount").alias("max_amount")
        )
        names = ["batch_rows", "batch_frauds", "max_amount"]
        long = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        samples = sizes.select("ts", "series", F.inline(long))
        samples.repartition(STATE_FILES).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return _start(rows, checkpoint, "append", handle)
