"""Mapping of the given Parquet tables to the transaction model.

``events`` joined with ``embeddings`` gives the raw transactions; the other tables supply bad rows, change batches,
version history and request logs. Every function returns a lazy DataFrame over whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txquality import schema as S
from txquality.functions import columns as C
from txquality.sources import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_class(event_type: Column, props: Column) -> Column:
    """Label: about two per cent of the events."""
    k = F.get_json_object(props, "$.k").cast("int")
    return F.when((event_type == "error") & (k >= 90), F.lit(1)).otherwise(F.lit(0)).cast("long")


def load_of(ts: Column) -> Column:
    """One load per calendar day."""
    return F.concat(F.lit("load-"), ts.cast("date").cast("string"))


def clock_start(spark: SparkSession, sf_dir: str) -> int:
    """Microsecond of the first event, for jobs that pass over the transactions several times."""
    return table(spark, sf_dir, "events").agg(F.min(C.micros(F.col("ts")))).first()[0]


def raw_core(spark: SparkSession, sf_dir: str, start: int | None = None) -> DataFrame:
    """Raw transactions without the 28 components: id, time, amount, class, load_id, row_uid.

    Plans that need no component use this one, so the scan reads five columns of one table and no join runs.
    """
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min(C.micros(F.col("ts")))).scalar() if start is None else F.lit(start)
    rows = events.select(
        F.col("event_id").alias("id"),
        ((C.micros(F.col("ts")) - first) / F.lit(1e6)).alias("time"),
        F.col("value").alias("amount"),
        event_class(F.col("event_type"), F.col("props")).alias("class"),
        load_of(F.col("ts")).alias("_load"),
    )
    return files.with_lineage(rows, F.col("_load")).drop("_load")


def folded(vector: str, place: int, width: int = 64, parts: int = 28) -> Column:
    """Sum of every ``parts``-th number of a vector from ``place`` on."""
    numbers = [F.col(vector)[i].cast("double") for i in range(place, width, parts)]
    return reduce(lambda a, b: a + b, numbers)


def raw_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions with v1..v28: the 64 numbers of the event's vector folded into 28, each added to the one 28 places before.

    The vectors grow with the data, so no broadcast is forced: Spark broadcasts them only under its size threshold
    and otherwise shuffles both sides on the uniform ``vec_id``.
    """
    vectors = table(spark, sf_dir, "embeddings")
    count = vectors.agg(F.count(F.lit(1))).scalar()
    picked = vectors.select("vec_id", *[folded("embedding", i).alias(f"v{i + 1}") for i in range(28)])
    core = raw_core(spark, sf_dir).withColumn("vec_id", F.col("id") % count)
    joined = core.join(picked, "vec_id")
    return joined.select("id", "time", *S.V_COLUMNS, "amount", "class", "load_id", "row_uid")


def inbound_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows offered for ingestion, some of them bad, from ``lineitem``: one batch per ship date."""
    return inbound(table(spark, sf_dir, "lineitem"))


def inbound(item: DataFrame) -> DataFrame:
    """The mapping of order lines, from a table or a stream of them, to rows offered for ingestion."""
    v = {
        1: F.col("l_tax"),
        2: F.when(F.col("l_linenumber") < 7, F.col("l_discount")),
    }
    return item.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").cast("long").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_shipdate").cast("date").alias("batch_day"),
        (F.col("l_orderkey") - F.lit(3)).cast("double").alias("time"),
        *[v.get(i, F.col("l_quantity") / F.lit(float(i))).alias(f"v{i}") for i in range(1, 29)],
        (F.col("l_extendedprice") - F.lit(950.0)).alias("amount"),
        F.when(F.col("l_returnflag") == "R", F.lit(None))
        .otherwise(F.when(F.col("l_linenumber") == 5, F.lit(2)).otherwise(F.lit(0)))
        .cast("long")
        .alias("is_fraud"),
    )


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a fixed score built from exact arithmetic, so that any SQL engine gets the same doubles."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("double")
    size = F.least(F.col("value") / F.lit(500.0), F.lit(1.0))
    lift = F.when(F.col("event_type") == "error", F.lit(0.25)).otherwise(F.lit(0.0))
    score = F.floor((k / F.lit(100.0) * F.lit(0.5) + size * F.lit(0.25) + lift) * F.lit(2000.0)) / F.lit(2000.0)
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        load_of(F.col("ts")).alias("load_id"),
        event_class(F.col("event_type"), F.col("props")).alias("label"),
        score.alias("score"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: one record per event, position = event_id; a run per user and day, some records without run id."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", F.lit("failed"))
        .when(kind == "purchase", F.lit("completed"))
        .when(kind == "view", F.lit("running"))
        .when(kind == "click", F.lit("pipeline_running"))
        .otherwise(F.lit("versioned"))
    )
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    trigger = (
        F.when(k < 20, F.lit("ingest"))
        .when(k < 40, F.lit("simulate"))
        .when(k < 60, F.lit("manual_retrain"))
        .when(k < 80, F.lit("dashboard_edit"))
        .otherwise(F.lit("rollback"))
    )
    return events.select(
        F.col("event_id").alias("pos"),
        F.when(
            ~((kind == "signup") & (k < 20)),
            F.concat_ws("-", F.lit("run"), F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")),
        ).alias("run_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        trigger.alias("trigger"),
        status.alias("status"),
        F.when(k % 3 != 0, F.when(k < 50, F.lit("pipeline")).otherwise(F.lit("continuous"))).alias("job_kind"),
        F.col("value").cast("long").alias("rows_added"),
    )


def step_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of the run event log: run_id, pos, ts, line."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    names = [*S.STAGES, "other_step"]
    op = F.element_at(F.array(*[F.lit(n) for n in names]), (k % 8 + 1).cast("int"))
    event = (
        F.when(F.col("event_type") == "error", F.lit("STEP_FAILURE"))
        .when(F.col("event_type").isin("purchase", "signup"), F.lit("STEP_SUCCESS"))
        .when(F.col("event_type") == "view", F.lit("STEP_START"))
        .otherwise(F.lit("STEP_OUTPUT"))
    )
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("pos"),
        stamp.alias("ts"),
        F.concat_ws(" - ", stamp, F.lit("job"), F.col("user_id").cast("string"), F.lit("1"), op, event, F.lit("message")).alias(
            "line"
        ),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: handler, second, latency in seconds, status code."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return events.select(
        F.concat(F.lit("/"), F.col("event_type")).alias("handler"),
        F.floor(C.micros(F.col("ts")) / F.lit(1_000_000)).cast("long").alias("second"),
        (F.col("value") / F.lit(100.0)).alias("latency"),
        F.when(k >= 95, F.lit(500)).when(k >= 85, F.lit(404)).otherwise(F.lit(200)).alias("status"),
    )
