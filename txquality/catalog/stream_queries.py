"""Streams run to the end of the available files; results are read back from their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog import sql as Q
from txquality.catalog.drift_queries import _BY_LOAD
from txquality.catalog.metric_queries import _SAMPLES, _samples
from txquality.catalog.quality_queries import _JUDGED
from txquality.catalog.registry import query
from txquality.functions import columns as C
from txquality.operators import psi
from txquality.plans import continuous, drift, jobs as plan_jobs, training
from txquality.session import shared_dir
from txquality.sources import star_tables as st
from txquality.streaming import jobs


def _folders(spark, name):
    root = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


PARTS = 3
#: Seconds: samples come once a minute at most; late ones may join within the second figure.
ALERT_GAP, ALERT_LATENESS = 90, 7200


def _arrivals(spark, sf_dir, name, part, run):
    """Let a table arrive in parts. After each, ``run`` goes on from its checkpoint, so every part is a batch of its own."""
    folder, rows = _folders(spark, f"{name}-files")[0], st.table(spark, sf_dir, name)
    for k in range(PARTS):
        rows.filter(part == k).write.mode("append").parquet(folder)
        run(jobs.file_stream(spark, folder, rows.schema)).awaitTermination()


def _events_arrive(spark, sf_dir, run):
    """Events in three parts by time, as contract rows. The start of the clock is a fact of the dataset, read once."""
    start = st.clock_start(spark, sf_dir)
    end = st.table(spark, sf_dir, "events").agg(F.max(C.micros(F.col("ts")))).first()[0]
    part = F.floor((C.micros(F.col("ts")) - F.lit(start)) * PARTS / F.lit(end - start + 1))
    _arrivals(spark, sf_dir, "events", part, lambda stream: run(_contract_rows(stream, start)))


def _contract_rows(stream, start):
    return stream.select(
        "ts",
        F.col("event_id").cast("string").alias("transaction_id"),
        st.load_of(F.col("ts")).alias("load_id"),
        ((C.micros(F.col("ts")) - F.lit(start)) / F.lit(1e6)).alias("time_seconds"),
        F.col("value").alias("amount"),
        st.event_class(F.col("event_type"), F.col("props")).alias("is_fraud"),
    )


@query(
    "stream_hourly",
    f"with {Q.CORE}, {Q.FEATS} select hour_of_day, count(*) as nb_transactions, sum(is_fraud)::bigint as nb_fraud, "
    f"{Q.rounded('sum(is_fraud)::double / count(*)::double', 6)} as fraud_rate, {Q.rounded('avg(amount)', 2)} as avg_amount from feats group by 1",
)
def stream_hourly(spark, sf_dir):
    out, checkpoint = _folders(spark, "hourly")

    def run(rows):
        feats = rows.filter(F.col("amount") >= 0).withColumn("hour_of_day", C.hour_of_day(F.col("time_seconds")))
        return jobs.hourly_summary(feats, out, checkpoint)

    _events_arrive(spark, sf_dir, run)
    return jobs.newest(spark, out)


@query(
    "stream_windows",
    f"""with w as (
      select date_trunc('hour', ts) as window_start, count(*) as nb_transactions, sum({Q.CLASS})::bigint as nb_fraud, max(value) as max_amount
      from events group by 1)
    select epoch_us(window_start) // 1000000 as window_start, nb_transactions, nb_fraud, max_amount from w
    where window_start + interval 1 hour <= (select max(ts) from events) - interval 1 hour""",
)
def stream_windows(spark, sf_dir):
    """Hours the watermark has closed."""
    out, checkpoint = _folders(spark, "windows")

    def run(rows):
        return jobs.windowed_summary(rows.withColumn("ts", F.timestamp_micros(C.micros(F.col("ts")))), out, checkpoint)

    _events_arrive(spark, sf_dir, run)
    return spark.read.parquet(out).withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "stream_late_rows",
    f"""with bounds as (select min(epoch_us(ts)) as low, max(epoch_us(ts)) as high from events),
    arrived as (select case when event_id % 11 = 0 then {PARTS - 1} else least(((epoch_us(ts) - low) * {PARTS} // (high - low + 1)), {PARTS - 1}) end as part, * from events, bounds),
    seen as (select part, epoch_us(date_trunc('hour', ts)) + 3600000000 as closes,
               (select max(epoch_us(o.ts)) from arrived o where o.part < a.part) - 3600000000 as mark from arrived a)
    select part::integer as batch_id, count(*) filter (where mark is null or closes > mark) as on_time, count(*) filter (where closes <= mark) as late, count(*) as every
    from seen group by 1""",
)
def stream_late_rows(spark, sf_dir):
    """Rows per batch on either side of the watermark: an eleventh of the events arrives with the last part, most of them late."""
    out, checkpoint = _folders(spark, "late")
    folder, rows = _folders(spark, "late-files")[0], st.table(spark, sf_dir, "events")
    micros = C.micros(F.col("ts"))
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    part = F.when(F.col("event_id") % 11 == 0, F.lit(PARTS - 1)).otherwise(F.floor((micros - low) * PARTS / F.lit(high - low + 1)))
    for k in range(PARTS):
        rows.filter(part == k).write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, rows.schema).withColumn("ts", F.timestamp_micros(C.micros(F.col("ts"))))
        jobs.late_and_on_time(stream, out, checkpoint).awaitTermination()
    counted = spark.read.parquet(out).groupBy("batch_id").agg(F.count_if(~F.col("is_late")).alias("on_time"), F.count_if("is_late").alias("late"), F.count(F.lit(1)).alias("every"))
    return counted


@query(
    "stream_psi_daily",
    f"with {_BY_LOAD} select load_id, feature, {Q.rounded('psi', 9)} as psi from indexes",
)
def stream_psi_daily(spark, sf_dir):
    """Drift per calendar day from counts in update mode; the newest row of each day, feature and bin counts."""
    out, checkpoint = _folders(spark, "psi-daily")
    batch = st.raw_core(spark, sf_dir, st.clock_start(spark, sf_dir)).select(F.col("time").alias("time_seconds"), "amount")
    reference = drift.split_sides(drift.drift_features(batch)).reference
    edges = psi.bin_edges(reference, S.MONITORED)

    def run(rows):
        return jobs.daily_drift_counts(rows.withColumn("ts", F.timestamp_micros(C.micros(F.col("ts")))), edges, out, checkpoint)

    _events_arrive(spark, sf_dir, run)
    counts = jobs.newest_per_key(spark, out, ["day", "feature", "bin"]).withColumn("load_id", st.load_of(F.col("day"))).drop("day")
    indexes = jobs.drift_from_counts(counts, reference, edges, "load_id")
    return indexes.withColumn("psi", C.rounded(F.col("psi"), 9))


@query(
    "stream_alerts",
    f"""with {_SAMPLES}, conditioned as (
      select series, second, 'drift_high' as alert, max_psi >= psi_threshold as on_, 60 as hold from samples
      union all select series, second, 'drift_moderate', max_psi >= 0.10 and max_psi < psi_threshold, 300 from samples
      union all select series, second, 'last_run_failed', last_run_success = 0, 60 from samples
      union all select series, second, 'runs_stale', second - last_run_epoch > 259200, 600 from samples
      union all select series, second, 'scoring_down', scoring_up = 0, 60 from samples
      union all select series, second, 'platform_down', platform_up = 0, 120 from samples
      union all select series, second, 'drift_unavailable', drift_available = 0, 600 from samples),
    marked as (select *, case when second - lag(second) over (partition by series, alert order by second) < {ALERT_GAP} then 0 else 1 end as opens
               from conditioned where on_),
    numbered as (select *, sum(opens) over (partition by series, alert order by second) as session from marked),
    sessions as (select series, alert, hold, session, min(second) as active_since, max(second) as last_active, count(*) as samples from numbered group by all)
    select series, alert, active_since, last_active, samples, last_active - active_since >= hold as fired from sessions
    where last_active + {ALERT_GAP} <= (select max(second) from conditioned where on_) - {ALERT_LATENESS}""",
)
def stream_alerts(spark, sf_dir):
    """Hold-time alerts over gauge samples that arrive in three parts, the samples of every seventh minute one part late."""
    out, checkpoint = _folders(spark, "alerts")
    folder, samples = _folders(spark, "alert-files")[0], _samples(spark, sf_dir).withColumn("ts", F.timestamp_seconds("second"))
    low, high = samples.agg(F.min("second"), F.max("second")).first()
    by_time = F.floor((F.col("second") - low) * PARTS / F.lit(high - low + 1))
    near = F.floor((F.col("second") + ALERT_LATENESS // 2 - low) * PARTS / F.lit(high - low + 1)) > by_time
    part = F.least(by_time + F.when(near & (F.floor(F.col("second") / 60) % 7 == 0), 1).otherwise(0), F.lit(PARTS - 1))
    schema = samples.schema
    for k in range(PARTS):
        samples.filter(part == k).write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, schema).drop("second")
        jobs.alert_sessions(stream, ["series"], f"{ALERT_GAP} seconds", out, checkpoint, f"{ALERT_LATENESS} seconds").awaitTermination()
    found = spark.read.parquet(out)
    return found.withColumns({c: F.unix_seconds(c) for c in ("active_since", "last_active")})


@query(
    "stream_psi",
    f"with {_BY_LOAD} select load_id, feature, {Q.rounded('psi', 9)} as psi from indexes",
)
def stream_psi(spark, sf_dir):
    out, checkpoint = _folders(spark, "psi")
    batch = st.raw_core(spark, sf_dir, st.clock_start(spark, sf_dir)).select(F.col("time").alias("time_seconds"), "amount")
    reference = drift.split_sides(drift.drift_features(batch)).reference
    edges = psi.bin_edges(reference, S.MONITORED)
    _events_arrive(spark, sf_dir, lambda rows: jobs.drift_counts(rows, edges, "load_id", out, checkpoint))
    indexes = jobs.drift_from_counts(jobs.newest(spark, out), reference, edges, "load_id")
    return indexes.withColumn("psi", C.rounded(F.col("psi"), 9))


def _ingested(spark, sf_dir):
    """Order lines in three parts, offered for ingestion and judged."""
    out, checkpoint = _folders(spark, "ingest")
    _arrivals(spark, sf_dir, "lineitem", F.col("l_orderkey") % PARTS, lambda stream: jobs.ingest(st.inbound(stream), out, checkpoint))
    return out


@query(
    "stream_ingest",
    f"with {Q.INBOUND}, {_JUDGED} select (order_key % {PARTS})::integer as batch_id, order_key, line_number, part_key, supp_key, amount, reasons, "
    "reasons = '' as is_valid from judged",
)
def stream_ingest(spark, sf_dir):
    """Admitted and refused rows with their reasons, and the batch that brought them."""
    rows = jobs.ingested(spark, _ingested(spark, sf_dir))
    keys = ["batch_id", "order_key", "line_number", "part_key", "supp_key", "amount"]
    return rows.select(*keys, F.concat_ws(",", "reasons").alias("reasons"), "is_valid")


@query(
    "stream_trigger",
    f"""with recursive {Q.INBOUND}, {_JUDGED}, t as (select count(*) // 8 as threshold from lineitem),
    sizes as (select (order_key % {PARTS})::integer as batch_id, count(*) filter (where reasons = '') as n from judged group by 1),
    folded as (
      select batch_id, n as row_count, 0::bigint as pending_before, n >= threshold as triggered, case when n >= threshold then 0 else n end as pending_after
      from sizes, t where batch_id = 0
      union all
      select s.batch_id, s.n, f.pending_after, f.pending_after + s.n >= threshold,
             case when f.pending_after + s.n >= threshold then 0 else f.pending_after + s.n end
      from folded f join sizes s on s.batch_id = f.batch_id + 1, t)
    select 'transactions' as dataset, batch_id, row_count, pending_before, pending_after, triggered from folded""",
)
def stream_trigger(spark, sf_dir):
    """Pending rows carried from batch to batch; an eighth of all lines is the threshold."""
    threshold = st.table(spark, sf_dir, "lineitem").count() // 8
    return jobs.pending_state(spark, _ingested(spark, sf_dir), threshold)


@query(
    "continuous_training",
    f"""with recursive t as (select count(*) // 2 as threshold from events),
    sizes as (select (event_id % {PARTS})::integer as batch_id, count(*) as offered, count(*) filter (where event_id % 17 <> 0 and value >= 0) as n
              from events group by 1),
    folded as (
      select batch_id, offered, n, n as counted, n as every, n >= threshold as reached from sizes, t where batch_id = 0
      union all
      select s.batch_id, s.offered, s.n, case when f.reached then 0 else f.counted end + s.n, f.every + s.n,
             case when f.reached then 0 else f.counted end + s.n >= threshold
      from folded f join sizes s on s.batch_id = f.batch_id + 1, t),
    steps as (
      select batch_id, 1 as step_no, 'admit' as step, 'completed' as status, offered as row_count from folded
      union all select batch_id, 2, 'append', 'completed', n from folded
      union all select batch_id, 3, 'count', case when reached then 'reached' else 'pending' end, counted from folded
      union all select batch_id, no, step, 'completed', every
      from folded, (values (4, 'version'), (5, 'train'), (6, 'drift'), (7, 'register')) as v(no, step) where reached)
    select 1 as attempt, * from steps union all select 2, * from steps where batch_id = 1
    union all select 3, -1, 1, 'versions', 'total', count(*) from folded where reached
    union all select 3, -1, 2, 'models', 'total', count(*) from folded where reached
    union all select 3, -1, 3, 'drift checks', 'total', count(*) from folded where reached""",
)
def continuous_training(spark, sf_dir):
    """Three batches of transactions, a seventeenth of them bad, through the whole chain; the one that trains is offered twice.

    The last rows count what the batches left behind: a version, a registered model and a drift record for each that reached the threshold.
    """
    root = _folders(spark, "chain")[0]
    raw = st.raw_full(spark, sf_dir).withColumnRenamed("class", "is_fraud").drop("load_id", "row_uid")
    offered = raw.withColumn("amount", F.when(F.col("id") % 17 == 0, -1.0).otherwise(F.col("amount")))
    chain = continuous.Chain(spark, root, st.table(spark, sf_dir, "events").count() // 2, plan_jobs.learning_steps(spark, root))
    out = None
    for attempt, k in ((1, 0), (1, 1), (2, 1), (1, 2)):
        steps = chain.run(offered.filter(F.col("id") % PARTS == k), k).drop("result", "error").withColumn("attempt", F.lit(attempt))
        out = steps if out is None else out.unionByName(steps)
    left = (chain.store.manifest(), spark.read.parquet(f"{root}/model_versions"), spark.read.schema(S.DRIFT_SCHEMA).json(f"{root}/drift_history"))
    for no, (name, table) in enumerate(zip(("versions", "models", "drift checks"), left)):
        total = table.agg(F.lit(-1).alias("batch_id"), F.lit(no + 1).alias("step_no"), F.lit(name).alias("step"), F.lit("total").alias("status"), F.count(F.lit(1)).alias("row_count"), F.lit(3).alias("attempt"))
        out = out.unionByName(total)
    return out


@query(
    "stream_scored_and_refused",
    """select cast(event_id as varchar) as transaction_id, event_id % 13 <> 0 and event_id % 19 <> 0 as is_scored,
      concat_ws(',', case when event_id % 13 = 0 then 'amount,log_amount' end, case when event_id % 19 = 0 then 'hour_of_day' end) as reasons,
      case when event_id % 13 <> 0 and event_id % 19 <> 0 then true end as decided_by_threshold, 1 as copies from events""",
)
def stream_scored_and_refused(spark, sf_dir):
    """Every event is either scored or refused with the features it lacks; its decision is the probability against the threshold."""
    out, checkpoint = _folders(spark, "scored")
    batch = st.raw_core(spark, sf_dir).select(F.col("time").alias("time_seconds"), "amount", F.col("class").alias("is_fraud"))
    model, _ = training.fit("logreg_baseline", drift.drift_features(batch), S.MONITORED)

    def run(rows):
        k = F.col("transaction_id").cast("long")
        holes = rows.withColumns({"amount": F.when(k % 13 != 0, F.col("amount")), "time_seconds": F.when(k % 19 != 0, F.col("time_seconds"))})
        return jobs.score_or_refuse(drift.drift_features(holes), model, S.DEFAULT_SCORE_THRESHOLD, "v1", out, checkpoint)

    _events_arrive(spark, sf_dir, run)
    rows = jobs.scored_and_refused(spark, out)
    decided = F.col("decision") == (F.col("probability_fraud") >= F.col("threshold"))
    return rows.groupBy("transaction_id").agg(
        F.first("is_scored").alias("is_scored"),
        F.first(F.array_join(F.coalesce("reasons", F.array()), ",")).alias("reasons"),
        F.first(decided).alias("decided_by_threshold"),
        F.count(F.lit(1)).cast("int").alias("copies"),
    )


@query("stream_scores")
def stream_scores(spark, sf_dir):
    """Score every event with a model trained on the plain features, and read the prediction log back."""
    out, checkpoint = _folders(spark, "scores")
    batch = st.raw_core(spark, sf_dir).select(
        F.col("time").alias("time_seconds"), "amount", F.col("class").alias("is_fraud")
    )
    model, _ = training.fit("logreg_baseline", drift.drift_features(batch), S.MONITORED)

    def run(rows):
        return jobs.score_stream(drift.drift_features(rows), model, S.DEFAULT_SCORE_THRESHOLD, "v1", out, checkpoint)

    _events_arrive(spark, sf_dir, run)
    return spark.read.schema(S.PREDICTION_SCHEMA).json(out).drop("timestamp")
