"""Gauges, alerts, rates and latency."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from txquality.catalog import sql as Q
from txquality.catalog.drift_queries import _HALF_CUR, _HALVES, _rows
from txquality.catalog.registry import query
from txquality.catalog.run_queries import _LOG, VOLUME_THRESHOLD
from txquality.functions import columns as C
from txquality.plans import drift, metrics, runs
from txquality.sources import star_tables as st


def _status(spark, sf_dir):
    """Status row: rows, rows of the newest day as pending, and the run log's state."""
    events = st.table(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    sizes = events.agg(F.count(F.lit(1)).alias("dataset_rows"))
    pending = events.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("n", "d").alias("pending"))
    log = st.run_log(spark, sf_dir)
    running = runs.latest_runs(log).agg(F.max(F.col("status").isin("running", "pipeline_running").cast("int")).alias("running"))
    last = runs.last_finished_run(log).agg(
        F.max((F.col("status") == "completed").cast("int")).alias("last_success"),
        F.max(C.micros(F.col("timestamp").cast("timestamp_ntz")) / F.lit(1e6)).alias("last_epoch"),
    )
    finished = last.select(F.struct("last_success", "last_epoch")).scalar()
    return sizes.select(
        "dataset_rows",
        pending.scalar().alias("pending"),
        running.scalar().alias("running"),
        finished["last_success"].alias("last_success"),
        finished["last_epoch"].alias("last_epoch"),
        F.lit(VOLUME_THRESHOLD).alias("threshold"),
    )


def _gauges(spark, sf_dir):
    return metrics.gauges(_status(spark, sf_dir), drift.summary(_rows(spark, sf_dir)))


_GAUGES = f"""{_HALVES}, {_LOG},
finished as (select * from latest where job_kind is not null and status in ('completed', 'failed') order by first_pos desc limit 1),
status_ as (
  select (select count(*) from events) as dataset_rows,
         (select count(*) from events where cast(ts as date) = (select max(cast(ts as date)) from events)) as pending,
         (select max(case when status in ('running', 'pipeline_running') then 1 else 0 end) from latest) as running,
         (select max(case when status = 'completed' then 1 else 0 end) from finished) as last_success,
         (select max(epoch_us(cast(timestamp as timestamp)) / 1e6::double) from finished) as last_epoch,
         (select max(psi) from indexes) as max_psi, (select count(*) from base where {_HALF_CUR}) as recent_rows),
gauges as (
  select 'fraud_dataset_rows' as metric, '' as feature, dataset_rows::double as value from status_
  union all select 'fraud_pending_updates', '', pending from status_
  union all select 'fraud_update_threshold', '', {VOLUME_THRESHOLD} from status_
  union all select 'fraud_pending_share', '', least(100.0::double, round(pending::double / {VOLUME_THRESHOLD} * 100)) from status_
  union all select 'fraud_pipeline_running', '', running from status_
  union all select 'fraud_pipeline_last_run_success', '', last_success from status_
  union all select 'fraud_pipeline_last_run_timestamp_seconds', '', last_epoch from status_
  union all select 'fraud_drift_available', '', 1 from status_
  union all select 'fraud_drift_max_psi', '', max_psi from status_
  union all select 'fraud_drift_threshold', '', 0.25 from status_
  union all select 'fraud_drift_alert', '', case when max_psi >= 0.25 then 1 else 0 end from status_
  union all select 'fraud_drift_recent_rows', '', recent_rows from status_
  union all select 'fraud_drift_psi', feature, psi from indexes)"""


@query(
    "metric_gauges",
    f"with {_GAUGES} select metric, feature, {Q.rounded('value', 9)} as value from gauges where value is not null",
)
def metric_gauges(spark, sf_dir):
    rows = _gauges(spark, sf_dir)
    return rows.select(
        "metric", F.coalesce(F.col("labels")["feature"], F.lit("")).alias("feature"), C.rounded(F.col("value"), 9).alias("value")
    )


@query(
    "exposition_lines",
    f"""with {_GAUGES} select metric || case when feature <> '' then '{{feature="' || feature || '"}}' else '' end || ' '
      || case when value = floor(value) then cast(value::bigint as varchar) else printf('%.9f', value) end as line
    from gauges where value is not null""",
)
def exposition_lines(spark, sf_dir):
    return metrics.exposition_lines(_gauges(spark, sf_dir))


def _samples(spark, sf_dir):
    """Metric samples: one per series and minute."""
    events = st.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    second = (F.floor(C.micros(F.col("ts")) / F.lit(60_000_000)) * 60).cast("long")
    return events.groupBy(F.col("event_type").alias("series"), second.alias("second")).agg(
        (F.max("value") / F.lit(400.0)).alias("max_psi"),
        F.lit(0.25).alias("psi_threshold"),
        F.when(F.min(k) >= 40, 1).otherwise(0).alias("last_run_success"),
        (F.min(C.micros(F.date_trunc("month", F.col("ts")))) / F.lit(1e6) + F.max(k) * F.lit(10000.0)).alias("last_run_epoch"),
        F.when(F.max(k) < 70, 1).otherwise(0).alias("scoring_up"),
        F.when(F.max(k) < 60, 1).otherwise(0).alias("platform_up"),
        F.when(F.max(k) < 50, 1).otherwise(0).alias("drift_available"),
    )


_SAMPLES = """samples as (
  select event_type as series, (epoch_us(ts) // 60000000) * 60 as second, max(value) / 400.0::double as max_psi, 0.25::double as psi_threshold,
         case when min(cast(props->>'$.k' as integer)) >= 40 then 1 else 0 end as last_run_success,
         min(epoch_us(date_trunc('month', ts))) / 1e6::double + max(cast(props->>'$.k' as integer)) * 10000.0::double as last_run_epoch,
         case when max(cast(props->>'$.k' as integer)) < 70 then 1 else 0 end as scoring_up,
         case when max(cast(props->>'$.k' as integer)) < 60 then 1 else 0 end as platform_up,
         case when max(cast(props->>'$.k' as integer)) < 50 then 1 else 0 end as drift_available
  from events group by 1, 2)"""


def _states(source: str, keys: str) -> str:
    return f"""marked as (
      select *, max(case when not on_ then second end) over (partition by {keys} order by second) as quiet from {source}),
    since as (select *, case when on_ then min(second) over (partition by {keys}, quiet, on_) end as active_since from marked)"""


@query(
    "alert_hold",
    f"""with {_SAMPLES}, conditioned as (select series, second, max_psi, max_psi >= psi_threshold as on_ from samples),
    {_states('conditioned', 'series')}
    select series, second, max_psi, on_ as active, active_since,
           case when not on_ then 'inactive' when second - active_since >= 3600 then 'firing' else 'pending' end as state from since""",
)
def alert_hold(spark, sf_dir):
    samples = _samples(spark, sf_dir).select("series", "second", "max_psi", "psi_threshold")
    states = metrics.alert_states(samples, ["series"], "second", F.col("max_psi") >= F.col("psi_threshold"), 3600)
    return states.drop("psi_threshold")


@query(
    "alert_rules",
    f"""with {_SAMPLES}, conditioned as (
      select series, second, 'drift_high' as alert, max_psi >= psi_threshold as on_, 60 as hold from samples
      union all select series, second, 'drift_moderate', max_psi >= 0.10 and max_psi < psi_threshold, 300 from samples
      union all select series, second, 'last_run_failed', last_run_success = 0, 60 from samples
      union all select series, second, 'runs_stale', second - last_run_epoch > 259200, 600 from samples
      union all select series, second, 'scoring_down', scoring_up = 0, 60 from samples
      union all select series, second, 'platform_down', platform_up = 0, 120 from samples
      union all select series, second, 'drift_unavailable', drift_available = 0, 600 from samples),
    {_states('conditioned', 'series, alert')}
    select series, second, alert, case when not on_ then 'inactive' when second - active_since >= hold then 'firing' else 'pending' end as state from since""",
)
def alert_rules(spark, sf_dir):
    return metrics.all_alerts(_samples(spark, sf_dir), ["series"])


_REQUESTS = """requests as (
  select '/' || event_type as handler, epoch_us(ts) // 1000000 as second, value / 100.0::double as latency,
         case when cast(props->>'$.k' as integer) >= 95 then 500 when cast(props->>'$.k' as integer) >= 85 then 404 else 200 end as status
  from events),
per_minute as (
  select handler, (second // 60) * 60 as minute, count(*) as request_count, count(*) filter (where status >= 500) as error_count
  from requests group by 1, 2)"""


@query("request_rate", f"with {_REQUESTS} select handler, minute, request_count / 60.0::double as rate from per_minute")
def request_rate(spark, sf_dir):
    return metrics.request_rate(st.requests(spark, sf_dir))


@query(
    "error_rate_5xx",
    f"with {_REQUESTS} select handler, minute, (sum(error_count) over (partition by handler order by minute range between 240 preceding and current row))::bigint / 300.0::double as error_rate from per_minute",
)
def error_rate_5xx(spark, sf_dir):
    return metrics.error_rate(st.requests(spark, sf_dir))


def _counters(spark, sf_dir):
    """Counter samples per handler and minute that restart every day."""
    per_minute = metrics.requests_per_minute(st.requests(spark, sf_dir))
    day = Window.partitionBy("handler", F.floor(F.col("minute") / 86400)).orderBy("minute")
    return per_minute.select("handler", "minute", F.sum("request_count").over(day).alias("total"))


@query(
    "counter_rate",
    f"""with {_REQUESTS}, counters as (
      select handler, minute, (sum(request_count) over (partition by handler, minute // 86400 order by minute))::bigint as total from per_minute),
    lagged as (
      select *, lag(total) over (partition by handler order by minute) as before, lag(minute) over (partition by handler order by minute) as at_ from counters),
    grown as (select *, case when total < before then total else total - before end as increase from lagged)
    select handler, minute, total, increase, increase::double / (minute - at_)::double as rate from grown""",
)
def counter_rate(spark, sf_dir):
    return metrics.counter_increase(_counters(spark, sf_dir), ["handler"], "minute", "total")


_HISTOGRAM = f"""{_REQUESTS}, histogram as (
  select handler, 0 as le_no, 0.1::double as le, count(*) filter (where latency <= 0.1) as cumulative from requests group by 1
  union all select handler, 1, 0.5, count(*) filter (where latency <= 0.5) from requests group by 1
  union all select handler, 2, 1.0, count(*) filter (where latency <= 1.0) from requests group by 1
  union all select handler, 3, 'inf'::double, count(*) from requests group by 1)"""


@query("latency_histogram", f"with {_HISTOGRAM} select * from histogram")
def latency_histogram(spark, sf_dir):
    return metrics.latency_histogram(st.requests(spark, sf_dir))


@query(
    "latency_p95_hist",
    f"""with {_HISTOGRAM}, framed as (
      select *, max(cumulative) over (partition by handler) as total, coalesce(lag(cumulative) over w, 0) as below, coalesce(lag(le) over w, 0.0) as lower_
      from histogram window w as (partition by handler order by le_no)),
    hit as (select *, row_number() over (partition by handler order by le_no) as rn from framed where cumulative >= total * 0.95::double)
    select handler, case when isinf(le) then lower_ else lower_ + (le - lower_) * ((total * 0.95::double - below) / (cumulative - below)::double) end as quantile
    from hit where rn = 1""",
)
def latency_p95_hist(spark, sf_dir):
    return metrics.histogram_quantile(metrics.latency_histogram(st.requests(spark, sf_dir)), 0.95)


@query(
    "latency_p95_exact",
    f"with {_REQUESTS} select handler, {Q.rounded('quantile_cont(latency, 0.95)', 9)} as quantile from requests group by 1",
)
def latency_p95_exact(spark, sf_dir):
    exact = metrics.exact_latency(st.requests(spark, sf_dir), 0.95)
    return exact.select("handler", C.rounded(F.col("quantile"), 9).alias("quantile"))
