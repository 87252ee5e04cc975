"""Quantile edges, stability index, distributions, history and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog import sql as Q
from txquality.catalog.registry import query
from txquality.functions import columns as C
from txquality.operators import psi
from txquality.plans import drift
from txquality.sources import star_tables as st

NEW_DATA_CUT = 20.0 * S.SECONDS_PER_DAY


def _rows(spark, sf_dir):
    raw = st.raw_core(spark, sf_dir, st.clock_start(spark, sf_dir))
    return raw.select(F.col("time").alias("time_seconds"), "amount", "load_id")


_LEVELS = ", ".join(f"({i}, '{p!r}'::double)" for i, p in enumerate(psi.quantile_levels()))
_BASE = f"""{Q.CORE}, base as (
  select id, load_id, time, amount, ln(amount + 1) as log_amount, {Q.HOUR}::double as hour_of_day from tx)"""


def _long(name: str, where: str, extra: str = "") -> str:
    parts = " union all ".join(
        f"select {extra}'{c}' as feature, {c}::double as v from base where {where}" for c in S.MONITORED
    )
    return f"{name} as ({parts})"


def _edges(where: str) -> str:
    return f"""{_long('ref', where)},
levels(i, q) as (values {_LEVELS}),
ref_ranked as (select feature, v, row_number() over (partition by feature order by v) - 1 as rn from ref),
ref_n as (select feature, count(*) as n from ref group by 1),
positions as (
  select feature, i, n, floor((n - 1) * q)::bigint as lo, least(floor((n - 1) * q)::bigint + 1, n - 1) as hi,
         (n - 1) * q - floor((n - 1) * q) as t from ref_n, levels),
raw_edges as (
  select p.feature, p.i, case when t < 0.5 then a.v + (b.v - a.v) * t else b.v - (b.v - a.v) * (1 - t) end as edge
  from positions p join ref_ranked a on a.feature = p.feature and a.rn = p.lo
                   join ref_ranked b on b.feature = p.feature and b.rn = p.hi),
edges as (
  select feature, edge, row_number() over (partition by feature order by edge) - 1 as edge_no,
         count(*) over (partition by feature) as edge_count
  from (select distinct feature, edge from raw_edges)),
inner_edges as (select * from edges where edge_no > 0 and edge_no < edge_count - 1 and edge_count >= 3),
bins as (select feature, edge_no as bin, edge_count from edges where edge_no < edge_count - 1 and edge_count >= 3)"""


def _binned(name: str, source: str, keys: str = "") -> str:
    keyed = f"{keys}, " if keys else ""
    return f"""{name}_b as (
  select {keyed}feature, v, (select count(*) from inner_edges e where e.feature = s.feature and e.edge <= s.v) as bin from {source} s),
{name}_n as (select {keyed}feature, bin, count(*) as n from {name}_b group by all),
{name}_total as (select {keyed}feature, sum(n)::bigint as total from {name}_n group by all)"""


def _compared(recent_where: str, reference_where: str) -> str:
    return f"""{_BASE}, med as (select median(time) as cut from tx), {_edges(reference_where)},
{_long('cur', recent_where)}, {_binned('r', 'ref')}, {_binned('c', 'cur')},
both_sides as (
  select b.feature, b.bin, coalesce(r_n.n, 0)::double / r_total.total as reference, coalesce(c_n.n, 0)::double / c_total.total as recent
  from bins b join r_total on r_total.feature = b.feature join c_total on c_total.feature = b.feature
  left join r_n on r_n.feature = b.feature and r_n.bin = b.bin left join c_n on c_n.feature = b.feature and c_n.bin = b.bin),
indexes as (
  select feature, sum((greatest(recent, 1e-6) - greatest(reference, 1e-6)) * ln(greatest(recent, 1e-6) / greatest(reference, 1e-6))) as psi
  from both_sides group by 1)"""


_HALF_REF, _HALF_CUR = "time < (select cut from med)", "time >= (select cut from med)"
_HALVES = _compared(_HALF_CUR, _HALF_REF)
_NEW = _compared(f"time > {NEW_DATA_CUT}", f"time <= {NEW_DATA_CUT}")
_LEVEL = "case when psi < 0.10 then 'green' when psi < 0.25 then 'orange' else 'red' end"
_VERDICT = (
    f"case when psi < 0.10 then '{S.PSI_VERDICTS['green']}' when psi < 0.25 then '{S.PSI_VERDICTS['orange']}' "
    f"else '{S.PSI_VERDICTS['red']}' end"
)
_PSI9 = Q.rounded("psi", 9)


def _psi9(df):
    return df.withColumn("psi", C.rounded(F.col("psi"), 9))


@query(
    "quantile_edges",
    f"with {_BASE}, med as (select median(time) as cut from tx), {_edges(_HALF_REF)} "
    f"select feature, edge_no, {Q.rounded('edge', 9)} as edge from edges",
)
def quantile_edges(spark, sf_dir):
    sides = drift.split_sides(drift.drift_features(_rows(spark, sf_dir)))
    edges = psi.distinct_quantiles(sides.reference, S.MONITORED)
    rows = [(c, i, e) for c, values in edges.items() for i, e in enumerate(values)]
    table = spark.createDataFrame(rows, "feature string, edge_no long, edge double")
    return table.withColumn("edge", C.rounded(F.col("edge"), 9))


@query("median_time", f"with {Q.CORE} select {Q.rounded('median(time)', 6)} as median_time, count(*) as row_count from tx")
def median_time(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    cut = drift.split_sides(rows).cut
    return rows.agg(C.rounded(F.lit(cut), 6).alias("median_time"), F.count(F.lit(1)).alias("row_count"))


@query(
    "psi_halves",
    f"with {_HALVES} select feature, {_PSI9} as psi, {_LEVEL} as level, {_VERDICT} as verdict, 'halves' as mode from indexes",
)
def psi_halves(spark, sf_dir):
    return _psi9(drift.drift_by_feature(_rows(spark, sf_dir))).drop("reference_rows", "recent_rows")


@query(
    "psi_new_data",
    f"with {_NEW} select feature, {_PSI9} as psi, {_LEVEL} as level, {_VERDICT} as verdict, 'new_data' as mode from indexes",
)
def psi_new_data(spark, sf_dir):
    indexes = drift.drift_by_feature(_rows(spark, sf_dir), new_data_after=NEW_DATA_CUT)
    return _psi9(indexes).drop("reference_rows", "recent_rows")


@query("drift_distribution", f"with {_HALVES} select feature, bin, reference, recent from both_sides")
def drift_distribution(spark, sf_dir):
    """Bucket labels use short number formatting that SQL lacks; the tests check them."""
    table = drift.distribution(_rows(spark, sf_dir))
    return table.select("feature", F.col("bin").cast("long").alias("bin"), "reference", "recent")


def _summary_sql(body: str, mode: str, ref: str, cur: str) -> str:
    per = ", ".join(f"{Q.rounded(f'max(psi) filter (where feature = {c!r})', 9)} as psi_{c}" for c in S.MONITORED)
    return f"""with {body} select '{mode}' as mode, (select count(*) from base where {ref}) as reference_rows,
      (select count(*) from base where {cur}) as recent_rows, {Q.rounded('max(psi)', 9)} as max_psi, 0.25::double as psi_threshold,
      max(psi) >= 0.25 as alert, {per} from indexes"""


def _summary9(df):
    return df.withColumns({c: C.rounded(F.col(c), 9) for c in ["max_psi", *[f"psi_{m}" for m in S.MONITORED]]})


@query("drift_summary", _summary_sql(_HALVES, "halves", _HALF_REF, _HALF_CUR))
def drift_summary(spark, sf_dir):
    return _summary9(drift.summary(_rows(spark, sf_dir)))


@query(
    "drift_summary_new_data",
    _summary_sql(_NEW, "new_data", f"time <= {NEW_DATA_CUT}", f"time > {NEW_DATA_CUT}"),
)
def drift_summary_new_data(spark, sf_dir):
    return _summary9(drift.summary(_rows(spark, sf_dir), new_data_after=NEW_DATA_CUT))


@query(
    "live_psi",
    f"""with {_BASE}, med as (select median(time) as cut from tx), {_edges(_HALF_REF)},
    live as (select 'amount' as feature, l_extendedprice / 200.0::double as v from lineitem),
    ref_amount as (select * from ref where feature = 'amount'), {_binned('r', 'ref_amount')}, {_binned('c', 'live')},
    both_sides as (
      select b.feature, b.bin, coalesce(r_n.n, 0)::double / r_total.total as reference, coalesce(c_n.n, 0)::double / c_total.total as recent
      from bins b join r_total on r_total.feature = b.feature join c_total on c_total.feature = b.feature
      left join r_n on r_n.feature = b.feature and r_n.bin = b.bin left join c_n on c_n.feature = b.feature and c_n.bin = b.bin),
    indexes as (
      select feature, sum((greatest(recent, 1e-6) - greatest(reference, 1e-6)) * ln(greatest(recent, 1e-6) / greatest(reference, 1e-6))) as psi
      from both_sides group by 1)
    select feature, {_PSI9} as psi, {_LEVEL} as level, {_VERDICT} as verdict, (select count(*) from live) as recent_rows from indexes""",
)
def live_psi(spark, sf_dir):
    live = st.table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / F.lit(200.0)).alias("amount"))
    return _psi9(drift.live_drift(_rows(spark, sf_dir), live)).drop("reference_rows")


_BY_LOAD = f"""{_BASE}, med as (select median(time) as cut from tx), {_edges(_HALF_REF)},
{_long('cur', 'true', 'load_id, ')}, {_binned('r', 'ref')}, {_binned('c', 'cur', 'load_id')},
both_sides as (
  select c_total.load_id, b.feature, b.bin, coalesce(r_n.n, 0)::double / r_total.total as reference,
         coalesce(c_n.n, 0)::double / c_total.total as recent
  from bins b join r_total on r_total.feature = b.feature join c_total on c_total.feature = b.feature
  left join r_n on r_n.feature = b.feature and r_n.bin = b.bin
  left join c_n on c_n.feature = b.feature and c_n.bin = b.bin and c_n.load_id = c_total.load_id),
indexes as (
  select load_id, feature, sum((greatest(recent, 1e-6) - greatest(reference, 1e-6)) * ln(greatest(recent, 1e-6) / greatest(reference, 1e-6))) as psi
  from both_sides group by 1, 2)"""


@query(
    "drift_by_load",
    f"with {_BY_LOAD} select load_id, {Q.rounded('max(psi)', 9)} as max_psi, "
    + ", ".join(f"{Q.rounded(f'max(psi) filter (where feature = {c!r})', 9)} as psi_{c}" for c in S.MONITORED)
    + " from indexes group by 1",
)
def drift_by_load(spark, sf_dir):
    return _summary9(drift.drift_by_group(_rows(spark, sf_dir), ["load_id"]))


@query(
    "retrain_decision",
    f"""with {_BY_LOAD}, busy as (
      select {Q.LOAD} as load_id, arg_max(event_type, event_id) in ('view', 'click') as busy from events group by 1),
    loads as (select load_id, max(psi) as psi from indexes group by 1)
    select l.load_id, {Q.rounded('psi', 9)} as max_psi, busy, psi >= 0.25 and not busy as retrain
    from loads l join busy b on l.load_id = b.load_id""",
)
def retrain_decision(spark, sf_dir):
    """Retrain after a load whose index reaches the threshold, unless the last run of that day is still running."""
    log = st.table(spark, sf_dir, "events").groupBy(st.load_of(F.col("ts")).alias("load_id")).agg(
        F.max_by("event_type", "event_id").isin("view", "click").alias("busy")
    )
    loads = drift.drift_by_group(_rows(spark, sf_dir), ["load_id"]).join(log, "load_id")
    decision = drift.retrain_rule(F.col("max_psi"), S.PSI_HIGH, True, F.col("busy"))
    return loads.select("load_id", C.rounded(F.col("max_psi"), 9).alias("max_psi"), "busy", decision.alias("retrain"))


_CHECKS = f"""checks as (
  select event_id, event_type as source, {Q.LOAD} || ':' || cast(cast(props->>'$.k' as integer) // 50 as varchar) as fingerprint
  from events)"""


@query(
    "drift_history",
    f"""with {_CHECKS}, lagged as (select *, lag(fingerprint) over (order by event_id) as before from checks)
    select event_id, source, fingerprint from lagged where before is distinct from fingerprint""",
)
def drift_history(spark, sf_dir):
    events = st.table(spark, sf_dir, "events")
    half = F.floor(F.get_json_object("props", "$.k").cast("int") / F.lit(50)).cast("string")
    checks = events.select(
        "event_id", F.col("event_type").alias("source"), F.concat_ws(":", st.load_of(F.col("ts")), half).alias("fingerprint")
    )
    return drift.history(checks, "fingerprint", "event_id")


@query(
    "drift_report",
    f"""with {_HALVES}, counts as (
      select (select count(*) from base where {_HALF_REF}) as a, (select count(*) from base where {_HALF_CUR}) as b)
    select 0 as line_no, '# Drift report' as line union all select 1, ''
    union all select 2, 'Mode halves: ' || a || ' reference rows, ' || b || ' recent rows.' from counts
    union all select 3, '' union all select 4, '| Column | PSI | Verdict |' union all select 5, '|---|---|---|'
    union all select case feature when 'amount' then 6 when 'log_amount' then 7 else 8 end,
      '| ' || feature || ' | ' || printf('%.4f', psi) || ' | ' || {_VERDICT} || ' |' from indexes""",
)
def drift_report(spark, sf_dir):
    return drift.report_lines(drift.drift_by_feature(_rows(spark, sf_dir)))
