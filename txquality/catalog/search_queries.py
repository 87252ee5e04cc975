"""Pages, look-ups, export, loads and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog import sql as Q
from txquality.catalog.registry import query
from txquality.functions import columns as C
from txquality.plans import search
from txquality.sources import files, star_tables as st

_COLS = "id, time, amount, class as is_fraud"


def _tx(spark, sf_dir):
    return st.raw_core(spark, sf_dir).select("id", "time", "amount", F.col("class").alias("is_fraud"))


_TX = f"{Q.CORE}, t as (select {_COLS} from tx)"
_LIMITS = {"amount": search.Between(5.0, 200.0), "time": search.Between(86400.0, 86400.0 * 25 - 1)}
_WHERE = "amount >= 5 and amount <= 200 and time >= 86400 and time <= 2159999"


@query("search_page", f"with {_TX} select * from t where {_WHERE} order by amount desc, id limit 50 offset 100")
def search_page(spark, sf_dir):
    return search.page(_tx(spark, sf_dir), 3, 50, "amount", "desc", limits=_LIMITS)


@query("search_page_fraud", f"with {_TX} select * from t where is_fraud = 1 order by time, id limit 1000")
def search_page_fraud(spark, sf_dir):
    return search.page(_tx(spark, sf_dir), 1, 1000, "time", "asc", limits={"is_fraud": search.Between(1, 1)})


def _deep(order_by: str) -> str:
    return f"""with {_TX}, placed as (
      select *, row_number() over (order by {order_by}) - 1 as place, count(*) over () // 100 * 50 as half from t)
    select * exclude (place, half) from placed where place >= half and place < half + 50"""


def _half_way(spark, sf_dir, sort, order):
    rows = _tx(spark, sf_dir)
    return search.deep_page(rows, search.total(rows).first()[0] // 100 + 1, 50, sort, order)


@query("search_page_deep", _deep("amount desc nulls last, id"))
def search_page_deep(spark, sf_dir):
    """The page at half the table, largest amounts first."""
    return _half_way(spark, sf_dir, "amount", "desc")


@query("search_page_deep_ties", _deep("is_fraud nulls last, id"))
def search_page_deep_ties(spark, sf_dir):
    """The page at half the table in the order of the label: the offset lies among rows that share one value."""
    return _half_way(spark, sf_dir, "is_fraud", "asc")


@query("search_page_components", f"with {Q.FULL} select id, time, {', '.join(Q.V)}, amount, class as is_fraud from tx order by v1 desc, id limit 100 offset 100")
def search_page_components(spark, sf_dir):
    rows = st.raw_full(spark, sf_dir).withColumnRenamed("class", "is_fraud").select(*S.SORTABLE_COLUMNS)
    return search.page(rows, 2, 100, "v1", "desc")


@query("search_page_after", f"with {_TX} select * from t where {_WHERE} order by amount desc, id limit 50 offset 100")
def search_page_after(spark, sf_dir):
    """Third page again, reached from the last row of the second."""
    rows = _tx(spark, sf_dir)
    last = search.page(rows, 2, 50, "amount", "desc", limits=_LIMITS).collect()[-1]  # one page
    return search.page_after(rows, last["amount"], last["id"], 50, "amount", "desc", limits=_LIMITS)


@query("search_total", f"with {_TX} select count(*) as total from t where {_WHERE}")
def search_total(spark, sf_dir):
    return search.total(_tx(spark, sf_dir), limits=_LIMITS)


@query(
    "page_info",
    f"with {_TX}, c as (select count(*) as total from t where {_WHERE}) select total, 3 as page, 50 as page_size, "
    "greatest(1, ceil(total / 50.0))::bigint as page_count, 101 as first_row, least(150, total) as last_row from c",
)
def page_info(spark, sf_dir):
    return search.page_info(_tx(spark, sf_dir), 3, 50, limits=_LIMITS)


@query("lookup", f"with {_TX} select * from t where id = 123")
def lookup(spark, sf_dir):
    return search.lookup(_tx(spark, sf_dir), 123)


@query(
    "day_filter",
    f"with {_TX} select * from t where time >= 3 * 86400 and time <= 6 * 86400 - 1",
)
def day_filter(spark, sf_dir):
    return _tx(spark, sf_dir).filter(C.day_range(F.col("time"), 4, 6))


@query(
    "export_selection",
    f"with {_TX}, ids as (select id from t where {_WHERE} order by amount desc, id limit 50 offset 100) "
    "select id as transaction_id, time, amount, is_fraud from t where id in (select id from ids)",
)
def export_selection(spark, sf_dir):
    """Export of the rows selected on one page."""
    rows = _tx(spark, sf_dir)
    return search.selection(rows, search.page(rows, 3, 50, "amount", "desc", limits=_LIMITS).select("id"))


_LOADS = f"""loads as (
  select {Q.LOAD} as load_id, case when bool_or(event_type = 'error' and cast(props->>'$.k' as integer) = 99) then 1 else 0 end as status,
         max(epoch_us(ts)) as inserted_at, count(*) as row_count from events group by 1),
last_load as (select arg_max(load_id, inserted_at) filter (where status = 0) as load_id from loads)"""


def _loads(spark, sf_dir):
    """Load log: one load per day; a load with a fatal error (k = 99) has status 1."""
    events = st.table(spark, sf_dir, "events")
    fatal = (F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("int") == 99)
    return events.groupBy(st.load_of(F.col("ts")).alias("load_id")).agg(
        F.max(fatal.cast("int")).alias("status"),
        F.max(C.micros(F.col("ts"))).alias("inserted_at"),
        F.count(F.lit(1)).alias("row_count"),
    )


def _last_load(spark, sf_dir):
    return files.last_successful_load(_loads(spark, sf_dir))


_LAST = f"""{_LOADS}, counted as (
  select l.load_id, (select sum(row_count)::bigint from loads where inserted_at <= l.inserted_at) as loaded_rows
  from loads l where l.load_id = (select load_id from last_load))"""


@query("load_log", f"with {_LOADS} select * from loads")
def load_log(spark, sf_dir):
    return _loads(spark, sf_dir)


@query("last_load", f"with {_LAST} select load_id, loaded_rows from counted")
def last_load(spark, sf_dir):
    return _last_load(spark, sf_dir)


@query(
    "load_attach",
    f"with {_TX}, {_LAST} select id, amount, case when id < loaded_rows then load_id end as load_id from t, counted",
)
def load_attach(spark, sf_dir):
    rows = _tx(spark, sf_dir).select("id", "amount")
    return search.attach_load(rows, _last_load(spark, sf_dir))


_DIGEST = "('0x' || substr(md5(cast(event_id as varchar) || '|' || event_type || '|' || coalesce(props, '\\N')), 1, 15))::bigint"


@query(
    "dataset_checksum",
    f"select count(*) as row_count, bit_xor({_DIGEST}) as digest_xor, cast(sum({_DIGEST}::hugeint) as varchar) as digest_sum from events",
)
def dataset_checksum(spark, sf_dir):
    return files.checksum(st.table(spark, sf_dir, "events"), ["event_id", "event_type", "props"])


@query(
    "load_checksums",
    f"select {Q.LOAD} as load_id, count(*) as row_count, bit_xor({_DIGEST}) as digest_xor, cast(sum({_DIGEST}::hugeint) as varchar) as digest_sum from events group by 1",
)
def load_checksums(spark, sf_dir):
    events = st.table(spark, sf_dir, "events").withColumn("load_id", st.load_of(F.col("ts")))
    return files.checksum(events, ["event_id", "event_type", "props"], ["load_id"])


_SKEW = f"""{_TX}, training as (select id, {Q.HOUR} as h, ln(amount + 1) as l from t),
serving as (
  select event_id as id, hour(ts) as h, ln(value + 1) as l from events)"""


@query(
    "skew_check",
    f"""with {_SKEW} select count(*) as row_count, count(*) filter (where t.id is null or s.id is null) as unmatched,
      count(*) filter (where t.h <> s.h) as hour_differs, count(*) filter (where abs(t.l - s.l) > 1e-9) as log_differs
    from training t full outer join serving s on t.id = s.id""",
)
def skew_check(spark, sf_dir):
    """Training features against serving features of the same rows; here the serving side takes the calendar hour."""
    training = _tx(spark, sf_dir).select(
        "id", C.hour_of_day(F.col("time")).alias("h"), C.log_amount(F.col("amount")).alias("l"), F.lit(True).alias("in_training")
    )
    serving = st.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.hour("ts").alias("h2"),
        C.log_amount(F.col("value")).alias("l2"),
        F.lit(True).alias("in_serving"),
    )
    return training.join(serving, "id", "full_outer").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("in_training").isNull() | F.col("in_serving").isNull()).alias("unmatched"),
        F.count_if(F.col("h") != F.col("h2")).alias("hour_differs"),
        F.count_if(F.abs(F.col("l") - F.col("l2")) > 1e-9).alias("log_differs"),
    )
