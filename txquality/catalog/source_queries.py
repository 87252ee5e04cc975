"""Sources and sinks: raw files, appended loads, JSON lines, stored marts, columns that are missing or no numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog import sql as Q
from txquality.catalog.registry import query
from txquality.operators import ranks
from txquality.plans import jobs, quality
from txquality.session import shared_dir
from txquality.sources import files, star_tables as st


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lines of a raw file, about.
FILE_ROWS = 100_000


def _write_csv(spark, rows, count, folder, file_rows=FILE_ROWS):
    """Files of lines in order of id, each under a header of its own: four kinds of headers, one for each quarter of the ids.

    A file holds a range of ids with about ``file_rows`` lines, so that no task sorts more than a few files, whatever the number of rows.
    Names of folders are numbers with as many digits each, so that the order of paths is that of ids.
    """
    quarter, buckets = -(-count // 4), ranks.bucket_count(count, file_rows)
    names = [c.capitalize() for c in S.RAW_TYPES]
    orders = [names[7 * k :] + names[: 7 * k] + ["Note"] * (k == 2) for k in range(4)]
    placed = ranks.with_key_buckets(rows, "id", buckets).withColumn("part", F.least(F.floor(F.col("id") / quarter), F.lit(3)).cast("int"))
    texts = placed.where(F.col("part").between(0, 3)).select(
        "part", (10**9 + F.col("part") * buckets + F.col("_bucket")).alias("file"), "id", *[F.col(c).cast("string").alias(c) for c in S.RAW_TYPES]
    )
    line, head = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, order in enumerate(orders):
        cells = [F.lit('"a, b"') if c == "Note" else F.col(c.lower()) for c in order]
        quoted = [F.concat(F.lit('"'), c, F.lit('"')) if k == 1 else c for c in cells]
        line = F.when(F.col("part") == k, F.concat(F.concat_ws(",", *quoted), F.lit("\r" if k == 3 else ""))).otherwise(line)
        head = F.when(F.col("part") == k, F.lit(",".join(f'"{c}"' if k % 2 else c for c in order))).otherwise(head)
    # the header of each file as a text row before its lines; of each kind there is a file, with lines or without
    kinds = spark.createDataFrame([(k, 10**9 + k * buckets) for k in range(4)], "part int, file int")
    heads = texts.select("part", "file").unionByName(kinds).distinct().select("file", F.lit(-1).cast("long").alias("id"), head.alias("line"))
    lines = heads.unionByName(texts.select("file", "id", line.alias("line")))
    lines.repartition(max(4, buckets), "file").sortWithinPartitions("file", "id").select("file", "line").write.partitionBy("file").text(folder)


@query(
    "raw_csv_load",
    f"""with {Q.FULL} select id, time, {", ".join(Q.V)}, amount, class, 'load-csv' as load_id,
      sha256('load-csv:' || cast(id as varchar)) as row_uid from tx""",
)
def raw_csv_load(spark, sf_dir):
    """Transactions written as one folder of CSV files with shuffled headers, quotes, further columns and other line ends, loaded in one scan."""
    rows = st.raw_full(spark, sf_dir).select("id", *S.RAW_TYPES)
    folder = _folder(spark, "csv")
    _write_csv(spark, rows, st.table(spark, sf_dir, "events").count(), folder)
    raw = jobs.load_raw(spark, f"{folder}/file=*", f"{folder}-warehouse", "load-csv")
    return raw.select("id", *S.RAW_TYPES, "load_id", "row_uid")


@query(
    "append_loads",
    f"with {Q.CORE} select load_id, count(*) as row_count, min(amount) as low, max(amount) as high, max(id) as last_id from tx group by 1",
)
def append_loads(spark, sf_dir):
    """Loads of even and odd days appended one after the other and read back with four columns."""
    rows, path = st.raw_core(spark, sf_dir), _folder(spark, "loads")
    odd = F.substring("load_id", -1, 1).cast("int") % 2 == 1
    for part in (~odd, odd):
        files.append_load(rows.filter(part), path)
    loads = files.read_table(spark, path, ["load_id", "id", "amount"])
    return loads.groupBy("load_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.max("id").alias("last_id")
    )


@query(
    "jsonl_round_trip",
    """with log_ as (
      select case when not (event_type = 'signup' and k < 20) then 'run-' || user_id || '-' || cast(cast(ts as date) as varchar) end as run_id,
             strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, trunc(value)::bigint as rows_added,
             case event_type when 'error' then 'failed' when 'purchase' then 'completed' when 'view' then 'running'
                  when 'click' then 'pipeline_running' else 'versioned' end as status, k
      from (select *, cast(props->>'$.k' as integer) as k from events))
    select run_id, timestamp, status, rows_added, k % 4 as stage_count, case when k % 4 > 0 then 'Ingestion' end as first_stage,
           case when k % 4 > 0 then timestamp end as first_start from log_""",
)
def jsonl_round_trip(spark, sf_dir):
    """Run records with nested stages, appended as JSON lines and read back with the record schema."""
    k = F.get_json_object("props", "$.k").cast("int")
    wanted = st.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (k % 4).alias("n"))
    log = st.run_log(spark, sf_dir).join(wanted, "pos")
    names = F.slice(F.array(*[F.lit(s) for s in S.STAGES.values()]), 1, F.col("n"))
    stages = F.transform(
        names, lambda name: F.struct(name.alias("name"), F.col("status"), F.col("timestamp").alias("started_at"), F.lit(None).cast("string").alias("ended_at"))
    )
    path = _folder(spark, "runs")
    known = [c for c in S.RUN_SCHEMA.names if c in log.columns]
    files.append_jsonl(log.select(*known, stages.alias("stages")), path)
    read = files.read_jsonl(spark, path, S.RUN_SCHEMA)
    first = F.get("stages", F.lit(0))
    return read.select(
        "run_id",
        "timestamp",
        "status",
        "rows_added",
        F.size("stages").alias("stage_count"),
        first["name"].alias("first_stage"),
        first["started_at"].alias("first_start"),
    )


@query(
    "built_marts",
    f"""with {Q.CORE}, {Q.FEATS}
      select 'fct_transactions_clean' as model, count(*) as row_count, sum(class)::bigint as fraud from tx where amount >= 0
      union all select 'fct_transactions_features', count(*), sum(is_fraud)::bigint from feats
      union all select 'agg_fraud_hourly_summary', count(distinct hour_of_day), sum(is_fraud)::bigint from feats""",
)
def built_marts(spark, sf_dir):
    """Views and tables of the marts, materialised in order and read back."""
    models = jobs.build_marts(spark, st.raw_full(spark, sf_dir), _folder(spark, "marts"))
    out = None
    for name, fraud in (("fct_transactions_clean", "is_fraud"), ("fct_transactions_features", "is_fraud"), ("agg_fraud_hourly_summary", "nb_fraud")):
        row = models[name].agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("row_count"), F.sum(fraud).alias("fraud"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "bad_text_rows",
    "with t as (select event_id as id, cast(props->>'$.k' as integer) as k, value from events) "
    "select id, case when k % 10 <> 0 then value end as amount, case when k % 7 <> 0 then (k % 2)::bigint end as class from t",
)
def bad_text_rows(spark, sf_dir):
    """Text that is no number becomes NULL; quoted and padded numbers are read."""
    k = F.get_json_object("props", "$.k").cast("int")
    amount = F.when(k % 10 != 0, F.col("value").cast("string")).otherwise(F.concat(F.lit("x"), F.col("value").cast("string")))
    label = F.when(k % 7 != 0, F.concat(F.lit(" "), (k % 2).cast("string"))).otherwise(F.lit("1;"))
    text = st.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), amount.alias("amount"), label.alias("class"))
    return files.typed(text)


@query(
    "schema_missing_columns",
    f"""with {Q.CORE}, n as (select count(*) as row_count, count(*) filter (where amount is null) as no_amount,
      count(*) filter (where amount < 0) as negative from tx),
    checks as (
      select row_count, 1 as check_no, 'required_columns' as check_name, 29::bigint as failures from n
      union all select row_count, 2, 'null_amount', no_amount from n
      union all select row_count, 3, 'null_class', 0 from n
      union all select row_count, 4, 'class_domain', 0 from n
      union all select row_count, 5, 'negative_amount', negative from n)
    select *, case when failures = 0 then 'pass' else 'fail' end as status from checks""",
)
def schema_missing_columns(spark, sf_dir):
    """Gate over a raw table without the label and the 28 components."""
    return quality.gate_report(st.raw_core(spark, sf_dir).drop("class"))
