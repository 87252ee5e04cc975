"""Reading and writing raw files, tables and logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from txquality import schema as S
from txquality.functions import columns as C
from txquality.session import checkpointed


class RawFiles:
    """Raw transaction files of one load, each read by its own header, whatever the order of its columns, in one scan.

    A first pass counts the lines of every file block and takes the first line of every file, the header; both are one row per
    block. From the headers comes a table with the place of each raw column in each file, and the second pass looks the columns of a
    row up there. Lines may end in LF, CRLF or CR, fields may be quoted, empty lines are skipped; names go by lower case. A file may have
    further columns. ``position`` numbers the rows from 0 in order of path and line.
    """

    def __init__(self, spark: SparkSession, paths: str | list[str]):
        text = spark.read.text([paths] if isinstance(paths, str) else paths)
        self.lines = text.filter(F.trim("value") != "").select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("mid"),
        )
        blocks = self.lines.groupBy("path", "block").agg(
            F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"), F.min_by("value", "mid").alias("line")
        )
        self.blocks = checkpointed(blocks, spark)
        line = F.regexp_replace(F.min_by("line", "block"), "^\ufeff", "")
        heads = self.blocks.groupBy("path").agg(line.alias("line"), F.min("block").alias("block"))
        self.width = heads.agg(F.max(F.size(F.split("line", ",")))).first()[0] or 1
        names = F.transform(self._cells("line"), lambda c: F.lower(F.trim(c)))
        self.headers = heads.select("path", "block", F.filter(names, lambda c: c.isNotNull()).alias("names"))

    def _cells(self, line: str) -> Column:
        """The fields of a line as text, padded with NULL up to the widest header."""
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(self.width)])
        parsed = F.from_csv(line, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
        return F.array(*[parsed[f"c{i}"] for i in range(self.width)])

    def unfit(self) -> DataFrame:
        """(path, missing, repeated) of the files that lack a required column or name one more than once."""
        required = F.array(*[F.lit(c) for c in S.REQUIRED_RAW_COLUMNS])
        repeated = F.filter(required, lambda c: F.size(F.filter("names", lambda n: n == c)) > 1)
        judged = self.headers.select("path", F.array_except(required, "names").alias("missing"), repeated.alias("repeated"))
        return judged.filter((F.size("missing") > 0) | (F.size("repeated") > 0))

    def rows(self) -> DataFrame:
        """(position, path, raw columns in contract order, bad_columns): text that is no number is NULL and its column is listed.

        A column that a file lacks is NULL.
        """
        before = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per file block
        head = F.when(F.col("block") == F.col("head_block"), 1).otherwise(0)
        starts = self.blocks.join(self.headers.withColumnRenamed("block", "head_block"), "path").select("path", "block", "first", "n", "names", head.alias("head"))
        start = F.coalesce(F.sum(F.col("n") - F.col("head")).over(before), F.lit(0))
        places = F.transform(F.array(*[F.lit(c) for c in S.RAW_TYPES]), lambda c: F.array_position("names", c).cast("int"))
        shift, first = start - F.col("first") - F.col("head"), F.col("first") + F.col("head")
        offsets = starts.select("path", "block", shift.alias("shift"), first.alias("from"), places.alias("places"))
        placed = self.lines.join(offsets, ["path", "block"]).filter(F.col("mid") >= F.col("from"))
        cells = placed.select((F.col("mid") + F.col("shift")).alias("position"), "path", "places", self._cells("value").alias("cells"))
        texts = {c: F.get("cells", F.col("places")[i] - 1) for i, c in enumerate(S.RAW_TYPES)}
        named = cells.select("position", "path", *[text.alias(c) for c, text in texts.items()])
        bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in S.RAW_TYPES.items()]))
        return named.select("position", "path", *[F.col(c).try_cast(t).alias(c) for c, t in S.RAW_TYPES.items()], bad.alias("bad_columns"))


def read_raw_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw transaction files as (id, raw columns in contract order); see ``RawFiles``."""
    return RawFiles(spark, paths).rows().select(F.col("position").alias("id"), *S.RAW_TYPES)


def read_or_empty(spark: SparkSession, kind: str, path: str, schema) -> DataFrame:
    """A table that may not have been written yet. Only a missing path counts as empty; other errors are raised."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def typed(df: DataFrame) -> DataFrame:
    """Cast the raw columns to their types; text that is no number becomes NULL instead of failing the job."""
    return df.select(*[F.col(c).try_cast(S.RAW_TYPES[c]).alias(c) if c in S.RAW_TYPES else F.col(c) for c in df.columns])


def with_lineage(df: DataFrame, load_id: str | Column, row_id: str = "id") -> DataFrame:
    """Stamp load id and a row key that is the same whenever the same load is repeated."""
    load = F.lit(load_id) if isinstance(load_id, str) else load_id
    return df.withColumns({"load_id": load, "row_uid": F.sha2(F.concat_ws(":", load, F.col(row_id).cast("string")), 256)})


def replace_table(df: DataFrame, path: str) -> None:
    """Idempotent full load."""
    df.write.mode("overwrite").parquet(path)


def append_load(df: DataFrame, path: str) -> None:
    """Append rows of a load as partitions named after their ``load_id``."""
    df.write.mode("append").partitionBy("load_id").parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def file_fingerprint(df: DataFrame) -> DataFrame:
    """Cheap change mark of the files behind a scan: number, total size and newest modification time."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return files.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("file_size").alias("total_size"),
        F.max("file_modification_time").alias("modified"),
    )


def row_digest(columns: list[str]) -> Column:
    """60-bit number from md5 over the row's text; NULL is told apart from empty text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def checksum(df: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """Content mark that does not depend on row order: count, xor and sum of row digests (a sum sees pairs xor hides)."""
    digested = df.select(*(groups or []), row_digest(columns).alias("_d"))
    aggs = [
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor("_d").alias("digest_xor"),
        F.sum(F.col("_d").cast("decimal(20,0)")).cast("string").alias("digest_sum"),
    ]
    return digested.groupBy(*groups).agg(*aggs) if groups else digested.agg(*aggs)


def last_successful_load(loads: DataFrame) -> DataFrame:
    """One row (load_id, loaded_rows): the newest load with status 0 and the rows of all loads up to it; NULL when there is none."""
    good = F.col("status") == 0
    last = loads.agg(F.max(F.when(good, F.col("inserted_at")))).scalar()
    return loads.filter(F.col("inserted_at") <= last).agg(
        F.max_by("load_id", F.when(good, F.col("inserted_at"))).alias("load_id"), F.sum("row_count").alias("loaded_rows")
    )


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    """A few lines of text as one file."""
    df.select(column).coalesce(1).write.mode("overwrite").text(path)


def log_predictions(scored: DataFrame, path: str, model_version: str, threshold: float) -> None:
    """Append scored rows to the prediction log."""
    append_jsonl(prediction_records(scored, model_version, threshold), path)


def prediction_records(scored: DataFrame, model_version: str, threshold: float) -> DataFrame:
    return scored.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"),
        "amount",
        F.col("probability_fraud").alias("fraud_probability"),
        (F.col("probability_fraud") >= F.lit(threshold)).alias("is_fraud"),
        F.lit(model_version).alias("model_version"),
    )


def rounded_predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """Display form: probability to six places, decision on the full value."""
    p = F.col("probability_fraud")
    return scored.select("*", C.rounded(p, 6).alias("fraud_probability"), (p >= F.lit(threshold)).alias("decision"))
