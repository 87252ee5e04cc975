"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txquality.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """An unused folder name in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/llm-{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "table", release: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives the loss of executors.

    Spark removes the files of the shuffles behind the table once the driver has collected its garbage; ``release`` asks for that
    behind shuffles of whole texts, as a driver with little to do may not collect for long.
    """
    spark = df.sparkSession
    path = new_folder(spark, kind)
    schema = df.schema
    df.write.parquet(path)
    if release:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def appended(tables: Iterator[DataFrame], schema: str, spark: SparkSession, kind: str = "table") -> DataFrame:
    """Tables computed and written one after the other, read as one: the files of the shuffles behind one are removed before the next is computed."""
    path = new_folder(spark, kind)
    spark.createDataFrame([], schema).write.parquet(path)
    for df in tables:
        df.write.mode("append").parquet(path)
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` has returned and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith("llm-"):
                raise ValueError(f"not a stored table: {folder}")
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(modulus: int, doc_id: str = "doc_id"):
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``: the same rows in every run, no row moved."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.xxhash64(F.lit(seed), F.col(key)) % 1_000_000 + 1_000_000 < int(2_000_000 * bound / n))


def runs(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to ``limit`` at most; a larger item stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings, null as empty."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, last) of consecutive rows with about ``limit`` bytes of text together; a longer text stands alone."""
    return runs(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), limit)


def sliced(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text, so that a task turns no more than that into Python strings at a time.

    Behind the last batch the worker gives free memory back to the system, as it may wait long for its next task.
    """
    try:
        for batch in batches:
            for a, b in slices(batch.column(batch.schema.get_field_index(name)), limit):
                yield batch.slice(a, b - a)
    finally:
        give_back()


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later use; without effect where the C library cannot."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class WordCache(dict):
    """What a task remembers of words: ``entries`` at most, in two halves, so that frequent words stay. Results do not depend on it.

    It belongs to the generator of the task that made it and ends with it.
    """

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.half, self.older = make, entries // 2, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


def values_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
