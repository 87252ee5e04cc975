"""WARC archives with an index of captures that is merged externally.

Writing: every task sorts its records by URL key and timestamp and writes them as WARC files (text writer with the record end as
separator, so any store that Spark reaches will do); equal payloads are kept once, later ones become revisit records. Reading: files are
read back, records are framed by their Content-Length and digests are recomputed from the payloads.

Index: each archive file gives one locally sorted run of captures. Runs are dealt out by ranges of (URL key, timestamp,
page), each range is merged from its runs by a loser tree, and the ranges in order are the capture histories in global order.
The runs of a range reach its task one after another, each sorted by Spark; the task keeps them as Arrow batches and turns
``MERGE_ROWS`` rows of a run at a time into Python values. A hot URL or host is split by timestamp and page, as these belong to the range key.
"""

from __future__ import annotations

import gzip
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txquality.llm.common import batch_of, new_folder, stored, values_of

MIN_PAYLOAD = 1000  # bytes from which equal payloads are kept once
FILE_BYTES = 32 << 20  # payload bytes of an archive file, about
RANGE_ROWS = 200_000  # captures of a range of the merge, about
MERGE_ROWS = 64  # rows of a run that the merge has unpacked
LAST_SECOND = 253402300799  # the end of the year 9999
EPOCH = 1577836800  # 2020-01-01: dates of pages that bring none
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SQL = (
    "run string, position bigint, page_id bigint, url string, url_key string, captured bigint, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, digest_ok boolean"
)
RECORDS = pa.schema(
    [("run", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("url_key", pa.string()), ("captured", pa.int64()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())]
)


def url_key(url) -> F.Column:
    """Sortable key: host labels in reverse order, then path and query, lower case."""
    rest = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?s)(?:[^/?#]*://)?(.*)$", 1)
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    tail = F.regexp_extract(rest, "(?s)^[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), tail)


def classified(pages: DataFrame, captured: str | None = None) -> DataFrame:
    """(page_id, url, captured, payload, payload_bytes, payload_digest, record_type, refers_to).

    Of records with equal payloads of MIN_PAYLOAD bytes or more the one with the largest page_id is the response and others
    revisit it; rows that repeat that page_id are all responses. A null page_id is never a response of others. ``captured`` names a column with the seconds since
    1970 in UTC; without one, and where its value is null, no number or not within the years 1970 to 9999, the time follows from the page_id.
    Other columns of ``pages`` are not read, whatever their names.
    """
    default = F.lit(EPOCH) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0))
    given = F.lit(None).cast("bigint") if captured is None else F.col(captured).try_cast("bigint")
    when = F.coalesce(F.when(given.between(0, LAST_SECOND), given), default)
    base = pages.select("page_id", "url", when.alias("captured"), F.coalesce("html", F.lit("")).alias("payload"))
    raw = F.encode("payload", "UTF-8")
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1(raw)})
    big = base.where(F.col("payload_bytes") >= MIN_PAYLOAD).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    owners = stored(big.where("n > 1 and keeper is not null").select("payload_digest", "keeper"), "owners")
    joined = base.join(owners, "payload_digest", "left")
    again = F.col("keeper").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False))
    return joined.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("keeper"))}).drop("keeper")


def utc_text(seconds) -> F.Column:
    """Seconds since 1970 as a WARC date, whatever the time zone of the session."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86_400))
    clock = [F.lpad(F.floor(rest / size % limit).cast("string"), 2, "0") for size, limit in ((3600, 24), (60, 60), (1, 60))]
    return F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))


def record_text() -> F.Column:
    """One record without its end mark. Line breaks in the url are percent-encoded."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    date = utc_text(F.col("captured"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: " + REVISIT_PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, captured: str | None = None) -> str:
    """Write one record per row of ``pages`` into gzip-compressed WARC files under ``folder``; records of a file are sorted.

    Null html is an empty payload, a null url an empty target. An empty table writes an empty archive.
    """
    records = classified(pages, captured)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    dealt = records.withColumn("key", url_key(F.col("url"))).repartition(files, F.xxhash64("page_id", "url", "payload_digest"))
    runs = dealt.sortWithinPartitions("key", "captured", "page_id").select(record_text().alias("value"))
    runs.write.option("lineSep", END).option("compression", "gzip").text(folder)
    return folder


def parsed(content: bytes):
    """(headers, block) of each record of a WARC file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in content[at:end].decode("utf-8").split("\r\n")[1:])
        size = int(headers["Content-Length"])
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def urn_number(text: str | None) -> int | None:
    number = text[len("<urn:page:") : -1] if text else ""
    return int(number) if number else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, in the order of the files: run (file), position, page_id, url, url_key (as written), captured, record_type,
    refers_to, payload_bytes and payload_digest of the full payload, digest_ok (recomputed and equal; null for revisits)."""
    from datetime import datetime, timezone

    def records(batches):
        for batch in batches:
            for path, content in zip(values_of(batch, "path"), values_of(batch, "content")):
                out: dict[str, list] = {f.name: [] for f in RECORDS}
                for position, (headers, block) in enumerate(parsed(gzip.decompress(content))):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rsplit(b"Content-Length: ", 1)[1])
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    date = datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
                    row = (
                        path.rsplit("/", 1)[1], position, urn_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], None, int(date.timestamp()), kind,
                        urn_number(headers.get("WARC-Refers-To")), size, digest, None if kind == "revisit" else hashlib.sha1(payload).hexdigest() == digest and len(payload) == size,
                    )
                    for name, value in zip(out, row):
                        out[name].append(value)
                yield batch_of(RECORDS, **out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(records, RECORD_SQL).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """k-way merge of sorted iterators: inner nodes keep the loser of their match, so each output costs one path of matches."""

    def __init__(self, streams: list):
        self.streams = [iter(s) for s in streams]
        self.k = max(1, len(self.streams))
        self.heads = [self._next(i) for i in range(len(self.streams))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        return next(self.streams[i], None)

    def _before(self, i: int, j: int) -> bool:
        """Whether stream i goes first; ended streams lose, ties go to the lower number."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self.heads[i] = self._next(i)
            self._replay(i)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i


ORDER = ("url_key", "captured", "page_id", "run", "position")


def merged(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures of all runs in global order of (url_key, captured, page_id): partitions hold ascending ranges, merged from their runs.

    ``range`` numbers the ranges and ``place`` the captures of a range, so (range, place) is the order. Null page_ids come first.
    """
    ranges = max(1, -(-captures.count() // range_rows))
    dealt = captures.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "position").withColumn("range", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions("run", "url_key", "captured", "page_id", "position")
    schema = RECORDS.append(pa.field("range", pa.int32())).append(pa.field("place", pa.int64()))
    names = [f.name for f in schema][:-1]
    at = [names.index(n) for n in ORDER]

    def stream(parts):
        """(key, row) of a run; no more than MERGE_ROWS rows are unpacked."""
        for part in parts:
            for first in range(0, part.num_rows, MERGE_ROWS):
                few = part.slice(first, MERGE_ROWS)
                for row in zip(*[values_of(few, n) for n in names]):
                    yield tuple((row[i] is not None, row[i]) if row[i] is not None else (False, 0) for i in at), row

    def merge(batches):
        own: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            run = batch.column(0).dictionary_encode()
            codes = run.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    own.setdefault(run[a].as_py(), []).append(batch.slice(a, b - a))
        out: list[tuple] = []
        for place, (_, row) in enumerate(LoserTree([stream(parts) for parts in own.values()]) if own else []):
            out.append((*row, place))
            if len(out) == 8192:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return dealt.mapInArrow(merge, RECORD_SQL + ", range int, place bigint")


def histories(captures: DataFrame) -> DataFrame:
    """(url_key, captures, first_captured, last_captured, versions): one row per URL key of the merged index."""
    return captures.groupBy("url_key").agg(
        F.count("*").alias("captures"), F.min("captured").alias("first_captured"), F.max("captured").alias("last_captured"), F.count_distinct("payload_digest").alias("versions")
    )


def archive(pages: DataFrame, folder: str | None = None, captured: str | None = None) -> DataFrame:
    """Write ``pages`` to an archive, read it back and return its captures in the merged global order."""
    spark = pages.sparkSession
    folder = write(pages, folder or new_folder(spark, "warc"), captured=captured)
    return merged(stored(read(spark, folder), "captures"))
