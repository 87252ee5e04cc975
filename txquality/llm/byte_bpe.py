"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is cut into chunks of ``CHUNK`` characters that overlap by ``OVERLAP``; the chunks of a long text are dealt to all tasks and
pre-tokenised there, each from its own first character on. A chunk begins in the middle of a pre-token, so its first
boundaries may be wrong; but the pattern looks ahead only, so from a place that two chunks both hold for a boundary they agree
on all that follows. The first such place in an overlap is the stitch: the text is cut there, and each piece between two
stitches is encoded on its own, again in parallel. Chunks that do not resynchronise, as in a run of letters longer than the overlap,
are joined and compared with the next one again. Texts of one chunk have nothing to stitch and are encoded where they lie, without a shuffle.

A pre-token is merged pair by pair, the pair of lowest rank first, the leftmost of equal ones, with a heap of pairs, so that a very long
pre-token takes O(n log n) steps. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txquality.llm.common import discard, slices, stored, values_of

CHUNK = 32_768
OVERLAP = 1_024
#: Characters at the end of a chunk in which a boundary may depend on what follows: the pattern looks three characters ahead.
MARGIN = 4
#: Bytes of pre-tokens and ids that a task remembers; the results do not depend on it.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 200
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
ENCODED_SQL = "doc_id bigint, n_tokens bigint, ids binary"
CHUNK_NAMES = ["row", "doc_id", "part", "start", "last", "text", "head", "tail"]
CHUNK_SQL = "row bigint, doc_id bigint, part bigint, start bigint, last boolean, text string, head array<bigint>, tail array<bigint>"
CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder(dict):
    """Ids of text as little-endian unsigned 32-bit integers.

    The dictionary remembers pre-tokens up to half of ``cache_bytes``; when it is full it becomes ``older``, from which those that are
    met again come back, so frequent pre-tokens stay.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, cache_bytes: int = CACHE_BYTES):
        super().__init__()
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.cache_bytes, self.kept_bytes, self.older = cache_bytes, 0, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self.kept_bytes += ENTRY_BYTES + len(piece) + len(ids)
            if 2 * self.kept_bytes > self.cache_bytes:
                self.older = dict(self)
                self.clear()
                self.kept_bytes = 0
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        n = len(raw)
        # parts are linked by where they end and where the part before them begins
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[raw[i : i + 2]], i, i + 2) for i in range(n - 1) if raw[i : i + 2] in ranks]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = stop[i]
            if middle < 0 or middle >= n or stop[middle] != end:
                continue  # one of the two parts has been merged since
            stop[i], stop[middle] = end, -1
            if end < n:
                before[end] = i
                rank = ranks.get(raw[i : stop[end]])
                if rank is not None:
                    heappush(heap, (rank, i, stop[end]))
            if i:
                p = before[i]
                rank = ranks.get(raw[p:end])
                if rank is not None:
                    heappush(heap, (rank, p, end))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[raw[at : stop[at]]])
            at = stop[at]
        return ids

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


def boundaries(text: str, find, first: int, stop: int) -> list[int]:
    """Places in [first, stop) where a pre-token begins, with ``text`` pre-tokenised from its first character on."""
    found = []
    for match in find(text):
        at = match.start()
        if at >= stop:
            break
        if at >= first:
            found.append(at)
    return found


def chunks_of(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of the chunks; each one but the last reaches ``overlap`` characters into the next."""
    starts = range(0, max(1, len(text) - overlap), chunk) if len(text) > chunk else [0]
    return [(at, text[at : at + chunk + overlap] if at != starts[-1] else text[at:]) for at in starts]


def pretokenised(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """``chunks`` (row, doc_id, part, start, last, text, head, tail) with the missing heads and tails.

    They are the boundaries, counted from the start of the text, in the overlap with the chunk before and with the next one.
    """

    def apply(batches):
        find = regex.compile(pattern).finditer
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                heads, tails = values_of(part, "head"), values_of(part, "tail")
                rows = zip(*(values_of(part, c) for c in ("part", "start", "last", "text")))
                for i, (number, start, last, text) in enumerate(rows):
                    if heads[i] is None:
                        heads[i] = [start + x for x in boundaries(text, find, 0, overlap)] if number else []
                    if tails[i] is None:
                        tails[i] = [] if last else [start + x for x in boundaries(text, find, len(text) - overlap, len(text) - MARGIN)]
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], CHUNK_NAMES)

    return chunks.mapInArrow(apply, CHUNK_SQL)


def long_texts(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """The pre-tokenised chunks of texts of more than one chunk; ``row`` tells rows apart that repeat an id."""
    keyed = docs.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())

    def cut(batches):
        for batch in batches:
            rows, keys = values_of(batch, "row"), values_of(batch, "doc_id")
            for i in range(batch.num_rows):
                parts = chunks_of(batch.column(1)[i].as_py(), chunk, overlap)
                n = len(parts)
                for a in range(0, n, 64):
                    some = parts[a : a + 64]
                    last = [a + k == n - 1 for k in range(len(some))]
                    columns = ([rows[i]] * len(some), [keys[i]] * len(some), range(a, a + len(some)), [s for s, _ in some], last, [t for _, t in some])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CUT_TYPES)], CHUNK_NAMES[:6])

    cuts = keyed.select("doc_id", "text", "row").mapInArrow(cut, CHUNK_SQL.split(", head")[0])
    none = F.lit(None).cast("array<bigint>")
    return pretokenised(cuts.repartition("row", "part").withColumns({"head": none, "tail": none}), pattern, overlap)


def stitches(chunks: DataFrame) -> DataFrame:
    """(row, part, next, stitch, begin, piece): where the boundaries of a chunk and the next one resynchronise first.

    The window reads the boundaries in the overlaps only, a bounded number per chunk. ``piece`` counts the stitches before a chunk, so
    chunks without a stitch between them have the same number.
    """
    by_row = Window.partitionBy("row").orderBy("part")
    stitch = F.array_min(F.array_intersect("tail", F.lead("head").over(by_row)))
    met = chunks.select("row", "part", F.lead("start").over(by_row).alias("next"), stitch.alias("stitch"))
    before = F.count("stitch").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    return met.select("*", F.lag("stitch").over(by_row).alias("begin"), before.alias("piece"))


def joined_chunks(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """``chunks`` with those joined into one that have no stitch between them; its boundaries are looked for anew from its start."""
    whole = chunks.join(stitches(chunks).select("row", "part", "next", "stitch", "piece"), ["row", "part"])
    apart = F.col("stitch").isNotNull() | F.col("last")
    own = F.when(apart, F.col("text")).otherwise(F.substring("text", F.lit(1), (F.col("next") - F.col("start")).cast("int")))
    parts = F.array_sort(F.collect_list(F.struct("part", "start", "last", own.alias("text"), "head", "tail")))
    grouped = whole.groupBy("row", "doc_id", "piece").agg(parts.alias("parts")).withColumn("alone", F.size("parts") == 1)
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    tail = F.when(F.col("alone"), last["tail"])
    joined = grouped.select(
        "row", "doc_id", first["part"].alias("part"), first["start"].alias("start"), last["last"].alias("last"), text.alias("text"), first["head"].alias("head"), tail.alias("tail")
    )
    return pretokenised(joined, pattern, overlap)


def stitched(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """(row, doc_id, piece, text): the texts of stored ``chunks``, cut where neighbours resynchronise.

    The boundaries of a chunk are true from its own stitch on. A chunk without one is joined with its predecessor, and the joined chunk is
    compared with the next again, until every chunk has a stitch: a round for each run of such chunks, all documents together.
    """
    while not stitches(chunks).where("stitch is null and next is not null").isEmpty():
        old, chunks = chunks, stored(joined_chunks(chunks, pattern, overlap), "chunks")
        discard(old)
    whole = chunks.join(stitches(chunks).select("row", "part", "begin", "stitch"), ["row", "part"])
    begin = F.coalesce(F.col("begin") - F.col("start"), F.lit(0))
    end = F.coalesce(F.col("stitch") - F.col("start"), F.length("text"))
    return whole.select("row", "doc_id", F.col("part").alias("piece"), F.substring("text", (begin + 1).cast("int"), (end - begin).cast("int")).alias("text"))


def encoded_pieces(pieces: DataFrame, path: str, pattern: str, cache_bytes: int) -> DataFrame:
    """``pieces`` (columns, text) with ``ids`` in place of the text."""
    others = [c for c in pieces.columns if c != "text"]

    def apply(batches):
        encode = Encoder(path, pattern, cache_bytes)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            kept = batch.select(others)
            for a, b in slices(texts):
                ids = [encode(t or "") for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*kept.slice(a, b - a).columns, pa.array(ids, pa.binary())], [*others, "ids"])

    types = dict(pieces.dtypes)
    return pieces.select(*others, "text").mapInArrow(apply, ", ".join(f"{c} {types[c]}" for c in others) + ", ids binary")


def encode(
    docs: DataFrame,
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """(doc_id, n_tokens, ids) per row of ``docs``; ``ids`` are little-endian unsigned 32-bit integers one after another.

    Matches of ``pattern`` are encoded separately by the ranks in the file ``path``, without special tokens. Null and empty texts have no ids. Rows
    are independent: repeated rows give repeated results, a null doc_id stays null, an empty table gives no rows. Only doc_id
    and text are read, so other columns may have any name.
    """
    if not MARGIN < overlap <= chunk:
        raise ValueError("the overlap must be longer than the pattern looks ahead and not longer than a chunk")
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    short = encoded_pieces(narrow.where(F.coalesce(F.length("text") <= chunk, F.lit(True))), path, pattern, cache_bytes)
    chunks = stored(long_texts(narrow, pattern, chunk, overlap), "chunks")
    pieces = encoded_pieces(stitched(chunks, pattern, overlap), path, pattern, cache_bytes)
    whole = pieces.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    long = stored(whole.select("doc_id", joined.alias("ids")), "ids")
    both = short.select("doc_id", "ids").unionByName(long)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``, the bytes of its ids one after another."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def apply(batches):
        ranks = read_ranks(path)
        bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            bytes_of[rank] = token
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for a, b in slices(ids):
                decoded = [b"".join(map(bytes_of.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(decoded, pa.binary())], [*ENCODED.names, "decoded"])

    return encoded.select(*ENCODED.names).mapInArrow(apply, ENCODED_SQL + ", decoded binary")
