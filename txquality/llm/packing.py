"""Packing of tokenised documents into windows by best-fit decreasing.

Documents are tokenised where they lie. A document that is not shorter than the window is first cut into full windows, which are sequences
of their own and go through no search and no shuffle. What is left of each document, one piece at most, goes to a shard by a hash, and every
shard packs its remainders by best-fit decreasing: longest first, each into the open window with the least room that still holds it. Open windows are kept as
stacks by room, and a segment tree over the rooms 1..window answers "the least room >= length that has a window" in
logarithmic time. Shards hold about ``shard_pieces`` remainders whatever the size of the corpus, so the padding lost at
the end of a shard stays a small constant part and no task grows with the input.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from txquality.llm.common import WordCache, batch_of, sliced, stored, texts_of, values_of

END_ID = 2
WINDOW = 4096
CACHE_WORDS = 240_000
#: Characters for which splitting by the pattern below is the tokenizer's own; others go through the library whole.
UNUSUAL = re.compile("[^\t\n\v\f\r -~\u00a0-\u024f]|[\u00b2\u00b3\u00b9\u00bc-\u00be\u00b5\u0130\u0149\u01f0]")
#: The usual ones among the first 256, for a check that costs less than the pattern.
USUAL_BYTES = bytes(b for b in range(256) if not UNUSUAL.match(chr(b)))
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

PIECE_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
)
PIECE_SQL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def unusual(text: str) -> bool:
    """Whether ``UNUSUAL`` finds a character."""
    try:
        return len(text.encode("latin-1").translate(None, USUAL_BYTES)) > 0
    except UnicodeEncodeError:
        return UNUSUAL.search(text) is not None


class WordTokenizer:
    """Ids of a text as bytes (little-endian unsigned 32-bit). Ids of words seen before are kept, a bounded number of them.

    The vocabulary splits a text at white space and further into words before it merges, so the ids of a text are those
    of its words one after another. A text with characters outside the Latin blocks is encoded as a whole.
    """

    def __init__(self, path: str, entries: int = CACHE_WORDS):
        self.known = WordCache(self.ids_of, entries)
        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.model = self.encoder.model
        letters = {ord(c): c for c in ByteLevel.alphabet()}
        spare = iter(sorted(c for c in letters if c > 255))
        printable = {b for b in letters if b < 256}
        self.byte_letters = [letters[b] if b in printable else letters[next(spare)] for b in range(256)]

    def ids_of(self, chunk: str) -> bytes:
        """Ids of a chunk without white space. Its words are looked up one by one, as they also stand alone or beside other marks."""
        words = [chunk] if chunk.isalpha() else PIECES.findall(chunk)
        if len(words) != 1:
            return b"".join(map(self.known.__getitem__, words))
        letters = chunk if chunk.isascii() else "".join([self.byte_letters[b] for b in chunk.encode()])
        found = [token.id for token in self.model.tokenize(letters)]
        return struct.pack(f"<{len(found)}I", *found)

    def __call__(self, text: str) -> bytes:
        if unusual(text):
            ids = self.encoder.encode(text, add_special_tokens=False).ids
            return np.asarray(ids, dtype="<u4").tobytes()
        return b"".join(map(self.known.__getitem__, text.lower().split()))


def document_ids(texts: list[str], encode: WordTokenizer, end_id: int = END_ID) -> list[bytes]:
    end = np.asarray([end_id], dtype="<u4").tobytes()
    return [encode(text) + end for text in texts]


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens[, ids]).

    Null text counts as empty and gives the one piece with the end id. Rows that repeat an id are documents of their
    own. Other columns are not read.
    """
    schema = PIECE_SCHEMA.append(pa.field("ids", pa.binary())) if with_ids else PIECE_SCHEMA

    def cut(batches):
        encode = WordTokenizer(vocabulary)
        for batch in sliced(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, ids in zip(values_of(batch, "doc_id"), document_ids(texts_of(batch), encode)):
                for start in range(0, len(ids), 4 * window):
                    part = ids[start : start + 4 * window]
                    for name, value in zip(schema.names, (key, start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)):
                        out[name].append(value)
            yield batch_of(schema, **out)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SQL + (", ids binary" if with_ids else ""))


class TightestRoom:
    """Segment tree over rooms 0..size: how many open windows have each room, and the least room >= a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def find(self, length: int) -> int:
        """Least room >= ``length`` with an open window, or -1."""
        node = length + self.leaves
        if self.count[node]:
            return length
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece."""
    window_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_windows, n = TightestRoom(window), [[] for _ in range(window + 1)], 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        room = tree.find(length)
        if room < 0:
            chosen, room, n = n, window, n + 1
        else:
            chosen = open_windows[room].pop()
            tree.add(room, -1)
        window_of[i], offset[i] = chosen, window - room
        if room > length:
            open_windows[room - length].append(chosen)
            tree.add(room - length, 1)
    return window_of, offset


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, shard_pieces: int = 20_000, with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Every id of every document lies in exactly one piece; a sequence holds at most ``window`` ids without gaps from
    offset 0. Sequences of one full window have negative ids. An empty table gives no rows. Equal lengths are taken by (doc_id, start), so the result does not depend on how
    rows arrive, unless rows repeat an id with different texts of one length.
    """
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    cut = stored(pieces(docs, vocabulary, window, with_ids), "pieces")
    full = F.col("length") == window
    rest = cut.where(~full)
    shards = max(1, -(-rest.count() // shard_pieces))
    sharded = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    names = cut.columns

    def place(key, group):
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        number, offset = best_fit_decreasing(group["length"].to_numpy(np.int64), window)
        group["sequence_id"] = (np.int64(key[0]) << np.int64(32)) + number
        group["offset"] = offset
        return group[[*names, "sequence_id", "offset"]]

    schema = PIECE_SQL + (", ids binary" if with_ids else "") + ", sequence_id bigint, offset bigint"
    alone = cut.where(full).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return alone.unionByName(sharded.groupBy("shard").applyInPandas(place, schema))


def sequences(packed: DataFrame) -> DataFrame:
    """The windows themselves: (sequence_id, input_ids binary, n_ids, doc_ids) from ``pack(..., with_ids=True)``.

    One sequence has at most ``window`` pieces, so a group is bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return (
        packed.groupBy("sequence_id")
        .agg(ordered.alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("input_ids"),
            F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["length"]).alias("n_ids"),
            F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        )
    )


def padding(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per sequence the ids it holds and the padding it needs: none when that number is a power of two."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"))
    exact = F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0
    return filled.withColumn("padding", F.when(exact, 0).otherwise(window - F.col("n_ids")))
