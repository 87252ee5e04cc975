"""Line dedup by content-defined chunks of lines.

A line ends at a line break or at the end of a sentence followed by white space. A line of more than ``LONG_LINE`` words ends behind commas,
semicolons and colons as well, and where that is not enough, behind words whose hash is less than those of their neighbours. Lines are
hashed, and a rolling hash runs over the line hashes: the one of a line covers the shortest run of lines from it on that has two
lines and ``MIN_WORDS`` words. Where it is the least of the lines that begin within ``WINDOW_WORDS`` words, or of two lines side by side if
they are longer, a boundary is set, and the run that begins there is a chunk. A boundary depends on a few lines around it and
on no count from the start of the text, so text that is shifted has the same chunks, and every passage of some 50 words that repeats in
whole lines holds one. In such a passage chunks follow one another closely and cover all but a line or two at either end.

Chunks whose hash occurs more than once are compared byte by byte; of equal ones the first by (doc_id, hash of the text, position) stays and
the others are cut out. A chunk that is cut out is extended by whole lines to both sides while size and 64-bit hash of their bytes agree with
those beside the copy that stays. A line that is cut has an equal one before it, so one copy of every line stays. Texts are not shuffled by chunk: hashes
are counted first, then only chunks with a repeated hash travel with their bytes and the hashes of the lines beside them. A chunk that a third of the
documents share is counted with partial aggregates, and only its verdicts, not its copies, meet.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import discard, mix, slices, stored, values_of

MIN_WORDS = 16
LONG_LINE = 24
WINDOW_WORDS = 24
#: Steps by which a chunk may be extended to either side, each of whole lines with so many words at least.
STEPS, STEP_WORDS = 3, 8
SEED = 23
#: Of words without white space, each LONG_RUN bytes count as a word; of scripts written without spaces, each letter.
LONG_RUN = 24
SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
STOPS, COMMAS = (np.isin(np.arange(256), list(marks)) for marks in (b".!?", b",;:"))
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_LETTER = re.compile(f"[{UNSPACED}]")
TOKEN = re.compile(rf"[{UNSPACED}]|[^ \t\n\v\f\r{UNSPACED}]+")
WIDE_STOP = re.compile("[。！？]")
WIDE_COMMA = re.compile("[，、；：]")
#: A chunk in bytes of its text, and the bytes of the steps before and behind it, from the chunk outwards.
SIDES = [f"{side}{k}" for side in ("before", "behind") for k in range(STEPS)]
CHUNK = [("hash", pa.int64()), *((c, pa.int32()) for c in ("first", "size", *SIDES))]
CHUNKS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *CHUNK])
CHUNKS_SQL = "doc_id bigint, text_hash bigint, hash bigint" + "".join(f", {c} int" for c in ("first", "size", *SIDES))
CUTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("cuts", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
NO_CHUNKS = tuple(np.zeros(0, np.int64) for _ in CHUNK)


def words_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, start of each text, then per word start, end, stop, comma), in bytes of the first.

    stop and comma say whether a sentence or a clause ends with the word. A line break stands between two texts.
    """
    raws = [text.encode("utf-8", "surrogatepass") for text in texts]
    raw = b"\n".join(raws) + b"\n"
    starts = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACES[data], [True]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    stop, comma = np.zeros(len(start), bool), np.zeros(len(start), bool)
    unspaced = [i for i, text in enumerate(texts) if not text.isascii() and UNSPACED_LETTER.search(text)]
    if unspaced:
        kept = ~np.isin(np.searchsorted(starts, start, "right") - 1, unspaced)
        found = [(start[kept], end[kept], stop[kept], comma[kept])]
        for i in unspaced:
            text, wide = texts[i], [np.zeros(len(texts[i]) + 1, bool) for _ in range(2)]
            spans = np.array([m.span() for m in TOKEN.finditer(text)], np.int64).reshape(-1, 2)
            for marks, pattern in zip(wide, (WIDE_STOP, WIDE_COMMA)):
                marks[[m.end() for m in pattern.finditer(text)]] = True
            at = starts[i] + np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])])
            found.append((at[spans[:, 0]], at[spans[:, 1]], wide[0][spans[:, 1]], wide[1][spans[:, 1]]))
        start, end, stop, comma = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(start, kind="stable")
        start, end, stop, comma = start[order], end[order], stop[order], comma[order]
    if len(start):
        last, spaced = data[end - 1], end < np.concatenate([start[1:], [len(data) + 1]])
        stop |= STOPS[last] & spaced
        comma |= COMMAS[last] & spaced
    return raw, starts, start, end, stop, comma


def split_long(words: list[bytes]) -> np.ndarray:
    """Words before which a long line is cut: those behind a word whose hash is less than those of the two words on either side."""
    if len(words) < 6:
        return np.zeros(0, np.int64)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    least = np.ones(len(words), bool)
    for k in (1, 2):
        least[k:] &= hashed[k:] < hashed[:-k]
        least[:-k] &= hashed[:-k] < hashed[k:]
    least[:2] = least[-2:] = False  # not decided by this line alone
    return np.flatnonzero(least) + 1


def lines_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, start of each text, then per line with words start, end, words), without white space around the lines."""
    raw, starts, start, end, stop, comma = words_of(texts)
    if not len(start):
        return raw, starts, start, end, start
    breaks = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) == 10)])
    ends = np.concatenate([stop[:-1] | (breaks[start[1:]] > breaks[end[:-1]]), [True]])
    weights = -(-(end - start) // LONG_RUN)

    def firsts():
        first = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
        return first, np.concatenate([first[1:], [len(start)]]), np.add.reduceat(weights, first)

    first, after, size = firsts()
    long = size > LONG_LINE
    if long.any():
        ends |= comma & np.repeat(long, after - first)
        first, after, size = firsts()
        for a, b in zip(first[size > LONG_LINE].tolist(), after[size > LONG_LINE].tolist()):
            ends[a - 1 + split_long([raw[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist())])] = True
        first, after, size = firsts()
    return raw, starts, start[first], end[after - 1], size


def boundaries(hashes: np.ndarray, words: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rolling hash, first line, line behind the last) of the runs at which a boundary is set.

    Every line has words; ``bound`` is the line behind the last of its text, which no run and no window passes.
    """
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    line = np.arange(n)
    stop = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS, "left"), line + 2)
    first = np.flatnonzero(stop <= bound)  # in each text the lines up to some one
    if not len(first):
        return np.zeros(0, np.uint64), first, first
    # a polynomial over the line hashes by prefix sums, scaled so that it does not depend on where the run begins
    base = 0x9E3779B97F4A7C15
    powers = np.cumprod(np.full(n, base, np.uint64))
    scale = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
    stop = stop[first]
    rolled = mix((sums[stop] - sums[first]) * scale[first])
    order = first[::-1][np.argsort(rolled[::-1], kind="stable")]  # of equal ones the last
    rank = np.full(n + 1, n, np.int64)
    rank[order] = np.arange(len(order))
    texts, text = np.unique(bound[first], return_inverse=True)
    last = np.zeros(len(texts), np.int64)
    np.maximum.at(last, text, first + 1)  # behind the last run that lies in the text
    close = np.maximum(np.searchsorted(total, total[first] + WINDOW_WORDS, "left"), first + 2)
    whole = close <= last[text]
    alone = np.ones(len(texts), bool)
    alone[text[whole]] = False  # texts shorter than a window are one
    begin = np.full(len(texts), n, np.int64)
    np.minimum.at(begin, text, first)
    windows = np.concatenate([np.stack([first[whole], close[whole]], 1), np.stack([begin[alone], last[alone]], 1)])
    chosen = np.unique(order[np.minimum.reduceat(rank, windows.ravel())[::2]])
    place = np.searchsorted(first, chosen)
    return rolled[place], chosen, stop[place]


def apart(hashes: list[int], first: list[int], stop: list[int]) -> np.ndarray:
    """Which runs to keep so that equal ones of one text do not overlap, the earlier first."""
    taken: dict[int, int] = {}
    kept = np.ones(len(hashes), bool)
    for i, (h, a, b) in enumerate(zip(hashes, first, stop)):
        if taken.get(h, -1) > a:
            kept[i] = False
        else:
            taken[h] = b
    return kept


def chunks_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(number of the text, hash, first, size, *SIDES) of the chunks, in bytes of their text in UTF-8, without white space at their ends.

    A step has whole lines of ``STEP_WORDS`` words at least, and fewer only at the end of the text; 0 bytes where there is no line.
    """
    raw, starts, begin, end, words = lines_of(texts)
    n = len(words)
    if not n:
        return (np.zeros(0, np.int64), *NO_CHUNKS)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, n)
    text = np.searchsorted(starts, begin, "right") - 1
    from_, bound = np.searchsorted(text, text, "left"), np.searchsorted(text, text, "right")
    rolled, first, stop = boundaries(hashed, words, bound)
    _, same, count = np.unique(np.stack([text[first], rolled.view(np.int64)]), axis=1, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[same.ravel()] > 1)
    if len(again):
        kept = np.ones(len(first), bool)
        kept[again] = apart(same.ravel()[again].tolist(), first[again].tolist(), stop[again].tolist())
        rolled, first, stop = rolled[kept], first[kept], stop[kept]
    total = np.concatenate([[0], np.cumsum(words)])
    low_bound, high_bound = from_[first], bound[first]
    sides, low, high = [[], []], first, stop
    for _ in range(STEPS):
        lower = np.maximum(np.minimum(np.searchsorted(total, total[low] - STEP_WORDS, "right") - 1, low - 1), low_bound)
        higher = np.minimum(np.maximum(np.searchsorted(total, total[high] + STEP_WORDS, "left"), high + 1), high_bound)
        sides[0].append(begin[low] - begin[lower])
        sides[1].append(end[higher - 1] - end[high - 1])
        low, high = lower, higher
    owner = text[first]
    return owner, rolled.view(np.int64), begin[first] - starts[owner], end[stop - 1] - begin[first], *sides[0], *sides[1]


def chunk_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hash, first, size, *SIDES) of every chunk of (doc_id, text_hash, text)."""

    def cut(batches):
        for batch in batches:
            texts = batch.column(2)
            keys, hashes = (np.array(values_of(batch, c), np.int64) for c in ("doc_id", "text_hash"))
            for a, b in slices(texts, 1 << 20):
                owner, *chunks = chunks_of(texts.slice(a, b - a).to_pylist())
                columns = [keys[a:b][owner], hashes[a:b][owner], *chunks]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), type=f.type) for c, f in zip(columns, CHUNKS)], schema=CHUNKS)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(cut, CHUNKS_SQL)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, cuts) of the chunks to cut out, all but the first of those with equal bytes; see ``joined_cuts``.

    Rows are told apart by id and text: of rows that repeat both only one is looked at, and all get the same cuts. Tables are stored
    step by step and deleted once the next one is written, so that chunks, texts and copies are not on disk together.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    table = stored(chunk_table(texts), "chunks")
    twice = stored(table.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "hashes")
    spans = F.array_sort(F.collect_set(F.struct("first", "size", "hash", *SIDES)))
    marked = stored(table.join(twice, "hash").groupBy("doc_id", "text_hash").agg(spans.alias("spans")), "marked", release=True)
    discard(table, twice)
    raw = F.col("text").cast("binary")  # bytes are found at once, characters by counting from the start

    def with_bytes(s):
        def step(name, start):
            return F.struct(s[name].alias("size"), F.xxhash64(F.substring(raw, start + 1, s[name])).alias("hash")).alias(name)

        low, high, steps = s["first"], s["first"] + s["size"], []
        for name in SIDES[:STEPS]:
            low = low - s[name]
            steps.append(step(name, low))
        for name in SIDES[STEPS:]:
            steps.append(step(name, high))
            high = high + s[name]
        return F.struct(s["hash"].alias("hash"), s["first"].alias("first"), F.substring(raw, s["first"] + 1, s["size"]).alias("part"), *steps)

    # of rows that repeat an id and a text, one has its bytes looked up
    once = marked.join(texts, ["doc_id", "text_hash"]).select("doc_id", "text_hash", F.inline(F.transform("spans", with_bytes)))
    candidates = stored(once, "candidates", release=True)
    discard(marked)
    beside = F.struct("doc_id", "text_hash", "first", *SIDES)
    stays = candidates.groupBy("hash", "part").agg(F.min(beside).alias("stays"), F.count("*").alias("n")).where("n > 1")
    stays = stored(stays, "stays", release=True)  # a table of its own, so that a hot chunk's side of the join can be split
    joined = candidates.join(stays, ["hash", "part"])
    same = [F.col(c) == F.col(f"stays.{c}") for c in ("doc_id", "text_hash", "first")]
    again = joined.where(~(same[0] & same[1] & same[2]))

    def agreeing(names: list[str]) -> Column:
        """Bytes of the steps to one side that agree, up to the first that does not."""
        if not names:
            return F.lit(0)
        name, *rest = names
        return F.when(F.col(name) == F.col(f"stays.{name}"), F.col(f"{name}.size") + agreeing(rest)).otherwise(0)

    first = F.col("first").cast("bigint") - agreeing(SIDES[:STEPS])
    last = F.col("first").cast("bigint") + F.octet_length("part") + agreeing(SIDES[STEPS:])
    cuts = stored(joined_cuts(again.select("doc_id", "text_hash", first.alias("first"), last.alias("last"))), "cuts")
    discard(candidates, stays)
    return cuts


def joined_cuts(cuts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, cuts): how many chunks are cut out of a text, and their bytes as ranges that neither overlap nor touch."""
    found = cuts.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("found"))

    def join(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            spans = batch.column(2)
            flat = spans.flatten()
            first, last = (flat.field(k).to_numpy() for k in (0, 1))
            at = 0
            for key, text, n in zip(values_of(batch, "doc_id"), values_of(batch, "text_hash"), [len(s) for s in spans]):
                a, reach = first[at : at + n], np.maximum.accumulate(last[at : at + n])
                new = np.concatenate([[True], a[1:] > reach[:-1]])
                close = reach[np.concatenate([new[1:], [True]])]
                for column, value in zip(out, (key, text, n, [{"first": x, "last": y} for x, y in zip(a[new].tolist(), close.tolist())])):
                    column.append(value)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, CUTS)], schema=CUTS)

    return found.mapInArrow(join, "doc_id bigint, text_hash bigint, n int, cuts array<struct<first: bigint, last: bigint>>")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated chunks cut out of ``text``, and n_chars, removed_chunks and removed_chars.

    Other columns stay as they are; input columns of the names n_chars, removed_chunks and removed_chars are replaced. Null text stays
    null (n_chars null), empty text empty; a text that consists of repeated chunks only becomes empty. Chunks overlap, and each one counts
    in removed_chunks. Rows that repeat an id and a text are one document and stay or lose the same; rows that repeat an id with
    different texts are documents of their own. Rows with a null doc_id are passed through untouched. An empty table gives no rows.
    """
    new = ("n_chars", "removed_chunks", "removed_chars")
    kept = [c for c in docs.columns if c not in new]
    cuts = repeated_chunks(docs)
    # input columns travel in one struct, so their names cannot clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    text = F.col("row.text")
    raw = text.cast("binary")

    def gap(i):
        """Bytes between cut i - 1 and cut i."""
        start = F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["last"])
        end = F.when(i == F.size("cuts"), F.octet_length(text).cast("bigint")).otherwise(F.get("cuts", i)["first"])
        return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")

    gaps = F.transform(F.sequence(F.lit(0), F.size("cuts")), gap)
    left = F.when(F.size("cuts") > 0, F.trim(F.concat_ws("", gaps))).otherwise(text)
    done = rows.join(cuts, ["doc_id", "text_hash"], "left").select("row", left.alias("left"), F.coalesce("n", F.lit(0)).alias("n"))
    return done.select(
        *[F.col("left").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept],
        F.length("left").cast("bigint").alias("n_chars"),
        F.col("n").alias("removed_chunks"),
        F.coalesce(F.length(text) - F.length("left"), F.lit(0)).alias("removed_chars"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns and the repeated chunks cut out; rows of which only white space is left are dropped."""
    done = dedup(docs).where((F.col("removed_chunks") == 0) | F.col("text").rlike(r"(?U)\S"))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
