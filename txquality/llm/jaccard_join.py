"""Jaccard self-join of documents on word n-grams by a MinHash LSH forest.

Each of ``TREES`` prefix tries holds the documents under a label of ``DEPTH`` MinHash values. A document starts at its full label in
every trie and its prefix is shortened value by value, in all tries at once, until a partner at the threshold s has met it somewhere with the
target probability: 1 - prod(1 - s**k) over the lengths k of its prefixes. Nodes with more than ``crowd`` documents, such as
boilerplate that many texts share, are passed over: there the prefix stays longer, and other tries make up for it with prefixes down to
``LEAST_DEPTH`` values. Only a document that these cannot bring to the target is shortened in its crowded nodes too. So the target
holds for every document, and none is dropped. A node that one document is shortened to is open for all documents under it, so both sides
of a pair agree on it; a document is compared under the shortest open node of its path, once a trie.

A pair that meets in several tries is counted in the
first one only, which every task can tell from the node keys that travel with each document, so no pairs are written and
no pair list is made distinct: a task emits one row of link counts per document and a spanning forest of its links.

Exact copies are one class: only its smallest doc_id takes part, with the class size as weight. Nodes larger than
``block`` documents are split into pairs of blocks, so a hot node is compared by many tasks. Links are verified on the
sets of 64-bit shingle fingerprints.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import WordCache, batch_of, mix, runs, sliced, stored, texts_of, values_of
from txquality.llm.components import components, star_edges

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH, LEAST_DEPTH = 20, 8, 4
TARGET = 0.9995
CROWD = 64
BLOCK = 256
CHUNK_CHARS = 1 << 20
CACHE_WORDS = 100_000
SEED = 17

SIGNED = pa.schema([("doc_id", pa.int64()), ("copy", pa.binary()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64()))])


def missed(lengths, threshold: float) -> float:
    """Chance that a pair at the threshold meets under none of the prefixes of these lengths."""
    out = 1.0
    for k in lengths:
        out *= 1 - threshold**k
    return out


def least_depth(threshold: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shortest prefix that is tried: LEAST_DEPTH, or less where even that would not meet the target in all tries."""
    k = min(LEAST_DEPTH, depth)
    while k > 1 and missed([k] * trees, threshold) > 1 - target:
        k -= 1
    return k


def lengths_for(crowded, threshold: float, target: float, depth: int = DEPTH, least: int = LEAST_DEPTH) -> list[int]:
    """Prefix lengths of one document; ``crowded`` has for each trie the longest prefix whose node is crowded, or 0. The plain form of ``chosen``."""
    for k in range(depth, least - 1, -1):
        own = [max(k, min(depth, c + 1)) for c in crowded]
        if missed(own, threshold) <= 1 - target:
            return own
    for k in range(depth, least - 1, -1):
        short = [min(k, x) for x in own]
        if missed(short, threshold) <= 1 - target:
            break
    return short


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"), SEED)


def shingles(text: str, n: int = SHINGLE, known: WordCache | None = None) -> np.ndarray:
    """Sorted distinct fingerprints of the runs of ``n`` lower-case words. A text of fewer words is one shingle; none has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = WordCache(word_hash, CACHE_WORDS) if known is None else known
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    rolled = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(rolled)


class Hasher:
    """Labels of the tries by multiply-shift functions. The first ``least`` values of a label are mixed into its head.

    The others are kept in its tail as 60 // (depth - least) bits each (15 at most), the value nearest to the head in the highest bits: two
    labels that agree in some values agree in the tail's bits above, and others do so by chance at most, which opens more pairs and loses none.
    """

    def __init__(self, trees: int, depth: int, least: int):
        rng = np.random.default_rng(SEED)
        self.trees, self.depth, self.least = trees, depth, least
        self.a = rng.integers(0, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, trees * depth, dtype=np.uint64)

    def labels(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Heads and tails, (len(sets), trees) each; every set has an element."""
        flat = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        heads, tails = np.empty((len(sets), self.trees), np.uint64), np.zeros((len(sets), self.trees), np.uint64)
        bits = value_bits(self.depth, self.least)
        for t in range(self.trees):
            head, tail = np.full(len(sets), t + 1, np.uint64), np.zeros(len(sets), np.uint64)
            for j in range(self.depth):
                h = flat * self.a[t * self.depth + j] + self.b[t * self.depth + j]
                h ^= h >> np.uint64(32)
                least = np.minimum.reduceat(h, starts)
                if j < self.least:
                    head = mix(head * np.uint64(0x9E3779B97F4A7C15) + least)
                else:
                    tail = (tail << np.uint64(bits)) | (mix(least) >> np.uint64(64 - bits))
            heads[:, t], tails[:, t] = head, tail
        return heads.view(np.int64), tails.view(np.int64)


def value_bits(depth: int, least: int) -> int:
    return min(15, 60 // max(1, depth - least))


def node_key(length, depth: int, least: int):
    """Key of the node at ``length`` above a label (columns head and tail): the head and the values of the tail up to the length."""
    shift = (F.lit(depth) - length) * value_bits(depth, least)
    return F.xxhash64("head", F.call_function("shiftright", F.col("tail"), shift.cast("int")), length.cast("int"))


def signed(docs: DataFrame, n: int, trees: int, depth: int, least: int) -> DataFrame:
    """(doc_id, copy, heads, tails): a digest of the text and the labels; these are null where the text has no word."""
    hasher = Hasher(trees, depth, least)

    def sign(batches):
        known = WordCache(word_hash, CACHE_WORDS)
        for batch in sliced(batches):
            ids, texts = values_of(batch, "doc_id"), texts_of(batch)
            for a, b in runs([len(t) for t in texts], CHUNK_CHARS):
                sets = [shingles(t, n, known) for t in texts[a:b]]
                full = [i for i, s in enumerate(sets) if len(s)]
                heads, tails = [None] * (b - a), [None] * (b - a)
                if full:
                    for i, head, tail in zip(full, *hasher.labels([sets[i] for i in full])):
                        heads[i], tails[i] = head, tail
                copies = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts[a:b]]
                yield batch_of(SIGNED, doc_id=ids[a:b], copy=copies, heads=heads, tails=tails)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(sign, "doc_id bigint, copy binary, heads array<bigint>, tails array<bigint>")


def chosen(crowded, threshold: float, target: float, depth: int, least: int):
    """Prefix length of each trie as an array column, from an array of the longest crowded prefixes (see ``lengths_for``)."""
    logs = F.lit([0.0, *[math.log(1 - threshold**k) if threshold < 1 else -50.0 for k in range(1, depth + 1)]])
    reached = lambda own: F.aggregate(own, F.lit(0.0), lambda total, k: total + F.get(logs, k)) <= math.log(1 - target)
    steps = range(depth, least - 1, -1)
    around = {k: F.transform(crowded, partial(lambda k, c: F.greatest(F.lit(k), F.least(F.lit(depth), c + 1)), k)) for k in steps}
    short = {k: F.transform(around[least], partial(lambda k, x: F.least(F.lit(k), x), k)) for k in steps}
    found = [*[F.when(reached(around[k]), around[k]) for k in steps], *[F.when(reached(short[k]), short[k]) for k in steps], short[least]]
    return F.coalesce(*found)


def opened(classes: DataFrame, threshold: float, target: float, crowd: int, depth: int, least: int) -> DataFrame:
    """(doc_id, trie, key): the node under which a document is compared, for the tries in which it shares its head with another one."""
    every = classes.where("heads is not null").select("doc_id", F.posexplode(F.arrays_zip("heads", "tails")).alias("trie", "l"))
    every = every.select("doc_id", "trie", F.col("l.heads").alias("head"), F.col("l.tails").alias("tail"))
    heads = every.groupBy("trie", "head").agg(F.count("*").alias("m")).where("m > 1")
    shared = stored(every.join(heads, ["trie", "head"]), "labels")
    # Sizes are wanted under crowded heads only: nodes get smaller with the length, so no other is crowded.
    # Documents of one label have the same path, so a path is walked once a label however many documents share it.
    label = ["trie", "head", "tail"]
    under = shared.where(F.col("m") > crowd).groupBy(*label).agg(F.count("*").alias("n"))
    under = under.select(*label, "n", F.explode(F.lit(list(range(least, depth + 1)))).alias("k")).withColumn("key", node_key(F.col("k"), depth, least))
    full = under.groupBy("trie", "key").agg(F.sum("n").alias("m")).where(F.col("m") > crowd).select("trie", "key")
    deepest = under.join(full, ["trie", "key"], "left_semi").groupBy(*label).agg(F.max("k").alias("c"))
    longest = shared.join(deepest, label).groupBy("doc_id", "trie").agg(F.max("c").alias("c"))
    by_trie = longest.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("trie", "c"))).alias("cs"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.try_element_at("cs", t), F.lit(0)))
    special = stored(by_trie.select("doc_id", chosen(filled, threshold, target, depth, least).alias("ks")), "lengths")
    plain = lengths_for([0] * TREES, threshold, target, depth, least)[0]
    rows = shared.join(special, "doc_id", "left").withColumn("k", F.coalesce(F.get("ks", F.col("trie")), F.lit(plain))).drop("ks", "m")
    rows = stored(rows.withColumn("key", node_key(F.col("k"), depth, least)), "chosen")
    mixed = stored(rows.groupBy("trie", "head").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high"), "mixed")
    alike = rows.join(mixed, ["trie", "head"], "left_anti").select("doc_id", "trie", "key")
    among = rows.join(mixed, ["trie", "head"])
    paths = among.select(*label, "low", "high").distinct().select(*label, F.explode(F.sequence("low", "high")).alias("k"))
    paths = paths.withColumn("key", node_key(F.col("k"), depth, least))
    known = among.select("trie", "key").distinct()
    open_ = paths.join(known, ["trie", "key"], "left_semi").groupBy(*label).agg(F.min("k").alias("k"), F.min_by("key", "k").alias("key"))
    shortest = among.select("doc_id", *label).join(open_, label).groupBy("doc_id", "trie").agg(F.min_by("key", "k").alias("key"))
    return alike.unionByName(shortest)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that lie in more than one set."""
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([starts, [len(flat)]]))
    column = np.repeat(np.cumsum(size > 1) - 1, size)
    shared = np.repeat(size > 1, size)
    row, column = row[shared], column[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            cell = np.zeros((len(left) + len(right), width), np.float32)
            cell[row[a:b], column[a:b] - k * width] = 1
            out += cell[: len(left)] @ cell[len(left) :].T
    return out.astype(np.int64)


def compare(trie: int, same: bool, left: dict, right: dict, n: int, threshold: float, known: WordCache):
    """Links between the texts of two blocks that first meet in this trie: a boolean matrix."""
    need = np.ones((len(left["texts"]), len(right["texts"])), bool)
    if same:
        need = np.triu(need, 1)
    for t in range(trie):
        need &= left["keys"][:, t][:, None] != right["keys"][:, t][None, :]
    rows, columns = np.flatnonzero(need.any(1)), np.flatnonzero(need.any(0))
    links = np.zeros(need.shape, bool)
    if len(rows):
        a, b = [shingles(left["texts"][i], n, known) for i in rows], [shingles(right["texts"][i], n, known) for i in columns]
        common = intersections(a, b)
        union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - common
        links[np.ix_(rows, columns)] = (common >= threshold * union) & need[np.ix_(rows, columns)]
    return links


def found_links(classes: DataFrame, placed: DataFrame, docs: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """(id, other, n): link counts of representatives (other null), and edges of spanning forests (n null)."""
    crowded = placed.groupBy("trie", "key").agg(F.count("*").alias("m")).where("m > 1")
    crowded = stored(crowded.select("trie", "key", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "crowded")
    member = placed.join(crowded, ["trie", "key"]).groupBy("doc_id").agg(F.collect_list(F.struct("trie", "key", "blocks")).alias("groups"))
    # A trie in which a document meets nobody has a key of its own.
    met = F.map_from_entries(F.transform("groups", lambda g: F.struct(g["trie"], g["key"])))
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.try_element_at(met, t), F.xxhash64("doc_id", t)))
    taking = stored(
        member.withColumn("keys", keys).join(classes.select("doc_id", "copies"), "doc_id").join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id"), "members"
    )
    own = F.pmod(F.xxhash64("doc_id"), F.col("g.blocks")).cast("int")
    spread = (
        taking.select("doc_id", "text", "keys", "copies", F.explode("groups").alias("g"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g.blocks") - 1)))
        .select(
            "doc_id", "text", "keys", "copies", "own", F.col("g.trie").alias("trie"), F.col("g.key").alias("key"),
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        )
    )

    def verify(key, group):
        trie, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
        ids = group.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, weight, own = ids[order], group.column("copies").to_numpy()[order], group.column("own").to_numpy()[order]
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        texts = group.column("text").to_pylist()
        texts = [texts[i] or "" for i in order]
        out: tuple[list, list, list] = ([], [], [])
        side = [np.flatnonzero(own == low), np.flatnonzero(own == high)]
        if len(side[0]) and len(side[1]):
            of = [{"keys": keys[s], "texts": [texts[i] for i in s]} for s in side]
            links = compare(trie, low == high, *of, n, threshold, WordCache(word_hash, CACHE_WORDS))
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, side[0], links @ weight[side[1]])
            np.add.at(total, side[1], links.T @ weight[side[0]])
            full = np.zeros((len(ids), len(ids)), bool)
            full[np.ix_(*side)] = links
            edges = star_edges(ids, full)
            linked = np.flatnonzero(total)
            out = (
                [*ids[linked].tolist(), *[a for a, _ in edges]],
                [*[None] * len(linked), *[b for _, b in edges]],
                [*total[linked].tolist(), *[None] * len(edges)],
            )
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["id", "other", "n"])

    return spread.groupBy("trie", "key", "low", "high").applyInArrow(verify, "id bigint, other bigint, n bigint")


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, target: float = TARGET, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """One row per document: (doc_id, class_id, copy_of, n_links, kept).

    ``copy_of`` is the smallest doc_id with the same text, ``n_links`` the number of other documents whose n-gram sets reach the
    threshold (exact copies included), ``class_id`` the smallest doc_id reachable by links, ``kept`` whether it is the document's
    own. Texts without a word link with nothing, not even with each other; a text of fewer than ``n`` words is one shingle.
    doc_id is the key: rows that repeat one with the same text count as one document and give one row; rows with a null doc_id give none.
    """
    least = least_depth(threshold, target)
    base = stored(signed(docs, n, TREES, DEPTH, least), "signed")
    label = F.struct("heads", "tails")
    copies = base.groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("copies"), F.first(label).alias("l"))
    classes = stored(copies.select("copy", "doc_id", "copies", "l.*"), "classes")
    placed = stored(opened(classes, threshold, target, crowd, DEPTH, least), "placed")
    found = stored(found_links(classes, placed, docs, n, threshold, block), "links")
    parts = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    own = (
        classes.join(counts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "copy",
            F.col("doc_id").alias("copy_of"),
            F.coalesce("component", "doc_id").alias("class_id"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.col("heads").isNull().alias("wordless"),
        )
    )
    member = base.select("doc_id", "copy").distinct().join(own, "copy")
    single = F.col("wordless")
    return member.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(single, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(single, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        (single | (F.col("doc_id") == F.col("class_id"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a smaller doc_id of their group stands for.

    Of rows that repeat a doc_id with one text one stays. Rows with a null doc_id stay.
    """
    dropped = stored(join(docs, threshold, n).where("not kept").select("doc_id"), "dropped")
    left = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    ids = docs.where("doc_id is not null").agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1]:
        return left
    named = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(left.where("doc_id is null"))
