"""Embedding near-duplicates by a forest of random-projection trees.

Vectors of each length get a forest of their own. Every tree splits the vectors again and again by a random direction; vectors within ``spill`` of a split's threshold go to both
sides. The spill is chosen before the trees are grown, so that the forest meets ``RECALL`` of the pairs at the threshold: a split with
spill m parts a pair whose projected difference has deviation s only where the difference exceeds 2m, and the chance of
that, over the depth that the row count asks for and over all trees, is known (``spill_for``). Deeper forests spill more or have more trees:
of the numbers of trees that meet ``RECALL`` the one that places a vector least often is taken (``shape_for``). Of several random splits of a node the one that leaves the least comparing work is taken, which also keeps dense groups
whole: a node that no split thins out becomes a leaf of any size. The trees are fitted in the driver on a bounded sample
(``sample_rows``); every vector is then sent down all trees.

Vectors are compared within leaves only, by cosine in double precision. A pair that shares several leaves is counted in the one
with the lowest number, which each task can tell from the leaf lists that travel with the vectors, so pairs are neither written
nor made distinct: a task emits link counts per vector and a spanning forest. Leaves larger than ``block`` are
compared block by block in many tasks. Equal vectors are one class with a weight.

A vector is in many leaves, so the leaves are compared in waves: a wave moves about as many vectors as the table has, and the files of its
shuffle are removed before the next. Vectors stay in the precision in which they are given until they are compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import appended, bounded_sample, discard, runs, stored
from txquality.llm.components import components, star_edges

THRESHOLD = 0.9
RECALL = 0.999
TREES = 5
SAMPLE_ROWS = 20_000
LEAF_ROWS = 1024
BLOCK = 2048
TILE = 512  # rows of a leaf that a task compares with others at a time
WAVE_ROWS = 1_000_000  # that a wave moves at least
DESCEND_BYTES = 32 << 20  # vectors that go down the trees together
LEAST_SPILL = 0.5  # in standard deviations of a projected difference at the threshold
THIN_SPILL = 0.1  # the least where there may be more trees
MOST_TREES = 64
TRIED_SPLITS = 12
SEED = 29


@dataclass
class Node:
    direction: np.ndarray | None = None
    threshold: float = 0.0
    children: list["Node"] = field(default_factory=list)
    leaf: int = -1


@dataclass
class Forest:
    roots: list[Node]
    margin: float
    leaves: int
    first: int = 0  # number of the first leaf

    def leaves_of(self, x: np.ndarray) -> list[list[int]]:
        """Leaf numbers, ascending, of each row of unit vectors; numbers are unique over all trees."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        for root in self.roots:
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if not len(rows):
                    continue
                if node.leaf >= 0:
                    for r in rows.tolist():
                        out[r].append(self.first + node.leaf)
                    continue
                side = x[rows] @ node.direction - node.threshold
                stack.append((node.children[0], rows[side < self.margin]))
                stack.append((node.children[1], rows[side >= -self.margin]))
        return [sorted(o) for o in out]


def parted(spill: float) -> float:
    """Bound of the chance that a split parts a pair at the threshold.

    The projected difference z of the pair is taken as normal with deviation one. The pair is parted where z is longer than two spills
    and its middle lies in the |z| - 2 * spill around the split that no overlap covers; values near the split have a density of
    0.4 a deviation of the data at most, and a deviation of the data is sqrt(1 / (2 - 2 * 0.9)) of the difference's, about 2.2.
    """
    x = 2 * spill
    tail = math.erfc(x / math.sqrt(2)) / 2
    excess = 2 * (math.exp(-x * x / 2) / math.sqrt(2 * math.pi) - x * tail)  # mean of max(|z| - x, 0)
    return min(1.0, 0.4 * excess / math.sqrt(5))


def spill_for(depth: int, recall: float = RECALL, trees: int = TREES, least: float = LEAST_SPILL) -> float:
    """Least spill, in steps of a twentieth, at which a pair at the threshold shares a leaf of some tree with probability ``recall``."""
    for step in range(61):
        spill = least + step / 20
        if (1 - (1 - parted(spill)) ** depth) ** trees <= 1 - recall:
            return spill
    return spill


def side_of(spill: float) -> float:
    """Share of its rows that a split at the middle leaves on a side; see ``parted`` for the density."""
    return min(0.5 + 0.4 * spill / math.sqrt(5), 0.95)


def depth_of(rows: int, leaf_rows: int, side: float = 2 / 3) -> int:
    """Splits above a leaf when each leaves the share ``side`` of its rows on a side, spill included."""
    return max(1, math.ceil(math.log(max(rows / max(leaf_rows, 1), 1)) / -math.log(side)))


def shape_for(rows: int, leaf_rows: int, recall: float = RECALL) -> tuple[int, float]:
    """(trees, spill) that meet ``recall`` with the fewest leaves a vector. Splits are taken to be less even than at the middle by a tenth."""
    best = (math.inf, TREES, LEAST_SPILL)
    for trees in range(TREES, MOST_TREES + 1):
        spill, chosen = -1.0, THIN_SPILL
        while chosen > spill:  # more spill is more depth, which may ask for more spill
            spill = chosen
            depth = depth_of(rows, leaf_rows, min(1.1 * side_of(spill), 0.95))
            chosen = spill_for(depth, recall, trees, spill)
            if chosen > 2:
                break
        met = (1 - (1 - parted(chosen)) ** depth) ** trees <= 1 - recall
        best = min(best, (trees * (2 * side_of(chosen)) ** depth if met and chosen <= 2 else math.inf, trees, chosen))
    return best[1:]


def grow(
    sample: np.ndarray, leaf_rows: float, threshold: float = THRESHOLD, trees: int = TREES, seed: int = SEED, spill: float = LEAST_SPILL
) -> Forest:
    """Trees over unit vectors; a node of ``leaf_rows`` sample rows or fewer is a leaf."""
    rng = np.random.default_rng(seed)
    margin = spill * np.sqrt(max(2 - 2 * threshold, 0) / max(sample.shape[1], 1))
    count = 0

    def leaf() -> Node:
        nonlocal count
        count += 1
        return Node(leaf=count - 1)

    def build(rows: np.ndarray, depth: int) -> Node:
        n = len(rows)
        if n <= max(leaf_rows, 2) or depth > 40:
            return leaf()
        directions = rng.normal(size=(TRIED_SPLITS, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        best = (0.92, None, 0.0)
        for d in directions:
            p = np.sort(sample[rows] @ d)
            for q in np.linspace(0.2, 0.8, 13):
                t = p[int(q * (n - 1))]
                left, right = np.searchsorted(p, t + margin) / n, 1 - np.searchsorted(p, t - margin) / n
                if left**2 + right**2 < best[0]:
                    best = (left**2 + right**2, d, float(t))
        if best[1] is None:
            return leaf()
        side = sample[rows] @ best[1] - best[2]
        return Node(best[1], best[2], [build(rows[side < margin], depth + 1), build(rows[side >= -margin], depth + 1)])

    roots = [build(np.arange(len(sample)), 0) for _ in range(trees)]
    return Forest(roots, float(margin), count)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as floats if given so, else doubles) of vectors that can link: no null, no non-finite component, not zero."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    x = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.where(F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)))


def fit(classes: DataFrame, threshold: float, sample_rows: int, leaf_rows: int, recall: float = RECALL) -> dict[int, Forest]:
    """Forest of each vector length. Lengths are taken to be few: one small sample and one count per length reach the driver.

    ``sample_rows`` bounds the sample of all lengths together, shared out by the rows that each has.
    """
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    total, forests, first = sum(sizes.values()), {}, 0
    sample = bounded_sample(classes, "vec_id", sample_rows, SEED).select("vec_id", F.size("embedding").alias("d"), "embedding").toArrow() if total else None
    for d in sorted(sizes):
        rows = sample.filter(pc.equal(sample.column("d"), d))
        x = rows_of(rows.column("embedding")) if rows.num_rows else np.zeros((0, d))
        x = unit(x[np.argsort(rows.column("vec_id").to_numpy())])
        share = leaf_rows * len(x) / max(sizes[d], 1)
        trees, spill = shape_for(sizes[d], leaf_rows, recall)
        forest = grow(x, share, threshold, trees, spill=spill)
        forest.first, first = first, first + forest.leaves
        forests[d] = forest
    return forests


def waves(rows: dict[int, int], limit: int) -> list[tuple[int, int]]:
    """(first, last) ranges of leaf numbers whose rows add up to ``limit`` at most; a larger leaf stands alone."""
    names = sorted(rows)
    return [(names[a], names[b - 1]) for a, b in runs([rows[n] for n in names], limit)]


def matches(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of rows of ``a`` and ``b``, unit vectors, reaches the threshold in double precision.

    Single precision decides where its error, bounded by the length, leaves no doubt.
    """
    rough = a.astype(np.float32) @ b.astype(np.float32).T
    error = 1.3e-7 * (a.shape[1] + 4)
    found = rough >= threshold - error
    if found.any():
        i, j = np.nonzero(found & (rough < threshold + error))
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            found[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
    return found


def met_before(found: np.ndarray, left: np.ndarray, right: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``found`` without the pairs that share a leaf compared earlier: row i of ``left`` or ``right`` has ``flat[offsets[i]:offsets[i + 1]]``."""
    rows, columns = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
    sides = []
    for side in (left[rows], right[columns]):
        count = offsets[side + 1] - offsets[side]
        owner = np.repeat(np.arange(len(side)), count)
        sides.append((owner, flat[np.arange(len(owner)) + np.repeat(offsets[side] - (np.cumsum(count) - count), count)]))
    names = np.intersect1d(sides[0][1], sides[1][1])
    if not len(names):
        return found
    sides = [(owner[k], leaf[k]) for owner, leaf, k in ((*s, np.isin(s[1], names)) for s in sides)]
    place = [np.arange(len(owner)) - np.searchsorted(owner, owner) for owner, _ in sides]
    longest = 1 + max(p.max() for p in place)
    i, j = np.nonzero(found[np.ix_(rows, columns)])
    if len(i) * longest**2 <= len(rows) * len(columns) * len(names) / 8:  # few pairs: list against list
        padded = [np.full((n, longest), -1 - k, np.int64) for k, n in enumerate((len(rows), len(columns)))]
        for to, p, (owner, leaf) in zip(padded, place, sides):
            to[owner, p] = leaf
        for k in range(0, len(i), 4096):
            p, q = i[k : k + 4096], j[k : k + 4096]
            shared = (padded[0][p][:, :, None] == padded[1][q][:, None, :]).any((1, 2))
            found[rows[p[shared]], columns[q[shared]]] = False
        return found
    shared = np.zeros((len(rows), len(columns)), bool)
    for k in range(0, len(names), 4096):
        part = names[k : k + 4096]
        inside = []
        for n, (owner, leaf) in zip((len(rows), len(columns)), sides):
            here = (leaf >= part[0]) & (leaf <= part[-1])
            m = np.zeros((n, len(part)), np.float32)
            m[owner[here], np.searchsorted(part, leaf[here])] = 1
            inside.append(m)
        shared |= inside[0] @ inside[1].T > 0
    found[np.ix_(rows, columns)] &= ~shared
    return found


def found_links(classes: DataFrame, forests: dict[int, Forest], threshold: float, block: int, wave_rows: int = WAVE_ROWS) -> DataFrame:
    """(id, other, n): link counts of classes (other null), and edges of spanning forests (n null). Discards ``classes``."""

    def together(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.nbytes
            if size >= DESCEND_BYTES:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, size = [], 0
        if kept:
            yield pa.Table.from_batches(kept).combine_chunks()

    def descend(batches):
        for whole in together(batches):
            lengths = pc.list_value_length(whole.column(1))
            for d in pc.unique(lengths).to_pylist():
                part = whole.filter(pc.equal(lengths, d))
                leaves = pa.array(forests[d].leaves_of(unit(rows_of(part.column(1)))), pa.list_(pa.int32()))
                yield from part.append_column("leaves", leaves).to_batches(10_000)

    kind = dict(classes.dtypes)["embedding"]
    placed = stored(classes.select("vec_id", "embedding", "copies").mapInArrow(descend, f"vec_id bigint, embedding {kind}, copies bigint, leaves array<int>"), "placed")
    discard(classes)
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
    blocks = {r["leaf"]: (r["count"], -(-r["count"] // block)) for r in sizes.where("count > 1").collect()}  # one row per leaf of forests fitted on a bounded sample

    def spread(first: int, last: int) -> DataFrame:
        """Vectors in leaves ``first`` to ``last``, once for each pair of blocks, with their leaves before."""
        of_leaf = F.split(F.lit(",".join(str(blocks.get(i, (0, 0))[1]) for i in range(first, last + 1))), ",").cast("array<int>")
        return (
            placed.select("*", F.posexplode("leaves").alias("place", "leaf"))
            .where(F.col("leaf").between(first, last))
            .withColumn("blocks", F.get(of_leaf, F.col("leaf") - first))
            .where("blocks > 0")
            .withColumn("own", F.pmod(F.xxhash64("vec_id", "leaf"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                "vec_id", "embedding", "copies", F.slice("leaves", F.lit(1), F.col("place")).alias("before"), "own", "leaf",
                F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            )
        )

    def compare(key, group):
        _, low, high = (k.as_py() for k in key)
        ids, own, weight = (group.column(c).to_numpy() for c in ("vec_id", "own", "copies"))
        out: tuple[list, list, list] = ([], [], [])
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        if len(left) and len(right):
            x = unit(rows_of(group.column("embedding")))
            lists = group.column("before").combine_chunks()
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            full = None
            for k in range(0, len(left), TILE):
                rows, columns = left[k : k + TILE], right[k:] if low == high else right
                links = matches(x[rows], x[columns], threshold)
                if low == high:
                    links &= (ids[rows][:, None] != ids[columns][None, :]) & (np.arange(len(rows))[:, None] < np.arange(len(columns))[None, :])
                if links.any():
                    full = np.zeros((len(ids), len(ids)), bool) if full is None else full
                    full[np.ix_(rows, columns)] = met_before(links, rows, columns, flat, offsets)
            if full is not None and full.any():
                total = np.zeros(len(ids), np.int64)
                p, q = np.nonzero(full)
                np.add.at(total, p, weight[q])
                np.add.at(total, q, weight[p])
                linked = np.flatnonzero(total)
                edges = star_edges(ids[linked], full[np.ix_(linked, linked)])
                out = (
                    [*ids[linked].tolist(), *[a for a, _ in edges]],
                    [*[None] * len(linked), *[b for _, b in edges]],
                    [*total[linked].tolist(), *[None] * len(edges)],
                )
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["id", "other", "n"])

    schema = "id bigint, other bigint, n bigint"
    ranges = waves({leaf: n * k for leaf, (n, k) in blocks.items()}, max(placed.count(), wave_rows))
    found = appended((spread(a, b).groupBy("leaf", "low", "high").applyInArrow(compare, schema) for a, b in ranges), schema, classes.sparkSession, "links")
    discard(placed)
    return found


def digest(vector: str = "embedding") -> list:
    """Two columns, 128 bits, that stand for a vector in joins; equal vectors have equal ones."""
    return [F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(SEED), vector).alias("h2")]


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, block: int = BLOCK, recall: float = RECALL
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Vectors of different lengths do not link; each length has its own forest. Vectors that are null, zero or hold null or non-finite components link with nothing. vec_id is
    the key: rows that repeat one with the same vector are one vector and give one row each; a null vec_id links with nothing
    and has a null component.
    """
    good = usable(vectors)
    classes = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies")), "vectors", release=True)
    names = stored(classes.select("vec_id", "copies", *digest()), "names")
    found = found_links(classes, fit(classes, threshold, sample_rows, leaf_rows, recall), threshold, block)
    parts = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = stored(found.where("other is null").groupBy("id").agg(F.sum("n").alias("n")), "counts")
    discard(found)
    own = stored(
        names.join(counts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")),
        "classes",
    )
    linked = good.select("vec_id", *digest()).join(own, ["h1", "h2"]).select("vec_id", "n_links", "component_id").distinct()
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
