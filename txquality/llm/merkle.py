"""Merkle manifest of a dataset by a butterfly exchange.

Every row is a leaf, a digest of its fields. Per source the leaves ascend by doc_id and ``FANOUT`` consecutive nodes are hashed into
their parent until one, the subroot, is left; the subroots, ordered by source, are hashed to the root in the same way.

Leaves are dealt by range of (source, doc_id) and numbered from counts per range, so a source that holds a third of all rows is spread
like any other. ``FANOUT ** LEVELS`` consecutive leaves are one block, the partition of the exchange. Each block hashes its own
leaves. Then blocks swap roots round by round: in round r a block asks one partner in each of the FANOUT aligned groups of
FANOUT ** r blocks around it (the block whose number differs in that digit only), gets the roots of those groups and hashes their parent
itself. All blocks hash their ancestors redundantly, and after the last round each one holds the siblings on the whole way to
the root: nothing is sent down a tree. Sources swap subroots in the same way. A round moves FANOUT short rows per block. Last, each
block writes the proofs of its own leaves.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import discard, stored

FANOUT = 16
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UP = "array<struct<before: string, after: string>>"
NUMBERED = "place bigint, doc_id bigint, source string, leaf string, found string, part int"
MANIFEST = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("position", pa.int64())]
    + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    + [("verified", pa.bool_())]
)
MANIFEST_SQL = (
    "doc_id bigint, source string, position bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)
STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Digest of fields: ``-`` for null, else the number of bytes in UTF-8, a colon and the value."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in (c.cast("string") for c in values)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels_over(leaves: list[str], rounds: int | None, fanout: int) -> list[list[str]]:
    """The leaves and the nodes over them, ``rounds`` levels up, or up to a single node."""
    levels = [leaves]
    while len(levels) <= rounds if rounds is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def numbered(docs: DataFrame, found_text: Column | None) -> DataFrame:
    """(place, doc_id, source, leaf, found, part) in order of (source, doc_id, leaf); place counts a source's rows within a part."""
    fields = [F.col(c) for c in FIELDS]
    leaf = leaf_digest(*fields)
    found = F.lit(None).cast("string") if found_text is None else F.when(found_text.isNotNull(), leaf_digest(*fields[:-1], found_text))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", leaf.alias("leaf"), found.alias("found"), F.monotonically_increasing_id().alias("tie")
    )
    order = ("source", "doc_id", "leaf", "tie")  # equal rows are parted as well
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches):
        part, last, place = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for source in batch.column(1).to_pylist():
                place = place + 1 if source == last else 0
                last = source
                places.append(place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int64()), *(batch.column(i) for i in range(4)), pa.array([part] * len(places), pa.int32())],
                ["place", "doc_id", "source", "leaf", "found", "part"],
            )

    return dealt.drop("tie").mapInArrow(number, NUMBERED)


def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, part, before) for each stretch of a source in a part, and (source, rank, n) for each source.

    Windows run over one row per source and part; the only one over everything has one row per part.
    """
    stretches = stored(rows.groupBy("source", "part").agg(F.count("*").alias("n")), "stretches")
    before = F.expr("coalesce(sum(n) over (partition by source order by part rows between unbounded preceding and 1 preceding), 0)")
    offsets = stretches.select("source", "part", before.alias("before"))
    sources = stretches.groupBy("source").agg(F.min("part").alias("part"), F.sum("n").alias("n"))
    starts = sources.groupBy("part").agg(F.count("*").alias("k"))
    starts = starts.select("part", F.expr("coalesce(sum(k) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("k"))
    within = F.expr("row_number() over (partition by part order by source asc nulls first) - 1")
    ranked = sources.withColumn("within", within).join(starts, "part").select("source", (F.col("k") + F.col("within")).alias("rank"), "n")
    return stored(offsets, "offsets"), stored(ranked, "sources")


def with_blocks(rows: DataFrame, offsets: DataFrame, sources: DataFrame, size: int) -> DataFrame:
    """(rank, block, blocks, place, doc_id, source, leaf, found) with ``place`` counted within the block."""
    a, b, c = rows.alias("a"), offsets.alias("b"), sources.alias("c")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.part")))
    joined = joined.join(c, F.col("a.source").eqNullSafe(F.col("c.source")))
    at = F.col("b.before") + F.col("a.place")
    return joined.select(
        "c.rank",
        F.floor(at / size).alias("block"),
        F.ceil(F.col("c.n") / size).alias("blocks"),
        (at % size).alias("place"),
        *(F.col(f"a.{x}").alias(x) for x in ("doc_id", "source", "leaf", "found")),
    )


def swap(state: DataFrame, key: str, blocks: Column, round_: int, fanout: int, own: list[str]) -> DataFrame:
    """One round of the butterfly over (``own`` columns, key, node, up): every row hashes the parent of its group.

    ``own`` are the columns that name a tree, ``key`` counts the rows of a tree from 0 and ``blocks`` says how many it has. A partner is looked for
    in each group of fanout ** round rows; in an unfinished last group the requests are dealt evenly over the rows that are there.
    """
    width = fanout**round_
    k = F.col(key)
    group = F.floor(k / (width * fanout)) * fanout
    child = F.explode(F.sequence(group, F.least(group + fanout - 1, F.ceil(blocks / width) - 1)))
    asked = state.select(*own, key, "up", blocks.alias("_blocks"), child.alias("_child"))
    partner = F.col("_child") * width + (k % width) % F.least(F.lit(width), F.col("_blocks") - F.col("_child") * width)
    asked = asked.select("*", partner.alias("_partner"))
    given = state.select(*(F.col(c).alias(f"_given_{c}") for c in own), F.col(key).alias("_partner"), F.col("node").alias("_node"))
    met = [F.col(c) == F.col(f"_given_{c}") for c in own] + [asked["_partner"] == given["_partner"]]
    both = asked.join(given, met).select(*own, key, "up", "_child", "_node", (F.floor(k / width)).alias("_mine"))
    roots = F.array_sort(F.collect_list(F.struct("_child", "_node")))
    swapped = both.groupBy(*own, key, "_mine").agg(roots.alias("_roots"), F.min("up").alias("up"))

    def joined(keep):
        return F.array_join(F.transform(F.filter("_roots", keep), lambda r: r["_node"]), "")

    step = F.struct(joined(lambda r: r["_child"] < F.col("_mine")).alias("before"), joined(lambda r: r["_child"] > F.col("_mine")).alias("after"))
    node = F.sha2(joined(lambda r: F.lit(True)).cast("binary"), 256)
    return swapped.select(*own, key, node.alias("node"), F.concat("up", F.array(step)).alias("up"))


def exchanged(roots: DataFrame, fanout: int) -> DataFrame:
    """(rank, block, subroot, root, up) from (rank, block, blocks, node): the way from a block's root to the root of all."""
    roots = stored(roots, "roots")
    tall, sources = roots.agg(F.max("blocks"), F.count_distinct("rank")).first()
    state = roots.select("rank", "block", "blocks", "node", F.array().cast(UP).alias("up"))
    for r in rounds_of(tall or 1, fanout):
        # trees of fewer blocks have their subroot already
        higher = state.where(F.col("blocks") > fanout**r)
        swapped = swap(higher.withColumn("_tree", F.col("rank")), "block", F.col("blocks"), r, fanout, ["_tree", "blocks"])
        swapped = swapped.select(F.col("_tree").alias("rank"), "block", "blocks", "node", "up")
        old, state = state, stored(swapped.unionByName(state.where(F.col("blocks") <= fanout**r)), "round")
        if r:
            discard(old)
    tops = state.where("block = 0").select(F.lit(0).alias("_tree"), "rank", "node", F.array().cast(UP).alias("up"))
    tops = stored(tops, "tops")
    for r in rounds_of(sources or 1, fanout):
        old, tops = tops, stored(swap(tops, "rank", F.lit(sources), r, fanout, ["_tree"]), "tops")
        discard(old)
    # every block of a source knows what the source knows
    above = tops.select("rank", F.col("node").alias("root"), F.col("up").alias("_above"))
    return state.join(above, "rank").select("rank", "block", F.col("node").alias("subroot"), "root", F.concat("up", "_above").alias("up"))


def rounds_of(nodes: int, fanout: int) -> range:
    rounds = 0
    while nodes > 1:
        nodes = -(-nodes // fanout)
        rounds += 1
    return range(rounds)


def manifest(docs: DataFrame, found_text: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS, with_proofs: bool = False) -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, position, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]).

    ``position`` counts the rows of a source from 0. ``proof`` lists, from the leaf up, the joined digests of the siblings before and after
    a node; ``proof_sha256`` is the digest of all of them, level by level, left to right. ``found_text`` is the text as it is found when the
    manifest is checked, null where nothing changed; ``folded_root`` is recomputed from the leaf of that text and the recorded
    siblings, and ``verified`` says whether it equals the root.

    Nulls are a value of their own (``-``); a null source is a source and comes first, a null doc_id comes first in its source. Rows that
    repeat an id are leaves of their own, ordered by digest. An empty table gives no rows. Only the five fields of a leaf are read, so
    other columns may have any name. A block holds ``fanout ** levels`` leaves, which bounds every group.
    """
    rows = stored(numbered(docs, found_text), "leaves")
    offsets, sources = counted(rows)
    placed = stored(with_blocks(rows, offsets, sources, fanout**levels), "blocks")
    discard(rows, offsets, sources)

    def own_levels(blocks: int, leaves: list[str]) -> list[list[str]]:
        return levels_over(leaves, levels if blocks > 1 else None, fanout)

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by("place")

    def root_of(table: pa.Table) -> pa.Table:
        rank, block, blocks = (table.column(c)[0].as_py() for c in ("rank", "block", "blocks"))
        node = own_levels(blocks, ordered(table).column("leaf").to_pylist())[-1][0]
        return pa.table({"rank": [rank], "block": [block], "blocks": [blocks], "node": [node]})

    roots = placed.select("rank", "block", "blocks", "place", "leaf").groupBy("rank", "block")
    ways = stored(exchanged(roots.applyInArrow(root_of, "rank bigint, block bigint, blocks bigint, node string"), fanout), "ways")

    schema = MANIFEST.append(pa.field("proof", STEPS)) if with_proofs else MANIFEST

    def prove(table: pa.Table, way: pa.Table) -> pa.Table:
        table = ordered(table)
        block, blocks, root, subroot = table.column("block")[0].as_py(), table.column("blocks")[0].as_py(), way.column("root")[0].as_py(), way.column("subroot")[0].as_py()
        up = [(s["before"], s["after"]) for s in way.column("up")[0].as_py()]
        upper = "".join(a + b for a, b in up).encode()
        leaves, found = table.column("leaf").to_pylist(), table.column("found").to_pylist()
        inner = own_levels(blocks, leaves)
        proofs, folded, steps = [], [], []
        for i, leaf in enumerate(leaves):
            way_up, at = [], i
            for nodes in inner[:-1]:
                low = at - at % fanout
                way_up.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + fanout])))
                at //= fanout
            hashed = sha256("".join([a + b for a, b in way_up]).encode())
            hashed.update(upper)
            proofs.append(hashed.hexdigest())
            node = found[i] or leaf
            way_up += up
            for before, after in way_up:
                node = digest(before + node + after)
            folded.append(node)
            if with_proofs:
                steps.append([{"before": a, "after": b} for a, b in way_up])
        n, size = len(leaves), fanout**levels
        columns = [table.column("doc_id"), table.column("source"), pa.array([block * size + i for i in range(n)], pa.int64()), table.column("leaf")]
        columns += [pa.array(c, pa.string()) for c in ([subroot] * n, [root] * n, proofs, folded)] + [pa.array([x == root for x in folded], pa.bool_())]
        return pa.Table.from_arrays(columns + ([pa.array(steps, STEPS)] if with_proofs else []), schema=schema)

    sql = MANIFEST_SQL + (f", proof {UP}" if with_proofs else "")
    return placed.groupBy("rank", "block").cogroup(ways.groupBy("rank", "block")).applyInArrow(prove, sql)
