"""Merkle manifests against a tree built whole in Python."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from oracle import compare, connect

from pyspark.sql import functions as F
from txquality.llm import merkle, queries


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """(root, list of proofs): a proof is a list of (before, after)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            low = i - i % fanout
            proofs[k].append((nodes[low:i], nodes[i + 1 : low + fanout]))
            at[k] = i // fanout
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def plain(rows, fanout, found=lambda row: row[1]):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = (own, *climb([leaf_of(r) for r in own], fanout))
    root, tops = climb([trees[name][1] for name in names], fanout)
    out = []
    for name, top in zip(names, tops):
        own, subroot, proofs = trees[name]
        for row, proof in zip(own, proofs):
            way = proof + top
            node = leaf_of((row[0], found(row), *row[2:]))
            for before, after in way:
                node = h("".join(before) + node + "".join(after))
            joined = "".join("".join(a + b) for a, b in way)
            out.append((row[0], leaf_of(row), subroot, root, h(joined), node, node == root))
    return sorted(out, key=str)


def corpus(n, sources, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if rng.random() < 0.05 else "hot" if rng.random() < 0.35 else f"é{rng.randrange(sources)}" if rng.random() < 0.3 else f"s{rng.randrange(sources)}"
        rows.append((i * 3, rng.choice([None, "", "Some Text é", f"Own Text {i}"]), rng.choice([None, "en"]), source, rng.choice([None, i])))
    return rows


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found_rows(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


@pytest.mark.parametrize("n, sources, fanout, levels", [(1, 1, 16, 3), (17, 1, 16, 1), (400, 40, 3, 1), (700, 5, 2, 2), (300, 3, 4, 0), (260, 30, 16, 3)])
def test_equals_whole_tree(spark, n, sources, fanout, levels):
    rows = corpus(n, sources)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    changed = F.when(F.col("doc_id") % 2 == 0, F.upper("text"))
    found = found_rows(merkle.manifest(docs, changed, fanout, levels))
    assert found == plain(rows, fanout, lambda r: r[1].upper() if r[1] is not None and r[0] % 2 == 0 else r[1])


def test_proofs_lead_to_the_root(spark):
    rows = corpus(300, 6)
    docs = spark.createDataFrame(rows, DOCS)
    out = merkle.manifest(docs, fanout=4, levels=1, with_proofs=True).collect()
    places = {}
    for r in out:
        node = r.leaf
        for step in r.proof:
            node = h(step.before + node + step.after)
        assert node == r.root and r.verified
        assert h("".join(s.before + s.after for s in r.proof)) == r.proof_sha256
        places.setdefault(r.source, []).append((r.position, r.doc_id))
    for found in places.values():
        assert [p for p, _ in sorted(found)] == list(range(len(found))) and sorted(found) == sorted(found, key=lambda x: x[1])


def test_odd_rows_and_names(spark):
    rows = [(None, "a", None, "s", 1), (None, "a", None, "s", 1), (5, "X" * 300_000, "en", "s", 2), (5, "other", "en", "s", 2), (5, "other", "en", "s", 2)] * 3
    rows += [(-7, None, None, None, None), (8, "", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("leaf", "rank", "block", "blocks", "place", "part", "n", "up", "node", "tie", "root", "found", "_child", "before"):
        docs = docs.withColumn(name, F.lit("clash"))
    lower = F.when(F.col("doc_id") == 5, F.lower("text"))
    found = merkle.manifest(docs, lower, fanout=2, levels=1)
    assert found_rows(found) == plain(rows, 2, lambda r: r[1].lower() if r[0] == 5 else r[1])
    empty = merkle.manifest(docs.limit(0))
    assert empty.count() == 0 and empty.columns[:1] == ["doc_id"]


def test_query(spark, sf_dir):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def found(row):
        return row[1].translate(upper) if row[1] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else row[1]

    df = queries.op13_merkle(spark, sf_dir)
    out = found_rows(df)
    assert out == plain(rows, 16, found) and not all(r[-1] for r in out)


def test_query_equals_sql(spark, sf_dir):
    compare(spark, connect(sf_dir), queries.op13_merkle, queries.ORACLES["op13_merkle"], sf_dir)
