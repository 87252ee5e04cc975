"""The join against all pairs of a small corpus."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from txquality.llm import jaccard_join
from txquality.llm.components import components, star_edges


def grams(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def all_pairs(rows, threshold=0.8):
    sets = {k: grams(t) for k, t in dict(rows).items()}
    ids, parent, n = sorted(sets), {k: k for k in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (find(k), n[k]) for k in ids}


def corpus():
    rng = random.Random(1)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([rows[3][1]] * 5 + ["a b c", "A b  c", "a b", "one two three four five"] * 2)]
    return rows


def test_equals_all_pairs(make_docs):
    rows = corpus()
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(make_docs(rows), block=5).collect()}
    assert found == all_pairs(rows)


def test_blocks_change_nothing(make_docs):
    rows = corpus()[:60]
    small, large = ({r.doc_id: (r.class_id, r.n_links, r.kept) for r in jaccard_join.join(make_docs(rows), block=b).collect()} for b in (2, 256))
    assert small == large


def test_odd_rows(make_docs):
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f"), (7, "v " * 100_000)]
    found = {r.doc_id: r for r in jaccard_join.join(make_docs(rows)).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, 7}
    assert all(found[i].n_links == 0 and found[i].class_id == i and found[i].kept for i in (1, 2, 3, 4, 7))
    assert (found[6].class_id, found[6].n_links, found[5].n_links, found[6].kept) == (5, 1, 1, False)
    left = sorted((r.doc_id if r.doc_id is not None else -1) for r in jaccard_join.one_of_each(make_docs(rows)).collect())
    assert left == [-1, 1, 2, 3, 4, 5, 7]
    assert jaccard_join.join(make_docs([])).count() == 0


def test_prefixes_are_shortened_until_the_target():
    j = jaccard_join
    plain = j.lengths_for([0] * j.TREES, 0.8, j.TARGET)
    assert len(set(plain)) == 1 and j.missed(plain, 0.8) <= 1 - j.TARGET < j.missed([plain[0] + 1] * j.TREES, 0.8)
    some = j.lengths_for([8] * 5 + [0] * 15, 0.8, j.TARGET)
    assert some == [8] * 5 + [4] * 15 and j.missed(some, 0.8) <= 1 - j.TARGET
    rng = random.Random(3)
    for _ in range(200):
        own = j.lengths_for([rng.choice([0, 0, 4, 6, 8]) for _ in range(j.TREES)], 0.8, j.TARGET)
        assert j.missed(own, 0.8) <= 1 - j.TARGET
    assert j.lengths_for([0] * j.TREES, 0.99, j.TARGET)[0] == j.DEPTH and j.least_depth(0.3, j.TARGET) < j.LEAST_DEPTH


def test_chosen_equals_the_plain_form(spark):
    j, rng = jaccard_join, random.Random(4)
    cases = [[rng.choice([0, 0, 4, 6, 7, 8]) for _ in range(j.TREES)] for _ in range(60)] + [[8] * j.TREES, [0] * j.TREES]
    df = spark.createDataFrame([(c,) for c in cases], "c array<int>")
    found = df.select("c", j.chosen(F.col("c"), 0.8, j.TARGET, j.DEPTH, j.LEAST_DEPTH).alias("ks")).collect()
    assert all(r.ks == j.lengths_for(r.c, 0.8, j.TARGET) for r in found)


def test_crowded_nodes_lose_no_link(make_docs):
    """Texts that share two thirds of boilerplate, and a group of near copies, with nodes that count as crowded from three documents."""
    rng = random.Random(6)
    plate = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join(plate + [f"u{rng.randrange(10**6)}" for _ in range(25)])) for i in range(60)]
    base = [f"b{i}" for i in range(120)]
    for i in range(30):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((100 + i, " ".join(w)))
    want = all_pairs(rows)
    assert any(n for _, n in want.values())
    for crowd in (2, 1000):
        found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(make_docs(rows), block=8, crowd=crowd).collect()}
        assert found == want, crowd


def test_clashing_columns_stay(make_docs):
    docs = make_docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "z")]).selectExpr("*", "1 as class_id", "2 as copy", "3 as trie", "4 as kept", "5 as heads")
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_recall_on_the_given_documents(spark):
    """Documents whose id 20 divides against all documents, by all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: jaccard_join.shingles(t or "") for i, t in texts.items()}
    found = {r.doc_id: r.n_links for r in jaccard_join.join(docs).collect()}
    asked = [i for i in sets if i % 20 == 0 and len(sets[i])]
    common = jaccard_join.intersections([sets[i] for i in asked], list(sets.values()))
    sizes = np.array([len(s) for s in sets.values()])
    want = [(common[k] >= 0.8 * (len(sets[i]) + sizes - common[k])).sum() - 1 for k, i in enumerate(asked)]
    assert [found[i] for i in asked] == want


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
    found = jaccard_join.intersections(sets[:5], sets[5:])
    assert (found == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()
    assert jaccard_join.intersections([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (200, 200), (103, 100)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    linked = np.zeros((4, 4), bool)
    linked[0, 2] = linked[2, 3] = True
    assert sorted(star_edges(np.array([9, 1, 5, 7]), linked)) == [(5, 7), (5, 9)]


def test_paths_are_looked_up_without_a_row_for_every_document(spark):
    """Whether a node is open is asked once a label; no join on node keys brings rows of both sides together."""
    rows = [(i, [7] * jaccard_join.TREES, [i % 3] * jaccard_join.TREES) for i in range(40)]
    classes = spark.createDataFrame(rows, "doc_id bigint, heads array<bigint>, tails array<bigint>")
    placed = jaccard_join.opened(classes, 0.8, 0.9995, 4, jaccard_join.DEPTH, jaccard_join.LEAST_DEPTH)
    plan = placed._jdf.queryExecution().analyzed().toString()
    assert "Join LeftSemi" in plan and not [line for line in plan.splitlines() if "Join Inner" in line and "key#" in line]
    assert placed.groupBy("doc_id", "trie").count().where("count > 1").isEmpty() and placed.count() == 40 * jaccard_join.TREES
