"""Decontamination against sliding windows over all pairs of texts."""

from __future__ import annotations

import itertools
import random

import pytest

from txquality.llm import decontaminate as d
from txquality.llm.queries import QUERIES

RNG = random.Random(1)
ITEMS = [(i, " ".join(f"b{RNG.randrange(400)}" for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 7, 8, 10, 13, 20, 40, 59, 30])]


def filler(n):
    return [f"f{RNG.randrange(400)}" for _ in range(n)]


def overlaps(text, item):
    """Windows of the item's needed agreement on any diagonal, tried one by one."""
    a, b = d.words_of(text), d.words_of(item)
    w = min(d.WINDOW, len(b))
    return any(sum(x == y for x, y in zip(a[i : i + w], b[j : j + w])) >= d.needed(len(b), d.WINDOW, d.SHARE) for i in range(len(a) - w + 1) for j in range(len(b) - w + 1))


def planted():
    rows = []
    for i, text in ITEMS:
        w = text.split()
        rows.append(filler(30) + w + filler(30))
        if len(w) >= 20:
            changed = [x if k % 6 else "zzz" for k, x in enumerate(w)]
            rows += [filler(5) + changed + filler(9), filler(50) + w[:13] + filler(3), filler(20) + w[3:9] + filler(20)]
    rows += [filler(200), w * 40]
    return [(i, " ".join(r).upper() if i % 5 == 0 else ", ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block_words", [400_000, 60])
def test_equals_all_windows(spark, make_docs, monkeypatch, block_words):
    rows = planted()
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    full = d.benchmark_blocks
    monkeypatch.setattr(d, "benchmark_blocks", lambda b: full(b, block_words))
    found = {(r.doc_id, r.item_id) for r in d.overlaps(make_docs(rows), bench).collect()}
    assert found == {(i, k) for i, text in rows for k, item in ITEMS if overlaps(text, item)}
    kept = {r.doc_id for r in d.clean(make_docs(rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in found}


def test_places(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    row = d.overlaps(make_docs([(1, " ".join(["x"] * 7 + ITEMS[8][1].split() + ["y"] * 4))]), bench).first()
    assert (row.item_id, row.matched_words, row.window_words, row.first_word, row.last_word) == (8, 13, 13, 7, 26)


def test_odd_rows(spark, make_docs):
    bench = spark.createDataFrame([*ITEMS, (None, "q"), (50, None), (51, ""), (52, "..."), (8, ITEMS[8][1])], "item_id bigint, text string")
    rows = [(1, None), (2, ""), (None, ITEMS[9][1]), (3, ITEMS[9][1]), (3, ITEMS[9][1]), (4, "the " * 200_000)]
    found = d.overlaps(make_docs(rows), bench).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.item_id) for r in found) == [(False, 3, 9), (False, 3, 9), (True, None, 9)]
    assert d.overlaps(make_docs(rows), bench.limit(0)).count() == 0 and d.overlaps(make_docs([]), bench).count() == 0
    clean = d.clean(make_docs(rows), bench)
    assert clean.count() == 3 and clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_query_finds_whole_items(spark):
    sf = "/root/testdata/sf0.01"
    norm = lambda t: " " + " ".join(d.words_of(t or "")) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = {i for i, t in docs.items() if any(x in t for x in items)}
    assert whole and whole <= {r.doc_id for r in QUERIES["op10_decontaminate"](spark, sf).collect()}


@pytest.mark.parametrize("words", range(1, 14))
def test_no_allowed_pattern_is_missed(words):
    need = d.needed(words, d.WINDOW, d.SHARE)
    masks = d.masks_for(words, d.WINDOW, d.SHARE)
    for kept in itertools.combinations(range(words), need):
        assert any(all(p + s in kept for p in m) for m in masks for s in range(words - m[-1])), kept


@pytest.mark.parametrize("words", [8, 9, 12, 13])
def test_substitutions_in_short_items_are_found(spark, make_docs, words):
    item = [f"b{i}" for i in range(words)]
    allowed = words - d.needed(words, d.WINDOW, d.SHARE)
    patterns = list(itertools.combinations(range(words), allowed))
    rows = [(i, " ".join(filler(9) + ["zzz" if k in e else w for k, w in enumerate(item)] + filler(9))) for i, e in enumerate(patterns)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert sorted(r.doc_id for r in d.overlaps(make_docs(rows), bench).collect()) == list(range(len(patterns)))


def test_clashing_columns_stay(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = make_docs([(1, ITEMS[9][1]), (2, "x")]).selectExpr("*", "1 as item_id", "'a' as matched_words", "doc_id as _mark")
    assert [r.doc_id for r in d.clean(docs, bench).collect()] == [2] and d.clean(docs, bench).columns == docs.columns
    assert {(r.doc_id, r.item_id) for r in d.overlaps(docs, bench).collect()} == {(1, 9)}
