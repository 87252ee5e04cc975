"""Toxicity: Viterbi against all readings, held-out accuracy, disguised words, odd rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txquality.llm import toxicity
from txquality.llm.queries import QUERIES

WORDS = ["garden", "window", "bottle", "summer", "letter", "winter", "carpet", "pillow", "ribbon", "silver"]
BAD = ["scumbag", "dimwit"]


@pytest.fixture(scope="module")
def case(spark, make_docs):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(10, 40))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(BAD)
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(1000, "garden sc0mbag d1mwit window"), (1001, "letter s c u m b a g pillow"), (1002, "carpet d.i.m.w.i.t bottle"), (1003, "scuuumbag winter"), (1004, "garden win7er 1999 bottle"),
             (1005, None), (1006, ""), (1007, "garden " * 100_000), (None, "dimwit"), (1008, "dimwit"), (1008, "dimwit")]
    return make_docs(docs), spark.createDataFrame([*labels, (None, 1), (3, None), (7, 0)], "doc_id bigint, label int")


def test_counts_equal_a_plain_count(make_docs):
    texts = ["Abc é.", None, "", "ab", "ab"]
    logp = toxicity.character_model(make_docs(list(enumerate(texts))))
    three = np.zeros((28, 28, 28))
    c = toxicity.letter_codes("  " + "  ".join((t or "").lower() for t in texts) + "  ")
    np.add.at(three, (c[:-2], c[1:-1], c[2:]), 1)
    a, b = toxicity.code("a"), toxicity.code("b")
    two = three.sum(0)
    own = (three[0, a, b] + 5 * (two[a, b] + 1) / (two[a].sum() + 28)) / (three[0, a].sum() + 5)
    assert abs(np.exp(logp[0, a, b]) - own) < 0.05
    assert np.allclose(np.exp(logp).sum(2), 1)


def test_decode_is_the_best_of_all_readings():
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(28), (28, 28)))
    own = toxicity.Restorer(logp)
    for word in ("1d!0t", "s*um", "a$$b", "looool", "x.y-z", "l33+", "é1a"):
        best = None
        for path in itertools.product(*own.lattice(word)):
            text, cost = "".join(p[0] for p in path), sum(p[1] for p in path)
            x = y = 0
            for ch in text:
                cost += logp[x, y, toxicity.code(ch)]
                x, y = y, toxicity.code(ch)
            cost += logp[x, y, 0]
            best = max(best or (cost, text), (cost, text))
        assert own.decode(word) == best[1], word


def test_scores(case):
    docs, labels = case
    found = {r.doc_id: r for r in toxicity.classify(docs, labels, F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))).collect()}
    held = [r for i, r in found.items() if i is not None and i < 1000 and r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert [found[i].predicted for i in (1001, 1002, 1003, 1008, None)] == [1] * 5
    assert [found[i].predicted for i in (1004, 1005, 1006, 1007)] == [0] * 4


def test_restored_text(case):
    docs, _ = case
    logp = toxicity.character_model(docs)
    text = {r.doc_id: r.text for r in toxicity.restored(docs, logp).collect()}
    assert text[1001] == "letter scumbag pillow" and text[1002] == "carpet dimwit bottle" and text[1005] == ""


def test_without_labels_and_rows(case, make_docs):
    docs, labels = case
    assert {r.score for r in toxicity.classify(docs, labels.where("label = 0"), F.lit(False)).collect()} == {0.0}
    assert toxicity.classify(make_docs([]), labels, F.lit(False)).count() == 0


def test_query_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op3_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9
