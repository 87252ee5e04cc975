"""Language identification: codewords, held-out accuracy, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from txquality.llm import language_id
from txquality.llm.queries import QUERIES

LANGUAGES = {"aa": ["lorum", "ipsan", "doler"], "bb": ["zwick", "krast", "schpo"], "cc": ["éàûne", "çoeur", "bièrr"]}


def sentence(rng, lang, n):
    return " ".join(rng.choice(LANGUAGES[lang]) for _ in range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 40])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n
    if n > 1:
        assert all(len(set(bit)) == 2 for bit in code.T)
    if n > 5:
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert least >= 3


def test_held_out_languages(make_docs):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, rng.randrange(1, 40)), lang) for i, lang in enumerate(list(LANGUAGES) * 40)]
    model = language_id.train(make_docs(rows[:90]))
    found = {r.doc_id: r for r in language_id.predict(make_docs(rows), model).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows[90:])


def test_odd_rows(make_docs):
    rng = random.Random(3)
    model = language_id.train(make_docs([(i, sentence(rng, lang, 30), lang) for i, lang in enumerate(LANGUAGES)] + [(9, "x", None), (10, None, "aa")]))
    long = sentence(rng, "bb", 400_000)
    rows = [(1, None), (2, ""), (3, "123 $%&"), (4, long), (None, "lorum ipsan"), (5, "krast"), (5, "krast"), (6, "²³ ١")]
    found = language_id.predict(make_docs(rows), model).collect()
    by = {(r.doc_id): r for r in found}
    assert len(found) == len(rows)
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["und", "und", "und", "bb", "bb", "und"]
    assert by[1].score == 0 and by[None].lang_pred == "aa"


def test_prediction_does_not_depend_on_neighbours(make_docs):
    rng = random.Random(4)
    model = language_id.train(make_docs([(i, sentence(rng, lang, 30), lang) for i, lang in enumerate(LANGUAGES)]))
    texts = [sentence(rng, rng.choice(list(LANGUAGES)), rng.randrange(1, 5)) for _ in range(20)]
    together, _ = model.evidence(texts)
    alone = np.concatenate([model.evidence([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-3)


def test_nothing_learned(make_docs):
    model = language_id.train(make_docs([(1, "abc", None)]))
    assert [r.lang_pred for r in language_id.predict(make_docs([(1, "abc")]), model).collect()] == ["und"]
    assert language_id.predict(make_docs([]), model).count() == 0


def test_query_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in QUERIES["op2_language_id"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
