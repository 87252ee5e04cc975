"""Periodic runs against a comparison of all words with those one period on, for every period."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from pyspark.sql import functions as F
from txquality.llm import queries, word_runs


def plain(words, min_length=12):
    """Every maximal stretch with period q that no smaller period explains."""
    n, seen = len(words), set()
    out = []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(min_length, 2 * q) and (start, length) not in seen:
                seen.add((start, length))
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    inside = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in inside]


def samples(rng):
    for size in (1, 2, 3, 5):
        for _ in range(60):
            yield [str(rng.randrange(size)) for _ in range(rng.randrange(0, 70))]
    a, b = ["0"], ["0", "1"]
    while len(b) < 150:
        a, b = b, b + a
    yield b
    yield ["x"] * 100
    for _ in range(60):  # periodic tails, nested periods and repeated far lines
        line = [str(rng.randrange(900)) for _ in range(rng.randrange(1, 15))]
        unit = line * rng.randrange(1, 4) + [str(rng.randrange(900)) for _ in range(rng.randrange(0, 9))]
        own = [str(rng.randrange(900)) for _ in range(rng.randrange(0, 40))]
        yield own + unit * rng.randrange(1, 5) + unit[: rng.randrange(len(unit))] + own + line + own + line


@pytest.mark.parametrize("min_length", [12, 2, 7])
def test_runs_are_all_runs(min_length):
    for words in samples(random.Random(4)):
        raw = [w.encode() for w in words]
        expected = plain(words, min_length)
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([numbers[w] for w in words], np.int32)
        assert sorted(word_runs.runs_within(ids, min_length), key=lambda r: (r[0], r[2])) == expected, words
        assert word_runs.runs_of(raw, min_length) == expected, words
        assert word_runs.collapse(raw, expected) == [w.encode() for w in collapsed(words, expected)]


def test_access_knows_the_last_ends():
    """The segments of every prefix against a search for each of its suffixes."""
    rng = random.Random(8)
    for size in (1, 2, 4):
        for _ in range(12):
            seq = [rng.randrange(size) for _ in range(40)]
            ends = word_runs.LastEnds()
            for e, w in enumerate(seq):
                segments = [s for s in ends.append(w) if s[1] > 0]
                found = {}
                below = 0
                for end, length in sorted(segments, key=lambda s: s[1]):
                    found |= {n: end for n in range(below + 1, length + 1)}
                    below = length
                for n in range(1, e + 2):
                    suffix = seq[e - n + 1 : e + 1]
                    last = max((k for k in range(n - 1, e) if seq[k - n + 1 : k + 1] == suffix), default=None)
                    assert found.get(n) == last


def test_whole_texts(make_docs):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    unit = [f"u{i}" for i in range(7_000)]
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, "a b " * 9), (None, "a b " * 9), (4, "a b c d " * 6)]
    rows += [(5, " ".join(long[:70_000] + unit * 2 + unit[:50] + long[70_000:])), (6, "é ü\n" * 40_000), (7, "a b " * 5), (7, "q")]
    docs = make_docs(rows)
    for name in ("runs", "collapsed", "best", "n_words", "start", "period"):
        docs = docs.withColumn(name, F.lit(1))
    out = word_runs.find_runs(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert by[1] == by[2] == by[3] == [(0, [], "")]
    assert by[None] == [(18, [(0, 18, 2)], "a b")] * 2
    assert by[4] == [(12, [(0, 12, 2)], "a b c d")]
    assert by[5] == [(164_050, [(70_000, 14_050, 7_000)], " ".join(long[:70_000] + unit + long[70_000:]))]
    assert by[6] == [(80_000, [(0, 80_000, 2)], "é ü")]
    assert sorted(by[7]) == [(1, [], "q"), (10, [], " ".join("ab" * 5))]
    assert word_runs.find_runs(docs.limit(0)).count() == 0


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_query(spark, sf_dir):
    out = {r.doc_id: tuple(r)[1:] for r in queries.op12_word_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    with_runs = 0
    for doc_id, text in docs:
        words = planted(doc_id, text)
        if len(words) > 1_500:
            continue
        runs = plain(words)
        with_runs += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected = (len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        expected += tuple(sha256(x.encode()).hexdigest() for x in (lines, " ".join(collapsed(words, runs))))
        assert out[doc_id] == expected
    assert with_runs >= 10
