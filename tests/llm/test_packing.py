"""Packing against the tokenizer itself and a plain best-fit search."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from txquality.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    found = Tokenizer.from_file(VOCABULARY)
    found.encode_special_tokens = True
    return found


TEXTS = [
    None, "", " ", "plain words, twice. plain words, twice.", "don't we'll 'RE it'S '''s #'s!", "Ünïcode straße ß ç é ñ İstanbul ŉ ǰ µm",
    "日本語 text 12３ ½ x²y_z__1", "ΣΑΣ σας <|endoftext|> a</w>b", "a b\x85c\x1cd e", "é combining Å K", "x" * 3000, "tab\tline\n\nline",
]


def test_ids_are_the_tokenizers(encoder):
    for text, ids in zip(TEXTS, packing.document_ids([t or "" for t in TEXTS], packing.WordTokenizer(VOCABULARY))):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.encode(text or "", add_special_tokens=False).ids + [2]


def test_every_id_lies_in_one_piece_and_windows_have_no_gaps(make_docs, encoder):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["sun", "moon", "antidisestablishment"]) for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(0, None)])
    rows = packing.pack(docs, window=64, shard_pieces=30).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in enumerate(texts):
        ids, at = encoder.encode(text or "", add_special_tokens=False).ids + [2], 0
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert len(own) == (2 if i == 0 else -(-len(ids) // 64))
        for r in own[: len(own) // 2 if i == 0 else None]:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 500)
    window_of, offset = packing.best_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    fills = []
    for length in sorted(lengths.tolist(), reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms[rooms.index(min(fitting))] -= length
        else:
            rooms.append(100 - length)
    for w in range(window_of.max() + 1):
        fills.append(lengths[window_of == w].sum())
    assert sorted(100 - f for f in fills) == sorted(rooms)
    assert (offset + lengths <= 100).all()


def test_sequences_hold_the_ids(make_docs):
    packed = packing.pack(make_docs([(1, "one two three"), (2, "four"), (3, None)]), window=8, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert sum(r.n_ids for r in rows) == 3 + 1 + 3
    assert all(len(r.input_ids) == 4 * r.n_ids for r in rows)
    assert {r.padding for r in packing.padding(packed, 8).collect()} <= {0, 1, 2, 3, 5}


def test_full_windows_are_sequences_of_their_own(make_docs):
    long = " ".join(f"word{i % 37}" for i in range(60_000))
    rows = packing.pack(make_docs([(1, long), (2, "a b"), (None, long), (3, "")]).withColumn("sequence_id", F.lit(0)), shard_pieces=2).collect()
    full = [r for r in rows if r.length == packing.WINDOW]
    assert len(full) > 20 and len({r.sequence_id for r in full}) == len(full) and all(r.sequence_id < 0 and r.offset == 0 for r in full)
    rest = [r for r in rows if r.length < packing.WINDOW]
    assert len(rest) == 4 and all(r.sequence_id >= 0 for r in rest)
    for key in (1, None):
        own = [r for r in rows if r.doc_id == key]
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_the_words_kept_do_not_change_the_ids():
    texts = [" ".join(f"w{i * k % 91}" for i in range(300)) for k in range(9)]
    assert packing.document_ids(texts, packing.WordTokenizer(VOCABULARY, 8)) == packing.document_ids(texts, packing.WordTokenizer(VOCABULARY))


def test_empty_table(make_docs, spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string, sequence_id int, shard string")).count() == 0


def test_words_beside_marks_are_tokenized_once():
    """A word is looked up by itself, whatever marks stand beside it; ids are those of the library."""
    encode = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    model, asked = encode.model, []

    class Counting:
        def tokenize(self, letters):
            asked.append(letters)
            return model.tokenize(letters)

    encode.model = Counting()
    text = "Abgrundtief, (abgrundtief) abgrundtief. it's 'some ''s .'s a_b x1y2 O'Neil's ª don't l'été"
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.encoder.encode(text, add_special_tokens=False).ids
    assert asked.count("abgrundtief") == 1


def test_unusual_characters_are_those_of_the_pattern():
    for code in [*range(0x300), 0x212A, 0x2028, 0x4E2D, 0x1F600]:
        for text in (chr(code), f"a {chr(code)}", f"ā{chr(code)}"):
            assert packing.unusual(text) == bool(packing.UNUSUAL.search(text))
