"""Byte-level BPE against the public library, chunk by chunk and whole."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from pyspark.sql import functions as F
from txquality.llm import byte_bpe, queries
from txquality.llm.common import stored

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n", "don't we'll 'RE it'S '''s #'s! I've we're", "a  b   c\n\n\n d \t e  ", "Ünïcode straße ß ç é ñ", "日本語 text 12３ ½ x²y_z__1",
    "<|endoftext|> </w>", "a b\x85c\x1cd\x1fe　f", "é combining Å K 🙂🙃👩‍👩‍👧", "x" * 5_000, "ab" * 3_000, " " * 900 + "x" + " " * 900, "1" * 700 + "!" * 700,
    "नमस्ते दुनिया привет мир", "tab\tline\r\n\r\nline ",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def mixed_text(rng, n):
    kinds = [lambda: rng.choice(["sun", "moon", "isn't", "Straße", "日本", "…", "'re", "''", "x1y2"]), lambda: " " * rng.randrange(1, 40), lambda: "\n" * rng.randrange(1, 4)]
    kinds += [lambda: chr(rng.randrange(32, 0x2FFF)) * rng.randrange(1, 30), lambda: "q" * rng.randrange(1, 90), lambda: str(rng.randrange(10**9))]
    return "".join(rng.choice(kinds)() + rng.choice(["", " "]) for _ in range(n))


def test_every_character_splits_as_in_the_library(library):
    encode = byte_bpe.Encoder(PATH)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 7 == 0):
            text = f"a{chr(c)}b 1{chr(c)}2  {chr(c)}{chr(c)} x.{chr(c)}!"
            assert np.frombuffer(encode(text), "<u4").tolist() == library.encode_ordinary(text), hex(c)


def test_pieces_are_merged_as_in_the_library(library):
    rng, encode = random.Random(1), byte_bpe.Encoder(PATH, cache_bytes=2_000)
    texts = [t or "" for t in TEXTS] + [mixed_text(rng, 60) for _ in range(200)] + ["".join(rng.choice("abe ") for _ in range(400)) for _ in range(50)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert encode.kept_bytes <= 2_000


def test_chunks_cover_the_text():
    for n in (0, 1, 7, 8, 9, 10, 11, 16, 17, 18, 19, 40):
        text = "".join(chr(97 + i % 26) for i in range(n))
        parts = byte_bpe.chunks_of(text, 8, 3)
        assert [at for at, _ in parts] == [8 * k for k in range(len(parts))]
        assert all(text[at : at + 11] == t if k < len(parts) - 1 else text[at:] == t for k, (at, t) in enumerate(parts))


@pytest.mark.parametrize("chunk, overlap", [(16, 9), (40, 12), (64, 64), (32_768, 1_024)])
def test_equals_library_and_round_trip(spark, make_docs, library, chunk, overlap):
    rng = random.Random(chunk)
    texts = TEXTS + [mixed_text(rng, rng.randrange(1, 120)) for _ in range(60)]
    docs = make_docs(list(enumerate(texts)))
    encoded = byte_bpe.encode(docs, chunk=chunk, overlap=overlap)
    rows = {r.doc_id: r for r in byte_bpe.decode(encoded).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == library.encode_ordinary(text or ""), text
        assert rows[i].n_tokens == len(rows[i].ids) // 4 and bytes(rows[i].decoded).decode() == (text or "")


def test_long_texts_are_cut_where_chunks_resynchronise(make_docs):
    text = " ".join(f"word{i}" for i in range(400))
    chunks = byte_bpe.long_texts(make_docs([(1, text), (2, "k" * 900)]), public_tokenizers.PATTERN, 100, 20)
    assert chunks.count() > 20
    pieces = {}
    for r in byte_bpe.stitched(stored(chunks), public_tokenizers.PATTERN, 20).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.text))
    assert len(pieces[1]) > 20 and "".join(t for _, t in sorted(pieces[1])) == text
    whole = {m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)}
    ends = [sum(len(t) for _, t in sorted(pieces[1])[:k]) for k in range(len(pieces[1]))]
    assert whole.issuperset(ends) and [t for _, t in pieces[2]] == ["k" * 900]


@pytest.mark.parametrize("pattern", [r"[\s\S]{1,7}", r"aaa|[^a]+|a", r"ab|ba|\S|\s+(?!\S)|\s", r"aa?a?a?a?b?|b+| +"])
def test_patterns_that_resynchronise_late_or_never(spark, make_docs, pattern):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a" * rng.randrange(1, 90), "b" * rng.randrange(1, 3), " "]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    rows = byte_bpe.encode(make_docs(list(enumerate(texts))), pattern=pattern, chunk=30, overlap=10).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])


def test_odd_rows_and_names(make_docs, library):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(None, "a b"), (None, "a b"), (3, long), (3, long), (3, long + "!"), (4, "z" * 120_000), (5, None), (6, "")]
    docs = make_docs(rows)
    for name in ("ids", "row", "part", "piece", "start", "head", "tail", "parts", "stitch", "last"):
        docs = docs.withColumn(name, F.lit("clash"))
    out = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in byte_bpe.encode(docs).collect()))
    expected = sorted(((k is not None, k or 0, len(library.encode_ordinary(t or ""))) for k, t in rows))
    assert out == expected
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        byte_bpe.encode(docs, overlap=3)


def test_query(spark, sf_dir, library):
    out = {r.doc_id: tuple(r)[1:] for r in queries.op11_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        assert out[doc_id] == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((text or "").encode()).hexdigest())
