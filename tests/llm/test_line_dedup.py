"""Line dedup against a plain version of the same rules, and against planted passages without any of them."""

from __future__ import annotations

import random
import re

import xxhash

from pyspark.sql import functions as F
from txquality.llm import line_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sentence(rng, n=None):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n or rng.randrange(4, 14))) + "."


def own_lines(text):
    """(start, end) in characters of the lines with words, without white space; no line here has more than 16 words."""
    spans, at = [], 0
    for piece in re.split(r"(\n+|(?<=[.!?])[^\S\n]+)", text):
        if piece.strip():
            assert len(piece.split()) <= line_dedup.LONG_LINE
            spans.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())))
        at += len(piece)
    return spans


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def plain_chunks(text):
    """(first line, line behind the last) of the chunks, from sums over every run and a look at every window."""
    spans = own_lines(text)
    hashes = [xxhash.xxh3_64_intdigest(text[a:b].encode(), line_dedup.SEED) for a, b in spans]
    words = [len(text[a:b].split()) for a, b in spans]
    runs = []
    for a in range(len(spans)):
        b = next((b for b in range(a + 2, len(spans) + 1) if sum(words[a:b]) >= line_dedup.MIN_WORDS), None)
        if b is not None:
            runs.append((mixed(sum(h * 0x9E3779B97F4A7C15**k for k, h in enumerate(hashes[a:b])) % 2**64), a, b))
    windows = [runs[i : max(i + 2, next((j for j in range(i, len(words)) if sum(words[i:j]) >= line_dedup.WINDOW_WORDS), len(words)))] for i in range(len(runs))]
    whole = [w for w in windows if w[-1] is not runs[-1] or len(w) > 1 and sum(words[w[0][1] : w[-1][1] + 1]) >= line_dedup.WINDOW_WORDS]
    chosen = {max(run for run in window if run[0] == min(window)[0]) for window in whole or ([runs] if runs else [])}
    out, taken = [], {}
    for h, a, b in sorted(chosen, key=lambda r: r[1]):
        if taken.get(h, 0) <= a:
            taken[h] = b
            out.append((a, b))
    return out


def backwards(text, spans, line):
    """The lines before one, eight words or the least number of lines with more, and so on."""
    for _ in range(3):
        a = line
        while a > 0 and (a == line or sum(len(text[x:y].split()) for x, y in spans[a:line]) < 8):
            a -= 1
        yield text[spans[a][0] : spans[line][0]]
        line = a


def forwards(text, spans, line):
    """The lines from one on, eight words or the least number of lines with more, and so on."""
    for _ in range(3):
        b = line
        while b < len(spans) and (b == line or sum(len(text[x:y].split()) for x, y in spans[line:b]) < 8):
            b += 1
        if b > line:
            yield text[spans[line - 1][1] : spans[b - 1][1]]
        line = b


def plain(rows):
    """doc_id -> (text, was anything cut) for ASCII texts; the first copy of every chunk stays."""
    keyed = sorted(set((k, t) for k, t in rows if k is not None and t is not None))
    first, out = {}, {}
    for key, text in keyed:
        spans, cuts = own_lines(text), []

        for a, b in plain_chunks(text):
            part = text[spans[a][0] : spans[b - 1][1]]
            if part not in first:
                first[part] = (text, spans, a, b)
                continue
            other, o, c, d = first[part]
            from_, to = spans[a][0], spans[b - 1][1]
            for mine, theirs in zip(backwards(text, spans, a), backwards(other, o, c)):
                if mine != theirs:
                    break
                from_ -= len(mine)
            for mine, theirs in zip(forwards(text, spans, b), forwards(other, o, d)):
                if mine != theirs:
                    break
                to += len(mine)
            cuts.append((from_, to))
        left, at = [], 0
        for a, b in sorted(cuts):
            left.append(text[at:a])
            at = max(at, b)
        out[key] = ("".join([*left, text[at:]]).strip(" ") if cuts else text, len(cuts))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    passage = " ".join(sentence(rng, 12) for _ in range(9))
    rows = []
    for i in range(60):
        own = [" ".join(sentence(rng) for _ in range(rng.randrange(1, 6))) for _ in range(4)]
        if i % 3 == 0:
            own.insert(rng.randrange(4), "mid sentence. " + passage + " And on.")
        if i % 7 == 0:
            own.append("\n".join(["Same line here."] * rng.randrange(2, 30)))
        rows.append((i, "\n".join(own)))
    rows += [(100 + i, rows[5][1]) for i in range(7)]
    return rows, passage


def test_lines_hold_all_words():
    for text in ("", "one", "a. b\n\nc! d?  e", "\n\nx", "é ç. Ñ", "no end\n", " " + "long words, in " * 40, "w " * 90, "一二三，" * 30 + "。x", "q" * 99):
        raw = text.encode()
        _, _, start, end, words = line_dedup.lines_of([text])
        assert b"".join(raw[a:b] for a, b in zip(start, end)).split() == b"".join(raw.split()).split() or b"".join(b"".join(raw[a:b] for a, b in zip(start, end)).split()) == b"".join(raw.split())
        assert len(words) == len(start) and all(words) and all(raw[a:b].strip() == raw[a:b] for a, b in zip(start, end))
    cut = [len(line_dedup.lines_of([t])[2]) for t in ("a. b\n\nc! d?  e", "long words, in " * 40, "x.y z", "一二三，" * 30 + "。x")]
    assert cut[0] == 5 and cut[1] >= 40 and cut[2] == 1 and cut[3] > 5


def test_chunks_are_those_of_the_plain_version():
    for _, text in corpus(9)[0]:
        spans = own_lines(text)
        expected = [(spans[a][0], spans[b - 1][1] - spans[a][0]) for a, b in plain_chunks(text)]
        _, _, first, size, *_ = line_dedup.chunks_of([text])
        assert list(zip(first.tolist(), size.tolist())) == expected


def test_texts_side_by_side_have_the_chunks_of_each():
    texts = ["", *(t for _, t in corpus(4)[0]), " \n", "一二三，四五。" * 9, "é ü. " * 40, "x", "s. " * 90, ""]
    together = [c.tolist() for c in line_dedup.chunks_of(texts)]
    alone = [(i, *row) for i, text in enumerate(texts) for row in zip(*(c.tolist() for c in line_dedup.chunks_of([text])[1:]))]
    assert list(zip(*together)) == alone and len(alone) > 100


def test_boundaries_resist_shifts():
    rng = random.Random(5)
    tail = " ".join(sentence(rng) for _ in range(40))
    first, second = (set(line_dedup.chunks_of([t])[1].tolist()) for t in (tail, sentence(rng) + " " + sentence(rng) + " " + tail))
    assert len(first & second) >= len(first) - 1


def test_equals_plain_pass(make_docs):
    rows, passage = corpus()
    found = {r.doc_id: (r.text, bool(r.removed_chunks)) for r in line_dedup.dedup(make_docs(rows)).collect()}
    assert found == {k: (t, bool(n)) for k, (t, n) in plain(rows).items()}
    assert sum(passage in t for t, _ in found.values()) == 1
    assert all(not found[100 + i][0].strip() for i in range(7))
    assert not {r.doc_id for r in line_dedup.without_repeats(make_docs(rows)).collect()} & set(range(100, 107))
    lines = lambda texts: {t[a:b] for t in texts for a, b in own_lines(t)}
    assert lines(t for t, _ in found.values()) == lines(t for _, t in rows)


def test_colliding_hashes_are_told_apart(make_docs, monkeypatch):
    one, other = "one two three four five six seven.\neight nine ten eleven twelve 13 14 15 16 17", "another line.\nwith sixteen words or more in it a b c d e f g h i"
    rows = [(1, one), (2, other), (3, one)]
    table = line_dedup.chunk_table(make_docs(rows).withColumn("text_hash", F.xxhash64("text")))
    monkeypatch.setattr(line_dedup, "chunk_table", lambda docs: table.withColumn("hash", F.lit(7).cast("bigint")))
    found = {r.doc_id: r.text for r in line_dedup.dedup(make_docs(rows)).collect()}
    assert found == {1: rows[0][1], 2: rows[1][1], 3: ""}


def test_odd_rows_and_names(make_docs):
    two = "x y z a b.\nc d e f g"
    rows = [(1, None), (2, ""), (None, two), (None, two), (3, two), (3, two), (4, "s. " * 50_000)]
    docs = make_docs(rows)
    for name in ("first", "hash", "part", "_cuts", "_chunks", "_old", "cuts", "n", "row", "left", "text_hash", "spans", "stays", "removed_chunks", "a.b"):
        docs = docs.withColumn(name, F.lit("old"))
    out = line_dedup.dedup(docs)
    found = out.collect()
    assert len(found) == len(rows) and out.columns == [c for c in docs.columns if c not in ("n_chars", "removed_chunks")] + ["n_chars", "removed_chunks", "removed_chars"]
    by = {r.doc_id: r for r in found}
    assert by[1].text is None and by[1].n_chars is None and by[2].text == "" and by[None].text == by[3].text == two and by[3]["a.b"] == "old"
    assert by[4].n_chars <= len("s. " * 40) and by[4].removed_chars == 150_000 - by[4].n_chars
    assert line_dedup.dedup(docs.limit(0)).count() == 0
    assert line_dedup.without_repeats(make_docs(rows)).columns == COLUMNS


def test_two_texts_under_one_id_keep_their_own_words(make_docs):
    rng = random.Random(6)
    shared = " ".join(sentence(rng, 9) for _ in range(7))
    own = [" ".join(sentence(rng, 9) for _ in range(12)) for _ in range(3)]
    rows = [(1, own[0] + " " + shared), (2, own[1] + " " + shared), (2, own[2])]
    found = sorted((r.doc_id, r.text.strip(), r.removed_chunks > 0) for r in line_dedup.dedup(make_docs(rows)).collect())
    assert found == sorted([(1, rows[0][1], False), (2, own[1], True), (2, own[2], False)])


def test_planted_passages_are_cut_whole(make_docs):
    """Passages of 51 to 60 words between foreign sentences of any length: the first copy stays, of the others nothing is left."""
    rng, rows, planted = random.Random(11), [], []
    for _ in range(40):
        lengths = []
        while sum(lengths) < 51:
            lengths.append(rng.randrange(2, 27))
        lengths[-1] -= max(0, sum(lengths) - 60)
        passage, first = [sentence(rng, n) for n in lengths], len(rows)
        if rng.random() < 0.3:
            passage = [p.replace(" ", ", ", 3) for p in passage]
        for _ in range(4):
            own = [sentence(rng, rng.randrange(1, 30)) for _ in range(12)]
            at = rng.randrange(13)
            rows.append((len(rows), " ".join(own[:at] + passage + own[at:]), own))
        planted.append((first, passage))
    found = {r.doc_id: r.text for r in line_dedup.dedup(make_docs([r[:2] for r in rows])).collect()}
    left = []
    for first, passage in planted:
        assert found[first] == rows[first][1]
        for i in range(first + 1, first + 4):
            own, kept = " ".join(rows[i][2]).split(), found[i].split()
            assert len(kept) >= len(own)
            left.append(len(kept) - len(own))
    # less than a step of eight words may stay at either end
    assert sum(n == 0 for n in left) >= 0.8 * len(left) and max(left) <= 14 and sum(left) <= 0.03 * 55 * len(left), left


def test_own_words_stay_and_text_without_spaces_is_counted(make_docs):
    license_text = "This text may be copied by anyone who likes it.\nIt comes without a warranty of any kind."
    unspaced = "".join(chr(0x4E00 + 37 * i) for i in range(15)) + "。" + "".join(chr(0x4E00 + 41 * i) for i in range(15)) + "。"
    rows = [(1, license_text), (2, "four words of mine\n" + license_text), (3, license_text + "\n "), (4, unspaced + "一二三"), (5, unspaced + "四五")]
    rows += [(6, "one line that stands alone in a text of mine"), (7, "one line that stands alone in a text of mine")]
    found = {r.doc_id: r.text.strip() for r in line_dedup.without_repeats(make_docs(rows)).collect()}
    assert found == {1: rows[0][1], 2: "four words of mine", 4: rows[3][1], 5: "四五", 6: rows[5][1], 7: rows[6][1]}
