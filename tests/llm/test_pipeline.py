"""The pipeline against plain Python versions of its stages over what each predecessor kept."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from test_decontaminate import overlaps as window_overlap
from test_jaccard_join import all_pairs

from txquality.llm import line_dedup, packing

SF = "/root/testdata/sf0.001"


def in_order(texts):
    """doc_id -> (text, chunks cut), document by document; the chunks themselves are tested in test_line_dedup."""
    first, out = {}, {}
    for key in sorted(texts):
        raw, cuts = texts[key].encode(), []
        for _, _, a, size, *steps in zip(*(c.tolist() for c in line_dedup.chunks_of([texts[key]]))):
            low, high, beside = a, a + size, []
            for n in steps[: line_dedup.STEPS]:
                low -= n
                beside.append(raw[low : low + n])
            for n in steps[line_dedup.STEPS :]:
                beside.append(raw[high : high + n])
                high += n
            old = first.setdefault(raw[a : a + size], beside)
            if old is not beside:
                agree = [x == y for x, y in zip(beside, old)]
                more = [sum(n for k, n in enumerate(side) if all(same[: k + 1])) for side, same in ((steps[:3], agree[:3]), (steps[3:], agree[3:]))]
                cuts.append((a - more[0], a + size + more[1]))
        left, at = [], 0
        for a, b in sorted(cuts):
            left.append(raw[at:a])
            at = max(at, b)
        out[key] = (b"".join([*left, raw[at:]]).decode().strip(" ") if cuts else texts[key], len(cuts))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, states = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        states.append({r.doc_id: r.text for r in docs.collect()})
    start, good, deduped, single, clean = states
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(i in good) == bool(q) for i, q in quality.items()]
    assert sum(right) >= 0.9 * len(right) and all(start[i] == t for i, t in good.items())
    assert deduped == {i: t for i, (t, cut) in in_order(good).items() if not cut or t.strip()}
    assert single == {i: deduped[i] for i, (root, _) in all_pairs(list(deduped.items())).items() if i == root}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean == {i: t for i, t in single.items() if not any(window_overlap(t, x) for x in items)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ids = packing.document_ids(list(clean.values()), packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")))
    assert sum(r.length for r in packed) == sum(len(x) // 4 for x in ids) and {r.doc_id for r in packed} == set(clean)


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f g h i"), (3, "a b c d e f g h i"), (3, "a b c d e f g h i"), (4, "word " * 60_000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, frame, SF)
            assert out.count() >= 0, name
