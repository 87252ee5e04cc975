"""Language identification by error-correcting output codes.

Every language gets a codeword; bit b splits the languages in two, and a binary n-gram classifier learns that split: the log
ratio of the hashed byte n-gram distributions of its two sides, averaged over the n-grams of a text. Decoding is
weighted by loss: a language costs the sum over bits of log(1 + exp(-codeword sign x evidence)), bits that told the training
rows apart worse count less, the cheapest codeword wins, and near ties are flagged as ambiguous.

One pass counts n-grams per language over a bounded sample of labelled rows (sums per partition, added up in Spark), one
pass over all whole texts predicts. Only tables of ``2 * BUCKETS`` numbers per language meet in the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import batch_of, bounded_sample, runs, texts_of, values_of

BUCKETS = 1 << 14  # per order of n-gram; orders 2 and 3 of utf-8 bytes
TRAIN_ROWS = 30_000
CHUNK_BYTES = 1 << 20
ALNUM = re.compile(r"[^\W\d_]")
PREDICTED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("runner_up", pa.string()), ("ambiguous", pa.bool_())]
)
PREDICTED_SQL = "doc_id bigint, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean"


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in ALNUM.finditer(text))


def codewords(languages: int) -> np.ndarray:
    """Signs, one row per language: all splits up to five languages, else random ones with the best least distance."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        splits = [[1] + [1 if s >> i & 1 else -1 for i in range(languages - 1)] for s in range(2 ** (languages - 1) - 1)]
        return np.array(splits, np.int8).T
    bits, best, least = max(15, int(np.ceil(10 * np.log2(languages)))), None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (languages, bits))
        code[:, (code == code[0]).all(0)] *= np.where(np.arange(languages) % 2, -1, 1)[:, None].astype(np.int8)
        far = ((bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(languages, dtype=int)).min()
        if far > least:
            best, least = code, far
    return best


def gram_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of orders 2 and 3, shape (2, bytes), and the starts of the texts; each text ends with two padding bytes."""
    raw = np.frombuffer(b"\0\0".join(texts) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    two = raw[:-2] << np.uint32(8) | raw[1:-1]
    three = two << np.uint32(8) | raw[2:]
    hashed = np.stack([two * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA6B)]) >> np.uint32(18)
    sizes = np.array([len(t) + 2 for t in texts])
    return hashed[:, : sizes.sum()], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def encoded(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "replace") for t in texts]


def blocks(texts: list[bytes]):
    """(index of the first text, texts) of about CHUNK_BYTES; a longer text comes in several blocks, the cut ones with index."""
    for a, b in runs([len(t) for t in texts], CHUNK_BYTES):
        if b - a == 1 and len(texts[a]) > CHUNK_BYTES:
            for at in range(0, len(texts[a]), CHUNK_BYTES):
                yield a, [texts[a][at : at + CHUNK_BYTES]]
        else:
            yield a, texts[a:b]


def gram_counts(train: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts (language, order * BUCKETS + bucket) over (text, lang), summed per partition and then in Spark."""
    number = {l: i for i, l in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), 2 * BUCKETS), np.int64)
        for batch in batches:
            texts, langs = encoded(texts_of(batch)), values_of(batch, "lang")
            for lang in set(langs):
                own = [t for t, l in zip(texts, langs) if l == lang]
                for _, part in blocks(own):
                    ids, _ = gram_ids(part)
                    total[number[lang], :BUCKETS] += np.bincount(ids[0], minlength=BUCKETS)
                    total[number[lang], BUCKETS:] += np.bincount(ids[1], minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket], pa.int64())], ["lang", "bucket", "n"]
        )

    summed = train.select("text", "lang").mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()  # at most languages x 2 x BUCKETS rows
    out = np.zeros((len(languages), 2 * BUCKETS))
    out[found["lang"], found["bucket"]] = found["n"]
    return out


class Codes:
    """The learned bits: ``weights`` (bits, 2 * BUCKETS), codewords, a weight per bit and the language names."""

    def __init__(self, counts: np.ndarray, languages: list[str]):
        self.languages, self.code = languages, codewords(len(languages))
        if len(languages) < 2:
            self.weights, self.bit_weight = np.zeros((1, 2 * BUCKETS), np.float32), np.ones(1)
            return
        by_order = counts.reshape(len(languages), 2, BUCKETS) + 0.5
        share = (by_order / by_order.sum(2, keepdims=True)).reshape(len(languages), -1)
        weights, trust = [], []
        for bit in self.code.T:
            w = np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0))
            weights.append(w)
            trust.append(np.min(bit * (share @ w)))  # evidence for the language that this bit tells apart worst
        self.weights = np.array(weights, np.float32)
        trust = np.maximum(np.array(trust), 0.05 * max(np.max(trust), 1e-9))
        self.bit_weight = trust / trust.sum() * len(trust)

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of weights per bit, and the number of n-grams, of each text."""
        raw = encoded(texts)
        total, n = np.zeros((len(texts), len(self.weights))), np.array([2 * len(t) for t in raw])
        for first, part in blocks(raw):
            ids, starts = gram_ids(part)
            ids[1] += np.uint32(BUCKETS)
            inside = np.ones(ids.shape[1], bool)
            ends = starts + np.array([len(t) for t in part])
            inside[ends], inside[ends + 1] = False, False  # windows that begin in the padding
            for bit, w in enumerate(self.weights):
                total[first : first + len(part), bit] += np.add.reduceat((w[ids[0]] + w[ids[1]]) * inside, starts)
        return total, n

    def decode(self, texts: list[str], flag_below: float = 0.9):
        """Language, score, runner-up and ambiguity of each text with a letter."""
        total, n = self.evidence(texts)
        z = np.clip(total / np.sqrt(np.maximum(n, 1))[:, None], -30, 30)
        loss = (np.logaddexp(0, -z[:, None, :] * self.code[None]) * self.bit_weight).sum(2)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        share = odds / odds.sum(1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        best = share[np.arange(len(share)), order[:, 0]]
        second = order[:, 1] if len(self.languages) > 1 else order[:, 0]
        return order[:, 0], best, second, best < flag_below


def train(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> Codes:
    """Learn from (doc_id, text, lang): rows with null lang, or a text without letters, teach nothing.

    About ``max_rows`` rows are used, chosen by a hash of doc_id.
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    sample = bounded_sample(labelled, "doc_id", max_rows, 7)
    return Codes(gram_counts(sample, languages) if languages else np.zeros((0, 2 * BUCKETS)), languages)


def predict(docs: DataFrame, model: Codes, held_out=None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, runner_up, ambiguous) per row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned.
    """

    def score(batches):
        for batch in batches:
            keys, held, texts = values_of(batch, "doc_id"), values_of(batch, "_held"), texts_of(batch)
            for a, b in runs([len(t) for t in texts], CHUNK_BYTES):
                some = [i for i in range(a, b) if model.languages and has_letter(texts[i])]
                lang, value, second, unsure = ["und"] * (b - a), [0.0] * (b - a), [None] * (b - a), [True] * (b - a)
                if some:
                    for i, best, s, other, u in zip(some, *model.decode([texts[i] for i in some])):
                        lang[i - a], value[i - a], unsure[i - a] = model.languages[best], float(s), bool(u)
                        second[i - a] = model.languages[other] if other != best else None
                yield batch_of(PREDICTED, doc_id=keys[a:b], held_out=held[a:b], lang_pred=lang, score=value, runner_up=second, ambiguous=unsure)

    held_out = F.lit(None).cast("boolean") if held_out is None else held_out
    return docs.select("doc_id", "text", held_out.alias("_held")).mapInArrow(score, PREDICTED_SQL)
