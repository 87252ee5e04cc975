"""Quality classifier: random Fourier features, ridge regression from partition sums, isotonic calibration.

One pass over the whole texts turns each document into a short row of statistics, kept in the shared folder. Labelled rows are
joined to those narrow rows, about ``max_rows`` of them chosen by a hash. cos(W z + b) over standardised statistics
approximates a Gaussian kernel; every partition adds up its part of the normal equations and Spark sums the parts, so
only the (D x D) system meets in the driver. A quarter of the labelled sample stays out of the fit: its scores, counted in
narrow bins, are made monotone by pooling adjacent violators.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import batch_of, bounded_sample, sliced, stored, texts_of, values_of

TRAIN_ROWS = 40_000
FEATURES = 160
RIDGE = 1e-3
BINS = 4000  # of ridge scores in [-1.5, 2.5]
LOW, HIGH = -1.5, 2.5
SEED = 11
STATISTICS = (
    "log_chars log_words word_length distinct_share distinct_growth repeat_share upper digit punctuation symbol space_share "
    "line_rate end_mark symbol_words upper_words top_share"
).split()
STATS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("_mark", pa.int64()), ("stats", pa.list_(pa.float32()))])

UPPER, DIGIT, PUNCT, SYMBOL, SPACE = 1, 2, 3, 4, 5
CLASS = np.zeros(256, np.uint8)
CLASS[ord("A") : ord("Z") + 1] = UPPER
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[[ord(c) for c in ".,;:'\"-()"]] = PUNCT
CLASS[[ord(c) for c in "!#$%&*+/<=>?@[\\]^_`{|}~"]] = SYMBOL
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
ODD_END = re.compile(r"[#$%&*+/<=>@\\^_`|~!]$")


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; all zero where it has no word."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    kind = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=6) / len(raw)
    lines = text.count("\n") + 1
    counted: dict[str, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    repeats = sum(map(str.__eq__, words, words[1:]))
    distinct = list(counted)
    odd = sum(counted[w] for w in distinct if ODD_END.search(w))
    upper = sum(counted[w] for w in distinct if w.isupper() and len(w) > 1)
    ends = sum(counted[w] for w in distinct if w[-1] in ".,;:?!")
    return [
        np.log1p(len(text)), np.log1p(n), (len(text) - n) / n, len(distinct) / n, np.log1p(len(distinct)) / np.log1p(n), repeats / n,
        kind[UPPER], kind[DIGIT], kind[PUNCT], kind[SYMBOL], kind[SPACE], np.log1p(lines) / np.log1p(n), ends / n, odd / n, upper / n,
        max(counted.values()) / n,
    ]


def document_statistics(docs: DataFrame, mark) -> DataFrame:
    """(doc_id, _mark, stats) per row, written to the shared folder. Null text counts as empty."""

    def describe(batches):
        for batch in sliced(batches):
            stats = [statistics(t) for t in texts_of(batch)]
            yield batch_of(STATS_SCHEMA, doc_id=values_of(batch, "doc_id"), _mark=values_of(batch, "_mark"), stats=stats)

    narrow = docs.select("doc_id", "text", mark.cast("bigint").alias("_mark"))
    return stored(narrow.mapInArrow(describe, "doc_id bigint, _mark bigint, stats array<float>"), "statistics")


class KernelRidge:
    """Standardisation, random features, coefficients and calibration steps. ``steps`` is None where nothing was learned."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, length: float = 1.5, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / (length * np.sqrt(len(mean))), (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.coef = np.zeros(1 + len(mean) + FEATURES)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(stats) @ self.coef, LOW, HIGH)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1; 0.5 where nothing was learned."""
        if self.steps is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("stats"))
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def normal_equations(train: DataFrame, model: KernelRidge) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over (stats, label): one upper triangle per partition, added up in Spark."""
    d = len(model.coef)
    upper = np.triu_indices(d + 1)

    def add(batches):
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            if batch.num_rows:
                f = np.hstack([model.expand(matrix(batch)), np.asarray(batch.column(1), np.float64)[:, None]])
                total += f.T @ f
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(total[upper])], ["cell", "v"])

    parts = train.select("stats", "label").mapInArrow(add, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    both = np.zeros((d + 1, d + 1))
    both[upper[0][parts["cell"]], upper[1][parts["cell"]]] = parts["v"]
    both = both + np.triu(both, 1).T
    return both[:d, :d], both[:d, d]


def pooled(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order: block centres and monotone shares."""
    blocks: list[list[float]] = []
    for centre, count, pos in zip(x, n, positive):
        blocks.append([centre * count, count, pos])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    centre, count, pos = np.array(blocks).T
    return centre / count, pos / count


def fit(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> KernelRidge:
    """Learn from (doc_id, stats, label), about ``max_rows`` rows of it. Without both labels nothing is learned."""
    sample = stored(bounded_sample(labelled, "doc_id", max_rows, 3).select("doc_id", "stats", "label"), "sample")
    d = len(STATISTICS)
    aggregates = [f(F.col("stats")[i].cast("double")) for i in range(d) for f in (F.avg, F.stddev_pop)]
    row = sample.agg(F.min("label"), F.max("label"), *aggregates).first()
    if row[0] is None or row[0] == row[1]:
        return KernelRidge(np.zeros(d), np.ones(d))
    moments = np.array(row[2:], np.float64)
    model = KernelRidge(moments[0::2], np.maximum(moments[1::2], 1e-6))
    kept_out = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4)) == 0
    gram, target = normal_equations(sample.where(~kept_out), model)
    n = max(gram[0, 0], 1.0)
    model.coef = np.linalg.solve(gram + RIDGE * n * np.diag([1e-6] + [1.0] * (len(gram) - 1)), target)

    def bins(batches):
        for batch in batches:
            if batch.num_rows:
                cell = ((model.raw(matrix(batch)) - LOW) / (HIGH - LOW) * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], ["cell", "label"])

    counted = (
        sample.where(kept_out).select("stats", F.col("label").cast("double").alias("label")).mapInArrow(bins, "cell int, label double")
        .groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).orderBy("cell").toPandas()
    )
    if len(counted):
        centre = LOW + (counted["cell"].to_numpy() + 0.5) * (HIGH - LOW) / BINS
        model.steps = pooled(centre, counted["n"].to_numpy(float), counted["pos"].to_numpy(float))
    else:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with the mean of repeated labels; rows with a null id or label are left out."""
    named = labels.select("doc_id", F.col(column).cast("double").alias("label")).where("doc_id is not null and label is not null")
    return named.groupBy("doc_id").agg(F.avg("label").alias("label"))


def score(stats: DataFrame, model: KernelRidge) -> DataFrame:
    """(doc_id, _mark, score) per row of the stored statistics."""
    schema = pa.schema([("doc_id", pa.int64()), ("_mark", pa.int64()), ("score", pa.float64())])

    def apply(batches):
        for batch in batches:
            found = model.score(matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], schema=schema)

    return stats.select("doc_id", "_mark", "stats").mapInArrow(apply, "doc_id bigint, _mark bigint, score double")


def train(docs: DataFrame, labels: DataFrame, held_out, column: str = "quality", max_rows: int = TRAIN_ROWS) -> KernelRidge:
    """Learn from the texts of labelled rows that are not held out; only their texts are read by Python.

    The labels used, about ``max_rows``, are broadcast: at 16 bytes each their size is bounded by that parameter.
    """
    wanted = bounded_sample(one_label(labels, column).where(~held_out), "doc_id", max_rows, 3)
    known = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    return fit(document_statistics(known, F.lit(0)).join(F.broadcast(wanted), "doc_id"), max_rows)


def accept(docs: DataFrame, model: KernelRidge, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; all rows where nothing was learned."""
    if model.steps is None:
        return docs

    def keep(batches):
        for batch in sliced(batches):
            if batch.num_rows:
                stats = np.array([statistics(t) for t in texts_of(batch)], np.float32).astype(np.float64)
                yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, held_out, column: str = "quality", threshold: float = 0.7, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, learned from labelled rows that are not held out.

    Rows that repeat an id are scored on their own; null and empty texts have all statistics zero. Without labels of both
    kinds every score is 0.5.
    """
    stats = document_statistics(docs, held_out)
    train = stats.where("_mark = 0").join(one_label(labels, column), "doc_id")
    scored = score(stats, fit(train, max_rows))
    return scored.select(
        "doc_id",
        (F.col("_mark") == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
