"""Toxicity scores of texts restored by a noisy channel.

A character trigram model is counted over all documents. A token that may be disguised (digits or signs between letters, letters
repeated three times and more, letters spaced out) becomes a lattice: each character may stand for letters, be noise, or be a
repetition. Viterbi search over the last two letters finds the most probable reading under the character model and the
costs of the channel; a token with one reading is its own restoration. The restored words are then scored.

The score is learned from a bounded sample of labelled rows: half of it gives a lexicon of words, word beginnings and word
endings that occur more in rows of label 1, the other half fits a logistic regression on what the lexicon finds in a text.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import batch_of, bounded_sample, runs, stored, texts_of, values_of

LETTERS = 28  # 0 no letter, 1-26 a-z, 27 another letter
TRAIN_ROWS = 24_000
LEXICON_SIZE = 20_000
LEAST_ODDS, LEAST_Z = 2.0, 4.5
CHUNK_CHARS = 1 << 20

# What a sign may stand for; "" is noise.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou",
}
NOISE = set("@$!|+(<*.,-_~^'\"`:;/\\#%&=)>[]{}?")
SUBSTITUTED, DROPPED, SHORTENED, KEPT = -1.2, -0.7, -0.3, -3.0
EDGE = ".,;:!?\"'()[]{}<>#%&*~`/\\|-_=^"
REPEATED = re.compile(r"(.)\1\1")
SPACED = re.compile(r"(?<!\S)(?:[^\W_](?: |[.\-_*] ?)){3,}[^\W_](?![^\s.,;:!?])")


def letter_codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(raw < 128, CODES[np.minimum(raw, 127)], np.where(raw < 0xC0, 0, 27)).astype(np.int64)


CODES = np.zeros(128, np.int64)
CODES[97:123] = np.arange(1, 27)


def code(letter: str) -> int:
    n = ord(letter)
    return int(CODES[n]) if n < 128 else (27 if letter.isalpha() else 0)


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c3 | c1, c2), shape (28, 28, 28), from the texts of all rows; sums per partition, added up in Spark."""

    def count(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in runs([len(t) for t in texts], CHUNK_CHARS):
                c = letter_codes("  " + "  ".join(texts[a:b]).lower() + "  ")
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])

    found = docs.select("text").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    three = np.zeros(LETTERS**3)
    three[found["cell"]] = found["n"]
    three = three.reshape(LETTERS, LETTERS, LETTERS)
    two = three.sum(0)
    after_one = (two + 1) / (two.sum(1, keepdims=True) + LETTERS)
    return np.log((three + 5 * after_one[None]) / (three.sum(2, keepdims=True) + 5))


class Restorer(dict):
    """Restored form of a token, kept once found."""

    def __init__(self, logp: np.ndarray):
        super().__init__()
        self.logp = logp.tolist()

    def __missing__(self, token: str) -> str:
        word = token.lower().rstrip(EDGE).lstrip(EDGE.replace("!", ""))
        if not word.isalpha() or REPEATED.search(word):
            word = self.decode(word) if any(c.isalpha() for c in word) else word
        self[token] = word
        return word

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """Readings of each character: (letters or nothing, cost)."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(word):
            c = word[i]
            j = i
            while j < len(word) and word[j] == c:
                j += 1
            if c.isalpha():
                if j - i >= 3:
                    out.append([(c, SHORTENED), (c + c, SHORTENED)])
                else:
                    out.extend([[(c, 0.0)]] * (j - i))
            else:
                options = [(r, SUBSTITUTED) for r in READINGS.get(c, "")]
                if c in NOISE:
                    options.append(("", DROPPED))
                if c.isdigit() or not options:
                    options.append((c, KEPT))
                out.extend([options] * (j - i))
            i = j
        return out

    def decode(self, word: str) -> str:
        """Most probable reading: Viterbi over the codes of the last two letters."""
        logp = self.logp
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.lattice(word):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for letters, price in options:
                    x, y, total, way = a, b, cost + price, path
                    for c in letters:
                        z = code(c)
                        total += logp[x][y][z]
                        x, y, way = y, z, (way, c)
                    old = new.get((x, y))
                    if old is None or total > old[0]:
                        new[x, y] = (total, way)
            states = new
        _, way = max(((cost + logp[a][b][0], path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])
        out = []
        while way is not None:
            way, c = way
            out.append(c)
        return "".join(reversed(out))

    def words(self, text: str) -> set[str]:
        """Distinct restored words, spaced-out ones included."""
        tokens = set(text.split())
        tokens.update("".join(c for c in m.group() if c.isalnum()) for m in SPACED.finditer(text))
        return set(map(self.__getitem__, tokens))

    def text(self, text: str) -> str:
        joined = SPACED.sub(lambda m: "".join(c for c in m.group() if c.isalnum()), text)
        return " ".join(map(self.__getitem__, joined.split()))


def restored(docs: DataFrame, logp: np.ndarray) -> DataFrame:
    """(doc_id, text) with restored words separated by spaces."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def restore(batches):
        own = Restorer(logp)
        for batch in batches:
            yield batch_of(schema, doc_id=values_of(batch, "doc_id"), text=[own.text(t) for t in texts_of(batch)])

    return docs.select("doc_id", "text").mapInArrow(restore, "doc_id bigint, text string")


def features(word: str) -> list[str]:
    """The word, and its beginnings and endings of four and five letters."""
    out = [f"^{word}$"]
    for n in (4, 5):
        if len(word) > n:
            out += [f"^{word[:n]}", f"{word[-n:]}$"]
    return out


def lexicon(train: DataFrame, logp: np.ndarray, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Log odds of the features that speak for label 1, at most ``size``, from (text, label)."""

    def count(batches):
        own, seen = Restorer(logp), {}
        for batch in batches:
            for text, label in zip(texts_of(batch), values_of(batch, "label")):
                for f in {f for w in own.words(text) for f in features(w)}:
                    cell = seen.get(f)
                    if cell is None:
                        cell = seen[f] = [0, 0]
                    cell[int(label >= 0.5)] += 1
                if len(seen) > 400_000:
                    yield counted(seen)
                    seen = {}
        yield counted(seen)

    def counted(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["f", "neg", "pos"]
        )

    n = train.agg(F.sum((F.col("label") >= 0.5).cast("int")), F.count("*")).first()
    pos, neg = n[0] or 0, n[1] - (n[0] or 0)
    if not pos or not neg:
        return {}
    summed = train.select("text", "label").mapInArrow(count, "f string, neg bigint, pos bigint").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    scored = summed.where(F.col("pos") >= max(4, math.ceil(0.005 * pos))).withColumn("odds", odds)
    rate, both = pos / (pos + neg), F.col("pos") + F.col("neg")
    scored = scored.withColumn("z", (F.col("pos") - both * rate) / F.sqrt(both * rate * (1 - rate)))
    kept = scored.where((F.col("odds") > LEAST_ODDS) & (F.col("z") > LEAST_Z)).orderBy(F.desc("z"), "f").limit(size)
    return {r["f"]: r["odds"] for r in kept.collect()}


class Scorer(dict):
    """Weight of a token: the largest of the lexicon entries of its restored form, or 0."""

    def __init__(self, logp: np.ndarray, weights: dict[str, float]):
        super().__init__()
        self.restorer, self.weights = Restorer(logp), weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        self[word] = found = max([get(f, 0.0) for f in features(word)])
        return found

    def __call__(self, text: str) -> list[float]:
        words = self.restorer.words(text)
        hits = [w for w in map(self.__getitem__, words) if w > 0]
        return [1.0, math.log1p(sum(hits)), max(hits, default=0.0), math.log1p(len(hits)), math.log1p(len(hits)) - 0.2 * math.log1p(len(words))]


def scores(docs: DataFrame, logp: np.ndarray, weights: dict[str, float], coef: np.ndarray | None) -> DataFrame:
    """(doc_id, _mark, score, found): ``found`` are the numbers under the score. Without coefficients the score is 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("_mark", pa.int64()), ("score", pa.float64()), ("found", pa.list_(pa.float64()))])

    def apply(batches):
        own = Scorer(logp, weights)
        for batch in batches:
            found = [own(t) for t in texts_of(batch)]
            score = [0.0 if coef is None else 1 / (1 + math.exp(-max(-50.0, min(50.0, float(np.dot(coef, f)))))) for f in found]
            yield batch_of(schema, doc_id=values_of(batch, "doc_id"), _mark=values_of(batch, "_mark"), score=score, found=found)

    return docs.select("doc_id", "text", "_mark").mapInArrow(apply, "doc_id bigint, _mark bigint, score double, found array<double>")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Newton steps for logistic regression with an L2 penalty."""
    coef = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -40, 40)))
        gradient = x.T @ (p - y) + penalty * coef
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(coef)), gradient)
        coef -= step
        if np.abs(step).max() < 1e-8:
            break
    return coef


def classify(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    ``labels`` has (doc_id, label); repeated labels of an id count as their mean, null ids and labels not at all. Labelled rows that are
    held out teach nothing. Null and empty texts get the score of a text without findings; without labels of both kinds every
    score is 0.
    """
    logp = character_model(docs)
    marked = docs.select("doc_id", "text", held_out.cast("bigint").alias("_mark"))
    wanted = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    wanted = bounded_sample(wanted.where(~(F.lit(False) if held_out is None else held_out)), "doc_id", max_rows, 13)
    train = stored(marked.where("_mark = 0").join(wanted, "doc_id").dropDuplicates(["text"]), "labelled")
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2)) == 0
    weights = lexicon(train.where(half), logp)
    second = train.where(~half)
    fitted = scores(second, logp, weights, None).join(second.select("doc_id", "label").distinct(), "doc_id").select("found", "label").toArrow()
    y = (np.asarray(fitted.column("label"), np.float64) >= 0.5).astype(float)
    coef = logistic(np.array(fitted.column("found").to_pylist()), y) if len(y) and 0 < y.mean() < 1 else None
    out = scores(marked, logp, weights, coef)
    return out.select("doc_id", (F.col("_mark") == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
