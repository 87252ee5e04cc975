"""Periodic runs of words by a suffix automaton with link-cut access.

Words are appended one by one to a suffix automaton. Its suffix links form a tree; a link-cut tree keeps for every state where its strings
last ended: all states on one preferred path share that end. Appending a word accesses the new state, which walks the preferred
paths up to the root and recolours them with the new end. Each segment met on the way says that the suffixes up to some length
last ended at some earlier place. If the distance of the two ends is at most that length, the suffix lies twice side by side or
overlapping: a square whose period is the distance. The segment's length is the longest with that last end, so the square cannot be extended
to the left; it is extended to the right by comparing words, once for every run. Access is amortised logarithmic, so
a text of n words takes O(n log n) steps and no pair of occurrences is listed.

A run lies wholly in words that repeat with its period, so only stretches covered by groups of words which occur twice in the same
stretch go into an automaton; they are found by hashes, and a collision merely keeps a stretch too many. Documents are
independent rows, so there is no shuffle; a task holds one document's automaton at a time.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import slices, values_of

MIN_LENGTH = 12
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "array<struct<start: bigint, length: bigint, period: bigint>>"
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


class LastEnds:
    """Suffix automaton of a growing sequence with a link-cut tree over its suffix links.

    ``append`` returns (last end, length) for the segments of the new prefix's suffixes: the suffixes longer than the next
    segment's length and not longer than this one's ended last there. Ends count from 0.
    """

    def __init__(self):
        none = [-1]
        self.length, self.link = array("i", [0]), array("i", none)
        # a state's first transition; further ones are in ``more``
        self.word, self.next, self.more = array("i", none), array("i", none), {}
        # splay trees of preferred paths, by depth; ``up`` of a splay root is the parent of its path in the suffix tree
        self.left, self.right, self.up = array("i", none), array("i", none), array("i", none)
        self.end = array("i", none)  # of a whole path, at its splay root
        self.last, self.n = 0, 0

    def state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        for column in (self.word, self.next, self.left, self.right, self.up, self.end):
            column.append(-1)
        return len(self.length) - 1

    def step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.next[state]
        more = self.more.get(state)
        return more.get(word, -1) if more else -1

    def set_step(self, state: int, word: int, to: int) -> None:
        if self.word[state] == word or self.word[state] < 0:
            self.word[state], self.next[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree, which carries the end of the path."""
        left, right, up = self.left, self.right, self.up
        top = x
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                break
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if inner:
                # rotate the parent first if both go the same way, else the node
                first = p if (left[g] == p) == (left[p] == x) else x
                self.rotate(first)
                top = g
            else:
                top = p
            self.rotate(x)
        if top != x:
            self.end[x] = self.end[top]

    def rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            child = right[x]
            left[p], right[x] = child, p
        else:
            child = left[x]
            right[p], left[x] = child, p
        if child >= 0:
            up[child] = p
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x], up[p] = g, x

    def append(self, word: int) -> list[tuple[int, int]]:
        length, link, step = self.length, self.link, self.step
        p = self.last
        new = self.state(length[p] + 1, -1)
        while p >= 0 and step(p, word) < 0:
            self.set_step(p, word, new)
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = step(p, word)
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                link[new] = self.split(p, q, word)
        self.last = new
        self.up[new] = link[new]
        return self.access(new)

    def split(self, p: int, q: int, word: int) -> int:
        """A state for the shorter strings of ``q``; it lies over ``q`` on the same preferred path, as it ended where ``q`` did."""
        link, left, up = self.link, self.left, self.up
        clone = self.state(self.length[p] + 1, link[q])
        self.word[clone], self.next[clone] = self.word[q], self.next[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        while p >= 0 and self.step(p, word) == q:
            self.set_step(p, word, clone)
            p = link[p]
        link[q] = clone
        self.splay(q)
        above = left[q]
        left[clone], left[q], up[clone] = above, clone, q
        if above >= 0:
            up[above] = clone
        return clone

    def access(self, state: int) -> list[tuple[int, int]]:
        """Make the way from ``state`` to the root one path that ends here and now; the segments that it was made of."""
        right, up, end, length = self.right, self.up, self.end, self.length
        segments, below, x = [], state, up[state]
        while x >= 0:
            self.splay(x)
            segments.append((end[x], length[x]))
            cut = right[x]
            if cut >= 0:
                end[cut] = end[x]  # stays behind as a path of its own
            right[x], up[below] = below, x
            below, x = x, up[x]
        end[below] = self.n
        self.n += 1
        return segments


def equal_from(ids: np.ndarray, at: int, period: int) -> int:
    """First position from ``at`` on whose word differs from the one ``period`` before it."""
    n, step = len(ids), 64
    while at < n:
        stop = min(n, at + step)
        differ = np.flatnonzero(ids[at:stop] != ids[at - period : stop - period])
        if len(differ):
            return at + int(differ[0])
        at, step = stop, 2 * step
    return n


def runs_within(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``min_length`` words at least, by the automaton."""
    automaton, reached, found = LastEnds(), {}, []
    append = automaton.append
    for i, word in enumerate(ids.tolist()):
        for end, length in append(word):
            period = i - end
            if end >= 0 and length >= period and reached.get(period, -1) < i:
                start = i - length - period + 1
                stop = equal_from(ids, i + 1, period)
                reached[period] = stop - 1
                if stop - start >= min_length:
                    found.append((start, stop - start, period))
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeating_stretches(hashes: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """(start, stop) of the stretches outside of which no run lies.

    In a run of length n >= max(min_length, 2 q) with period q at least n - q >= min_length / 2 words in a row equal those q on, so
    every word of the run lies in a group of that many words which occurs twice within the run. Words in no such group are cut
    out, and groups are looked for again in each stretch alone until nothing more falls away.
    """
    k = (min_length + 1) // 2
    n = len(hashes)
    if n < min_length:
        return []
    group = mixed(hashes.copy())
    grams = group[: n - k + 1].copy()
    for j in range(1, k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + group[j : n - k + 1 + j]
    starts, stretch = np.arange(n - k + 1), np.zeros(n - k + 1, np.int64)
    left = n
    while True:
        key = mixed(grams[starts] + stretch.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        kept = np.sort(starts[twice])
        if not len(kept):
            return []
        # a stretch ends where the next group begins behind the last one
        new = np.flatnonzero(np.diff(kept) > k) + 1
        first, last = kept[np.concatenate([[0], new])], kept[np.concatenate([new - 1, [len(kept) - 1]])] + k
        wide = last - first >= min_length
        first, last = first[wide], last[wide]
        total = int((last - first).sum())
        if total == left or not total:
            return list(zip(first.tolist(), last.tolist()))
        left = total
        sizes = last - first - k + 1
        stretch = np.repeat(np.arange(len(first)), sizes)
        starts = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, by start, then period."""
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    found = []
    for start, stop in repeating_stretches(hashes, min_length):
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words[start:stop]], np.int32)
        found += [(start + at, length, period) for at, length, period in runs_within(ids, min_length)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first ``period`` words."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(change[:-1]).tolist()) if not inside]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs``.

    Words are runs of characters other than space, tab, line breaks, vertical tab and form feed, numbered from 0. A run is a stretch of words
    with smallest period q, ``min_length`` words and 2 q words long at least, which no neighbouring word extends; ``runs`` lists all by
    start, then period. ``collapsed`` joins by one space the words that no run contains after its first q.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are independent: repeated rows give repeated results, a null
    doc_id stays null, an empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
    """

    def find(batches):
        for batch in batches:
            keys = values_of(batch, "doc_id")
            texts = batch.column(batch.schema.get_field_index("text"))
            for a, b in slices(texts):
                out: dict[str, list] = {name: [] for name in FOUND.names}
                for key, text in zip(keys[a:b], texts.slice(a, b - a).cast(pa.binary()).to_pylist()):
                    words = (text or b"").split()
                    runs = runs_of(words, min_length)
                    out["doc_id"].append(key)
                    out["n_words"].append(len(words))
                    out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    out["collapsed"].append(b" ".join(collapse(words, runs) if runs else words).decode())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in FOUND], schema=FOUND)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(find, f"doc_id bigint, n_words bigint, runs {RUN_SQL}, collapsed string")
