"""Benchmark decontamination by spaced seeds.

Fixed masks choose some token positions of a window and ignore the rest; the hash of the chosen tokens is the seed. Seeds of the
benchmark, a stated small set, meet those of every position of every document. Around each hit both texts are compared
token by token on the same diagonal: a window of ``window`` tokens (or the whole item, if shorter) that holds the hit and
agrees in at least ``share`` of its tokens is an overlap. The masks for a window length are MASKS and what else it takes until every
pattern of allowed substitutions leaves all chosen positions of some mask equal (``masks_for``, by enumeration), so substituted words
neither hide a window from all masks nor break it. Items of fewer than eight words must be found whole: of so few words
three quarters agree by chance in clean texts.

The benchmark goes to the tasks in blocks of ``block_words`` words, one scan per block, so what a task holds is bounded
whatever the benchmark's size. Documents are not shuffled.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import mix, runs, sliced, texts_of, values_of

#: 1 = the token counts. Five tokens each; the first is contiguous.
MASKS = ("11111", "1101011", "11001011", "110100101", "1010010011")
WINDOW, SHARE = 13, 0.75
BLOCK_WORDS = 400_000
CHUNK_CHARS = 1 << 20
HITS_AT_ONCE = 100_000
WORD = re.compile(r"\w+")
OVERLAPS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_words", pa.int32()), ("window_words", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])
OVERLAPS_SQL = "doc_id bigint, item_id bigint, matched_words int, window_words int, first_word bigint, last_word bigint"
GAP, OTHER = -1, -2  # between items; between documents


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def needed(words: int, window: int, share: float) -> int:
    """Equal tokens that an item of this many words must show: all of them below eight words."""
    return words if words < 8 else math.ceil(share * min(window, words))


LARGEST_WINDOW = 16  # patterns are enumerated


def places_of(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def patterns_met(mask: tuple[int, ...], patterns: list[tuple[int, ...]], width: int) -> set[tuple[int, ...]]:
    """The patterns (positions of substituted words) that leave the mask's positions alone at some shift."""
    shifted = [{p + s for p in mask} for s in range(width - mask[-1])]
    return {e for e in patterns if any(not m.intersection(e) for m in shifted)}


@lru_cache
def masks_for(words: int, window: int, share: float) -> tuple[tuple[int, ...], ...]:
    """Masks that together meet every window that is allowed for items of ``words`` words; those of MASKS that fit come first."""
    width, allowed = min(words, window), min(words, window) - needed(words, window, share)
    if width > LARGEST_WINDOW:
        raise ValueError(f"windows have {LARGEST_WINDOW} words at most")
    weight = min(5, width - allowed)
    chosen = [places_of(m) for m in MASKS if len(m) <= width] if width >= 5 else [tuple(range(width))]
    patterns = list(combinations(range(width), allowed))
    left = set(patterns).difference(*[patterns_met(m, patterns, width) for m in chosen])
    candidates = [(0, *rest) for rest in combinations(range(1, width), weight - 1)]
    while left:
        best = max(candidates, key=lambda m: (len(patterns_met(m, list(left), width)), -m[-1]))
        left -= patterns_met(best, list(left), width)
        chosen.append(best)
    return tuple(chosen)


class SeedIndex:
    """Seeds of benchmark items, sorted by hash, with their place in one long token array."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, share: float = SHARE):
        self.window, self.vocabulary = window, {}
        tokens, item_at, begins = [], [], []
        self.item_ids, self.needed, self.full = [], [], []
        pad = window + max(map(len, MASKS))
        tokens += [GAP] * pad
        for item_id, text in items:
            words = words_of(text or "")
            if not words:
                continue
            begins.append((len(tokens), len(words)))
            item_at.append(len(self.item_ids))
            self.item_ids.append(item_id)
            self.needed.append(needed(len(words), window, share))
            self.full.append(min(window, len(words)))
            tokens += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [GAP] * pad
        self.tokens = np.array(tokens, np.int32)
        self.item_of = np.full(len(tokens), -1, np.int32)
        for i, (start, n) in enumerate(begins):
            self.item_of[start : start + n] = i
        self.needed, self.full = np.array(self.needed, np.int32), np.array(self.full, np.int32)
        lengths: dict[tuple[int, ...], set[int]] = {}
        for n in sorted({min(n, window) for _, n in begins}):
            for mask in masks_for(n, window, share):
                lengths.setdefault(mask, set()).add(n)
        length_at = np.zeros(len(tokens), np.int32)
        for start, n in begins:
            length_at[start : start + n] = min(n, window)
        self.masks, self.seeds = [np.array(m) for m in lengths], []
        for k, (mask, of) in enumerate(zip(self.masks, lengths.values())):
            at = np.flatnonzero(np.isin(length_at[: len(tokens) - mask[-1]], list(of)))
            at = at[(self.tokens[at[:, None] + mask] > 0).all(1)] if len(at) else at
            hashed = self.hash(self.tokens, at, mask, k)
            order = np.argsort(hashed, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(hashed >> np.uint64(44)).astype(np.int64)] = True
            self.seeds.append((hashed[order], at[order], bitmap))

    @staticmethod
    def hash(tokens: np.ndarray, at: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
        h = np.full(len(at), k + 1, np.uint64)
        for offset in mask:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + tokens[at + offset].astype(np.uint64))
        return h

    def hits(self, tokens: np.ndarray):
        """(place in ``tokens``, place in the benchmark, width) of seed hits, mask by mask, HITS_AT_ONCE at most."""
        known = tokens > 0
        for k, (mask, (hashes, places, bitmap)) in enumerate(zip(self.masks, self.seeds)):
            if not len(hashes):
                continue
            last = len(tokens) - mask[-1]
            usable = known[:last].copy()
            for offset in mask[1:]:
                usable &= known[offset : last + offset]
            at = np.flatnonzero(usable)
            h = self.hash(tokens, at, mask, k)
            seen = bitmap[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[seen], h[seen]
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = right - left
            for a, b in runs(n.tolist(), HITS_AT_ONCE):
                count = n[a:b]
                doc_at = np.repeat(at[a:b], count)
                entry = np.repeat(left[a:b] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                for s in range(0, len(entry), HITS_AT_ONCE):
                    yield doc_at[s : s + HITS_AT_ONCE], places[entry[s : s + HITS_AT_ONCE]], int(mask[-1]) + 1

    def overlaps(self, tokens: np.ndarray):
        """(first token, last token, item number, equal tokens) of verified windows in a padded token array."""
        w = self.window
        for at, place, width in self.hits(tokens):
            span = np.arange(-(w - 1), width + w - 1)
            left, right = tokens[at[:, None] + span], self.tokens[place[:, None] + span]
            item = self.item_of[place]
            own = (self.item_of[place[:, None] + span] == item[:, None]) & (left != OTHER)
            equal = np.cumsum(np.pad(own & (left == right), ((0, 0), (1, 0))), 1, dtype=np.int32)
            inside = np.cumsum(np.pad(own, ((0, 0), (1, 0))), 1, dtype=np.int32)
            equal, inside = equal[:, w:] - equal[:, :-w], inside[:, w:] - inside[:, :-w]
            equal = np.where(inside >= self.full[item][:, None], equal, -1)
            enough = equal >= self.needed[item][:, None]
            for i in np.flatnonzero(enough.any(1)):
                windows = np.flatnonzero(enough[i])
                yield at[i] + span[windows[0]], at[i] + span[windows[-1]] + w - 1, int(item[i]), int(equal[i].max())


def token_blocks(texts: list[str], vocabulary: dict[str, int], pad: int):
    """(first text, token array, starts, ends): texts of about CHUNK_CHARS together, padded between."""
    for a, b in runs([len(t) for t in texts], CHUNK_CHARS):
        parts, starts, ends, at = [np.full(pad, OTHER, np.int32)], [], [], pad
        for text in texts[a:b]:
            ids = np.array([vocabulary.get(w, 0) for w in words_of(text)], np.int32)
            parts += [ids, np.full(pad, OTHER, np.int32)]
            starts.append(at)
            ends.append(at + len(ids))
            at += len(ids) + pad
        yield a, np.concatenate(parts), np.array(starts), np.array(ends)


def found_in(texts: list[str], index: SeedIndex):
    """(text number, item id, equal tokens, window tokens, first word, last word), the best window of each pair with the extent of all."""
    pad = index.window + max(len(m) for m in MASKS)
    for a, tokens, starts, ends in token_blocks(texts, index.vocabulary, pad):
        best: dict[tuple[int, int], list[int]] = {}
        for first, last, item, equal in index.overlaps(tokens):
            doc = int(np.searchsorted(starts, last, "right")) - 1
            low, high = max(0, int(first - starts[doc])), int(min(last, ends[doc] - 1) - starts[doc])
            old = best.get((doc, item))
            best[doc, item] = [max(equal, old[0]), min(low, old[1]), max(high, old[2])] if old else [equal, low, high]
        for (doc, item), (equal, low, high) in sorted(best.items()):
            yield a + doc, index.item_ids[item], equal, int(index.full[item]), low, high


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Lists of (item_id, text) with about ``block_words`` words; items with a null id or text are left out."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row per document and benchmark item that overlap: (doc_id, item_id, matched_words, window_words, first_word, last_word).

    Words are runs of letters, digits and underscores in lower case. ``first_word`` and ``last_word`` bound all overlapping windows.
    Null and empty texts overlap with nothing; rows that repeat an id are searched on their own.
    """
    out = None
    for items in benchmark_blocks(benchmark):
        index = SeedIndex(items, window, share)

        def search(batches, index=index):
            for batch in sliced(batches):
                keys, found = values_of(batch, "doc_id"), list(found_in(texts_of(batch), index))
                columns = list(zip(*found)) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip([[keys[i] for i in columns[0]], *columns[1:]], OVERLAPS)], schema=OVERLAPS
                )

        part = docs.select("doc_id", "text").mapInArrow(search, OVERLAPS_SQL)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps with no benchmark item."""
    for items in benchmark_blocks(benchmark):
        index = SeedIndex(items, window, share)

        def keep(batches, index=index):
            for batch in sliced(batches):
                hit = np.zeros(batch.num_rows, bool)
                hit[[i for i, *_ in found_in(texts_of(batch), index)]] = True
                yield batch.filter(pa.array(~hit))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
