"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txquality.llm.common import discard, stored


def star_edges(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smallest id, id) of the components of a boolean matrix: fewer than rows, however many pairs are linked."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    both = linked | linked.T
    np.fill_diagonal(both, True)
    while True:
        new = np.where(both, label[None, :], len(ids)).min(1)
        if (new == label).all():
            break
        label = new
    root = ids[order][label]
    return [(int(r), int(i)) for r, i in zip(root, ids) if r != i]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b): the smallest id that it is connected with.

    Each round is two aggregates with joins on the edges; all are tables in the shared folder, so that both sides of a join
    are shuffled for it and a vertex with very many edges can be split. The number of rounds grows with the logarithm of
    the longest path.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, edges = edges, stored(small.where("a <> b").distinct(), "edges")
        discard(before, least, large, low)
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
