"""Connected components: one task for few edges, alternating large and small stars for more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import settle


#: Edges that one task joins up, in some 20 MB; their number is counted first.
FEW = 300_000


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> (v, root): every vertex takes its neighbours' least root, and its root's root, until none changes."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(v))
    while True:
        old = root.copy()
        np.minimum.at(root, a, old[b])
        np.minimum.at(root, b, old[a])
        root = root[root]
        if np.array_equal(root, old):
            break
    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(v[root])], ["v", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(v, root) for each vertex of settled edges (a, b) of bigints: root is the least vertex it is connected with."""
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b")
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(joined_up, "v long, root long")
    return by_stars(edges)


def by_stars(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of edges (a, b): root is the least vertex it is connected with.

    Each round links the larger neighbours of every vertex, then the smaller ones, to the least of them; edges only
    lose in length, and rounds grow with the logarithm of a component's size. Minima are formed before the shuffle,
    so a vertex with very many edges is no large group.
    """
    e = settle(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stars = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        new = settle(small.where(F.col("u") != F.col("v")).distinct())
        seen = tuple(new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        e = new
        if seen == stars:
            break
        stars = seen
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select(F.col("v"), F.col("v").alias("root")).distinct())
