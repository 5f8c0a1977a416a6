"""Work queues as set differences, and progress over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.predicates import live


def pending_embedding(pages: DataFrame, embedded: DataFrame, limit: int | None = None) -> DataFrame:
    """hash of live chunks without an embedding, in order."""
    out = live(pages).select("hash").distinct().join(embedded.select("hash"), "hash", "left_anti").orderBy("hash")
    return out if limit is None else out.limit(limit)


def embedding_progress(pages: DataFrame, embedded: DataFrame) -> DataFrame:
    have = embedded.select("hash").distinct().withColumn("have", F.lit(True))
    return live(pages).select("hash").distinct().join(have, "hash", "left").agg(F.count_if(F.col("have")).alias("done"), F.count(F.lit(1)).alias("total"))


def pending_extraction(pages: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """(hash, ws) of live chunks that the workspace has no marker for: another tenant's marker doesn't count."""
    out = live(pages).select("hash", "ws").distinct().join(done.select("hash", "ws"), ["hash", "ws"], "left_anti").orderBy("hash", "ws")
    return out if limit is None else out.limit(limit)


def extraction_progress(pages: DataFrame, done: DataFrame) -> DataFrame:
    have = done.select("hash", "ws").distinct().withColumn("have", F.lit(True))
    return live(pages).select("hash", "ws").distinct().join(have, ["hash", "ws"], "left").agg(F.count_if(F.col("have")).alias("done"), F.count(F.lit(1)).alias("total"))


def shared_chunks(pages: DataFrame) -> DataFrame:
    """Live chunks that more than one workspace has."""
    return live(pages).groupBy("hash").agg(F.countDistinct("ws").alias("workspaces"), F.count(F.lit(1)).alias("pages")).where(F.col("workspaces") > 1)


def workspace_stats(pages: DataFrame, embedded: DataFrame, edges: DataFrame) -> DataFrame:
    """By workspace: live pages, distinct live chunks, those embedded, clusterable edges."""
    p = live(pages)
    chunks = p.select("ws", "hash").distinct()
    a = p.groupBy("ws").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("hash").alias("chunks"))
    b = chunks.join(embedded.select("hash").distinct(), "hash", "left_semi").groupBy("ws").agg(F.count(F.lit(1)).alias("embedded"))
    c = edges.join(chunks, ["ws", "hash"], "left_semi").groupBy("ws").agg(F.count(F.lit(1)).alias("edges"))
    return a.join(b, "ws", "left").join(c, "ws", "left").fillna(0)


def churn_due(changes: DataFrame, edge_counts: DataFrame, share: float = 0.05) -> DataFrame:
    """ws, changed, edges, threshold, due: a full run is due once changes reach their share of the edges, rounded up."""
    c = edge_counts.join(changes, "ws", "left").fillna(0, ["changed"])
    c = c.withColumn("threshold", F.ceil(F.col("edges") * share))
    return c.withColumn("due", (F.col("changed") > 0) & (F.col("changed") >= F.col("threshold")))
