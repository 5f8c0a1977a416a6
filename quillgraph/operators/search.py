"""Quick find, related pages and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import quick_rank, words
from quillgraph.functions.vector import cosine_distance
from quillgraph.operators.predicates import clamp, live

RRF = 60
LEXICAL, VECTOR = 50, 100
CUTOFF = 0.45


def quick_find(pages: DataFrame, readable: DataFrame | None, q: str, limit: int = 10) -> DataFrame:
    """page_id, title, rank of live pages; nothing for a blank query."""
    p = live(pages) if q.strip() else pages.limit(0)
    p = p if readable is None else p.join(readable.select("page_id"), "page_id", "left_semi")
    p = p.select("page_id", "title", F.round(quick_rank(F.col("title"), q), 6).alias("rank")).where(F.col("rank").isNotNull())
    return p.orderBy(F.desc("rank"), "title", "page_id").limit(limit)


def related(pages: DataFrame, vectors: DataFrame, page_id: int, limit: int = 5, cutoff: float = CUTOFF) -> DataFrame:
    """page_id, title, distance of the live pages of its workspace nearest to a page, itself left out."""
    source = vectors.where(F.col("page_id") == page_id).select(F.col("embedding").alias("q"))
    home = pages.where(F.col("page_id") == page_id).select(F.col("ws").alias("home"))
    near = live(pages).where(F.col("page_id") != page_id).join(F.broadcast(home), F.col("ws") == F.col("home")).select("page_id", "title").join(vectors, "page_id")
    near = near.join(F.broadcast(source)).select("page_id", "title", F.round(cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))
    return near.where(F.col("distance") < cutoff).orderBy("distance", "page_id").limit(limit)


def lexical_arm(blocks: DataFrame, terms: Sequence[str], most: int = LEXICAL) -> DataFrame:
    """page_id, block_index, rank: blocks that have all terms, by how often they have them."""
    tokens = F.transform(words(F.col("text")), lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    b = blocks.select("page_id", "block_index", tokens.alias("tokens"))
    times = sum((F.size(F.filter("tokens", _is(t))) for t in terms), F.lit(0))
    b = b.where(F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains(F.col("tokens"), t)))
    b = b.select("page_id", "block_index", times.alias("times")).orderBy(F.desc("times"), "page_id", "block_index").limit(most)
    return b.withColumn("rank", F.row_number().over(W.orderBy(F.desc("times"), "page_id", "block_index")))


def _is(term: str):
    return lambda w: w == term


def vector_arm(vectors: DataFrame, q: Sequence[float], cutoff: float, most: int = VECTOR) -> DataFrame:
    v = vectors.select("page_id", F.round(cosine_distance(F.col("embedding"), F.lit(list(map(float, q)))), 6).alias("distance"))
    v = v.where(F.col("distance") < cutoff).orderBy("distance", "page_id").limit(most)
    return v.withColumn("rank", F.row_number().over(W.orderBy("distance", "page_id")))


def fused(lexical: DataFrame, vector: DataFrame, limit: int = 20) -> DataFrame:
    """page_id, score, lexical: reciprocal ranks added up; a page has a rank for each of its blocks that match."""
    arms = lexical.select("page_id", "rank", F.lit(True).alias("lexical")).unionByName(vector.select("page_id", "rank", F.lit(False).alias("lexical")))
    out = arms.groupBy("page_id").agg(F.round(F.sum(1 / (F.lit(float(RRF)) + F.col("rank"))), 6).alias("score"), F.bool_or("lexical").alias("lexical"))
    return out.orderBy(F.desc("score"), F.desc("lexical"), "page_id").limit(limit)


def hybrid(pages: DataFrame, blocks: DataFrame, vectors: DataFrame, terms: Sequence[str], q: Sequence[float], readable: DataFrame | None = None, cutoff: float = CUTOFF, limit: int = 20) -> DataFrame:
    """Both arms over live, readable pages, filtered before they are cut to their best."""
    ids = live(pages).select("page_id")
    ids = ids if readable is None else ids.join(readable.select("page_id"), "page_id", "left_semi")
    inside = lambda df: df.join(ids, "page_id", "left_semi")
    return fused(lexical_arm(inside(blocks), terms), vector_arm(inside(vectors), q, cutoff), limit)


def recent(pages: DataFrame, ws: str, limit: int = 10) -> DataFrame:
    return live(pages).where(F.col("ws") == ws).select("page_id", "title", "updated_at").orderBy(F.desc("updated_at"), F.desc("page_id")).limit(clamp(limit, 50))


def children(pages: DataFrame, parent: int | None) -> DataFrame:
    return live(pages).where(F.col("parent_id").eqNullSafe(F.lit(parent))).select("page_id", "parent_id", "title").orderBy("page_id")


def page(pages: DataFrame, page_id: int) -> DataFrame:
    """The page, if it is live; no row else."""
    return live(pages).where(F.col("page_id") == page_id)


def page_ids(pages: DataFrame) -> DataFrame:
    """Live pages from the oldest on."""
    return live(pages).select("updated_at", "page_id").orderBy("updated_at", "page_id")


def workspaces_by_age(pages: DataFrame) -> DataFrame:
    """Workspaces with the time of their oldest page, which they are ordered by."""
    return pages.groupBy("ws").agg(F.min("updated_at").alias("oldest")).orderBy("oldest", "ws")
