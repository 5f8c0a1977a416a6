"""Entities, edges, the clusterable graph and the bounded walk over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import ALNUM_EDGES, is_plausible_entity, normalised_entity, words
from quillgraph.operators.predicates import live
from quillgraph.plans.settle import written

MAX_HOPS = 2
RRF, DECAY = 60, 0.5


def extracted(pages: DataFrame) -> DataFrame:
    """ws, hash, names: the capitalised words of each page's chunk in order, without punctuation at their ends. Pages of the same
    text have equal rows.
    """
    capital = F.filter(words(F.col("text")), lambda w: w.rlike(r"^\p{Lu}"))
    names = F.filter(F.transform(capital, lambda w: F.regexp_replace(w, ALNUM_EDGES, "")), lambda w: w != "")
    return pages.select("ws", "hash", names.alias("names"))


def entities(pages: DataFrame) -> DataFrame:
    return extracted(pages).select("ws", F.explode("names").alias("name")).where(is_plausible_entity(F.col("name"))).select("ws", normalised_entity(F.col("name")).alias("name")).distinct()


def edges(pages: DataFrame) -> DataFrame:
    """ws, source, target, hash, weight: neighbours in the chunk's list of names, once for each chunk.

    Each name is judged and normalised once, and not as the end of one edge and the beginning of the next. Chunks on many
    pages have the same names, so chunks meet as one row each, and only what is left of them is spread to edges.
    """
    keys = F.transform("names", lambda n: F.when(is_plausible_entity(n), normalised_entity(n)))
    keyed = extracted(pages).where(F.size("names") >= 2).select("ws", "hash", keys.alias("keys")).dropDuplicates(["ws", "hash"])
    pairs = F.arrays_zip(F.col("keys").alias("s"), F.slice("keys", F.lit(2), F.size("keys")).alias("t"))
    pairs = keyed.select("ws", "hash", F.explode(F.array_distinct(pairs)).alias("e")).where(F.col("e.s").isNotNull() & F.col("e.t").isNotNull())
    return pairs.select("ws", F.col("e.s").alias("source"), F.col("e.t").alias("target"), "hash").withColumn("weight", F.lit(1.0))


def clusterable(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges whose chunk is on a live page of their own workspace."""
    return edges.join(live(pages).select("ws", "hash").distinct(), ["ws", "hash"], "left_semi")


def clusterable_of(pages: DataFrame) -> DataFrame:
    """clusterable() of all edges of pages: a chunk is on a live page if a live page has it, so these are the live pages' edges."""
    return edges(live(pages).where(F.col("ws").isNotNull())).select("ws", "hash", "source", "target", "weight")


def pair_weights(edges: DataFrame) -> DataFrame:
    return edges.groupBy("ws", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight"))


def nodes(edges: DataFrame) -> DataFrame:
    """ws, name, idx: names in order, counted from 0 within the workspace."""
    n = edges.select("ws", F.explode(F.array("source", "target")).alias("name")).distinct()
    return n.select("ws", "name", (F.row_number().over(W.partitionBy("ws").orderBy("name")) - 1).alias("idx"))


def neighbour_weights(edges: DataFrame) -> DataFrame:
    """Each undirected pair from both ends, without loops."""
    both = edges.select("ws", "source", "target", "weight").unionByName(edges.select("ws", F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    return both.where(F.col("source") != F.col("target")).groupBy("ws", F.col("source").alias("name"), F.col("target").alias("neighbour")).agg(F.sum("weight").alias("weight"))


def strongest_neighbour(weights: DataFrame) -> DataFrame:
    """The heaviest neighbour of each entity; the first by name of equal ones."""
    w = W.partitionBy("ws", "name").orderBy(F.desc("weight"), "neighbour")
    return weights.withColumn("k", F.row_number().over(w)).where(F.col("k") == 1).drop("k")


def seed_entities(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Entities at either end of the seed chunks' edges."""
    return edges.join(seeds.select("ws", "hash").distinct(), ["ws", "hash"], "left_semi").select("ws", F.explode(F.array("source", "target")).alias("name")).distinct()


def seeds_from_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """ws, hash, rank: every chunk of a page has the page's rank among the hits (page_id, score, lexical) of a search."""
    ranked = hits.select("page_id", F.row_number().over(W.orderBy(F.desc("score"), F.desc("lexical"), "page_id")).alias("rank"))
    return pages.join(ranked, "page_id").select("ws", "hash", "rank")


def sent_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, marked for broadcast if it has no more rows than that. df is written, and narrow."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def walk(edges: DataFrame, seeds: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """ws, hash, hops, score: the best evidence of each chunk within so many hops of the seeds (ws, hash, rank).

    Edges go both ways by a union, not by an OR in the join. After each hop an entity keeps its widest bottleneck for
    each seed rank, which no longer path can better, so there are no more rows than entities times ranks.
    """
    e = written(edges.select("ws", "source", "target", "hash", "weight"))
    both = e.unionByName(e.select("ws", F.col("target").alias("source"), F.col("source").alias("target"), "hash", "weight"))
    seeds = seeds.groupBy("ws", "hash").agg(F.min("rank").alias("rank"))
    ends = e.join(seeds, ["ws", "hash"]).select("ws", F.explode(F.array("source", "target")).alias("name"), "rank")
    at = ends.groupBy("ws", "name").agg(F.min("rank").alias("rank")).withColumn("width", F.lit(1.0))
    found = seeds.select("ws", "hash", F.lit(0).alias("hops"), (1 / (F.lit(float(RRF)) + F.col("rank"))).alias("score"))
    for hop in range(1, hops + 1):
        # what the seeds reach first is small, and goes to the edges
        step = both.join(sent_if_small(written(at)).withColumnRenamed("name", "source"), ["ws", "source"]).withColumn("width", F.least("width", "weight"))
        score = 1 / (F.lit(float(RRF)) + F.col("rank")) * DECAY**hop * F.col("width")
        # a chunk's best of a hop, before rows for each edge and rank could be shuffled and sorted
        found = found.unionByName(step.groupBy("ws", "hash").agg(F.max(score).alias("score")).select("ws", "hash", F.lit(hop).alias("hops"), "score"))
        at = step.groupBy("ws", F.col("target").alias("name"), "rank").agg(F.max("width").alias("width"))
    best = W.partitionBy("ws", "hash").orderBy(F.desc("score"), "hops")
    return found.withColumn("k", F.row_number().over(best)).where(F.col("k") == 1).drop("k")


def local_hits(found: DataFrame, pages: DataFrame, readable: DataFrame, limit: int) -> DataFrame:
    """page_id, hash, hops, score on live, readable pages of the workspace, best first."""
    on = live(pages).select("ws", "hash", "page_id").distinct().join(readable.select("page_id"), "page_id", "left_semi")
    return found.join(on, ["ws", "hash"]).select("page_id", "hash", "hops", "score").orderBy(F.desc("score"), "hops", "page_id", "hash").limit(limit)


def with_reserved_slots(hits: DataFrame, k: int) -> DataFrame:
    """The best k, of which a third (one at least) is kept for hits by hops if there are more than k."""
    order = [F.desc("score"), F.col("hops"), F.col("page_id"), F.col("hash")]
    of_kind = W.partitionBy(F.col("hops") > 0).orderBy(*order)
    h = hits.withColumns({"n": F.count(F.lit(1)).over(W.partitionBy()), "by_hops": F.sum((F.col("hops") > 0).cast("int")).over(W.partitionBy()), "r": F.row_number().over(of_kind)})
    slots = F.least("by_hops", F.lit(max(1, k // 3)))
    h = h.withColumn("first", F.when(F.col("n") <= k, True).when(F.col("hops") > 0, F.col("r") <= slots).otherwise(F.col("r") <= k - slots))
    return h.where("first").select(*hits.columns).orderBy(*order).limit(k)


def dead_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    return edges.join(live(pages).select("ws", "hash").distinct(), ["ws", "hash"], "left_anti")


def orphan_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select("ws", F.explode(F.array("source", "target")).alias("name")).distinct()
    return entities.join(used, ["ws", "name"], "left_anti")


def reap_counts(edges: DataFrame, entities: DataFrame, pages: DataFrame) -> DataFrame:
    """(edges, entities): how many edges no live page of their workspace holds up, and how many entities no other edge has."""
    dead = dead_edges(edges, pages).agg(F.count(F.lit(1)).alias("edges"))
    orphans = orphan_entities(entities, clusterable(edges, pages)).agg(F.count(F.lit(1)).alias("entities"))
    return dead.join(orphans)  # a row each
