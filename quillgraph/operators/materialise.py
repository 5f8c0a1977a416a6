"""From the log to blocks, and from blocks to chunks, kept in tables that are written page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import block_hash
from quillgraph.operators.ingest import chunked_blocks
from quillgraph.operators.predicates import live
from quillgraph.plans.settle import settled
from quillgraph.sources.store import Added, Keyed


class Store:
    """blocks and page_chunks by page, chunks by their content's hash."""

    def __init__(self, spark: SparkSession, folder: str):
        self.blocks = Keyed(spark, f"{folder}/blocks", "page_id long, block_index int, kind string, text string, hash string", "page_id")
        self.page_chunks = Keyed(spark, f"{folder}/page_chunks", "page_id long, chunk_index int, hash string", "page_id")
        self.chunks = Added(spark, f"{folder}/chunks", "hash string, text string, token_estimate int", "hash")

    def chunk_texts(self) -> DataFrame:
        """(page_id, chunk_index, hash, text) of all pages."""
        return self.page_chunks.read().join(self.chunks.read().select("hash", "text"), "hash")


def projected(log: DataFrame) -> DataFrame:
    """(page_id, block_index, kind, text, hash): a paragraph for each line of what a page's last update says it is."""
    last = log.groupBy("page_id").agg(F.max_by("update", "seq").alias("text"))
    lines = last.select("page_id", F.posexplode(F.split("text", "\n")).alias("block_index", "text")).where(F.col("text") != "")
    return lines.select("page_id", "block_index", F.lit("paragraph").alias("kind"), "text", block_hash(F.lit("paragraph"), F.col("text")).alias("hash"))


def rechunk(store: Store, scope: DataFrame) -> DataFrame:
    """Chunks of the pages of scope anew, from their blocks: (page_id, chunks), 0 for a page that has no text left.

    Chunks are there before a page refers to them. A chunk that no page has any more stays, with its vector, should the
    text come back.
    """
    keys = scope.select("page_id").distinct()
    made = settled(chunked_blocks(store.blocks.read().join(keys, "page_id", "left_semi")))
    store.chunks.add(made)
    store.page_chunks.replace(keys, made)
    n = made.groupBy("page_id").agg(F.count(F.lit(1)).alias("chunks"))
    return keys.join(n, "page_id", "left").fillna(0, ["chunks"])


def reproject(store: Store, log: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks and chunks of the live pages from the log alone, whatever stands there: (page_id, blocks, chunks).

    A page that the log does not know has none of either. Pages that are not live are left as they are.
    """
    keys = settled(live(pages).select("page_id").distinct())
    blocks = settled(projected(log.join(keys, "page_id", "left_semi")))
    store.blocks.replace(keys, blocks)
    n = blocks.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"))
    return rechunk(store, keys).join(n, "page_id", "left").fillna(0, ["blocks"]).select("page_id", "blocks", "chunks")
