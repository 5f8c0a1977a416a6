"""The driver's tables in the shapes of the note store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import block_hash, opening


#: A table of one file of no more bytes is dealt out by its first column.
SMALL = 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table; a small one of a single file, which one task would read and work on alone, on as many tasks as there are cores."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if 1 << 20 < df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL and len(df.inputFiles()) == 1:
        df = df.repartition(spark.sparkContext.defaultParallelism, df.columns[0])
    return df


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page for each document: ws is its source, its parent the page of a tenth of its id, archived if it is labelled toxic."""
    d, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return d.join(labels.select("doc_id", "toxic"), "doc_id", "left").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("ws"), F.when(F.col("doc_id") >= 10, F.expr("doc_id div 10")).alias("parent_id"),
        opening(F.col("text"), 5).alias("title"), "text", F.sha2("text", 256).alias("hash"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("archived"), F.col("n_chars").alias("updated_at"),
    )


def acls(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    access = F.when(F.col("toxic") == 1, "none").when(F.col("quality") == 1, "read")
    return labels.select(F.col("doc_id").alias("page_id"), access.alias("access")).where(F.col("access").isNotNull())


def blocks(pages: DataFrame) -> DataFrame:
    """A paragraph for each line."""
    lines = pages.select("page_id", "ws", "archived", F.posexplode(F.split("text", "\n")).alias("block_index", "text"))
    return lines.select("*", F.lit("paragraph").alias("kind"), block_hash(F.lit("paragraph"), F.col("text")).alias("hash"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding", "label")
