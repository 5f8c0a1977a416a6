"""The append log as a stream: per-page numbering, compaction, and churn by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered(updates: DataFrame, order: list[str]) -> DataFrame:
    """updates with seq, from 1 on within each page."""
    return updates.withColumn("seq", F.row_number().over(W.partitionBy("page_id").orderBy(*order)))


def compacted(log: DataFrame, most: int = 100) -> DataFrame:
    """Pages with more than most updates keep their last one, as seq 0; the others stay as they are."""
    n = log.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("update", "seq").alias("last"))
    small = log.join(n.where(F.col("n") <= most).select("page_id"), "page_id", "left_semi").select("page_id", "seq", "update")
    return small.unionByName(n.where(F.col("n") > most).select("page_id", F.lit(0).alias("seq"), F.col("last").alias("update")))


def counts(log: DataFrame) -> DataFrame:
    return log.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def read(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def churn(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Adds up changes by workspace, batch by batch, as Parquet under out; a batch that is run again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("ws").agg(F.count(F.lit(1)).alias("changed")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def churn_total(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("ws").agg(F.sum("changed").alias("changed"))
