"""Communities kept up over a stream of changed edges: the touched move at once, a full run follows once enough has changed.

Everything a batch decides lies under its number: how many edges it changed, whom it moved, which workspaces it ran in
full. A batch reads only what lies under lower numbers, and writes over what a lost try of itself left; so each counts
once, however often it is run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import communities, graph, queues
from quillgraph.plans.settle import settled, written

CHURN, MEMBERS, RUNS = "ws string, changed long", "ws string, name string, community int", "ws string, at timestamp"


def _read(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    try:
        df = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], f"{schema}, batch long")
    return df if before is None else df.where(F.col("batch") < before)


def _write(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def last_runs(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(ws, run, at): the batch and time of each workspace's last full run."""
    return _read(spark, f"{folder}/runs", RUNS, before).groupBy("ws").agg(F.max("batch").alias("run"), F.max_by("at", "batch").alias("at"))


def churn(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(ws, changed, last_full_run): edges changed since the workspace's last full run, which takes in its own batch's."""
    runs = last_runs(spark, folder, before)
    c = _read(spark, f"{folder}/churn", CHURN, before).join(runs, "ws", "full")
    later = F.col("run").isNull() | (F.col("batch") > F.col("run"))
    return c.groupBy("ws").agg(F.coalesce(F.sum(F.when(later, F.col("changed"))), F.lit(0)).alias("changed"), F.max("at").alias("last_full_run"))


def members(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(ws, name, community): of each entity the last word, none of it older than its workspace's last full run."""
    m = _read(spark, f"{folder}/members", MEMBERS, before).join(last_runs(spark, folder, before).select("ws", "run"), "ws", "left")
    m = m.where(F.col("run").isNull() | (F.col("batch") >= F.col("run")))
    return m.groupBy("ws", "name").agg(F.max_by("community", "batch").alias("community"))


def touched(changes: DataFrame) -> DataFrame:
    """(ws, name, place): the ends of the changed edges (ws, source, target, place), in the order in which they first come."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("name"), (F.col("place") * 2).alias("place")), F.struct(F.col("target").alias("name"), (F.col("place") * 2 + 1).alias("place"))))
    return changes.select("ws", ends.alias("e")).groupBy("ws", F.col("e.name").alias("name")).agg(F.min("e.place").alias("place"))


def moved(edges: DataFrame, touched: DataFrame, home: DataFrame) -> DataFrame:
    """(ws, name, community) of the touched that join the community of their heaviest clustered neighbour, one after another.

    Later ones see where earlier ones went. Of the neighbours that stand still only the best counts, so a task gets a row
    for each touched entity, its best and the touched among its neighbours, and never a workspace's graph.
    """
    t = touched.select("ws", "name", "place")
    both = edges.select("ws", F.col("source").alias("name"), F.col("target").alias("neighbour"), "weight").unionByName(edges.select("ws", F.col("target").alias("name"), F.col("source").alias("neighbour"), "weight"))
    near = both.where(F.col("name") != F.col("neighbour")).join(t.select("ws", "name"), ["ws", "name"], "left_semi").groupBy("ws", "name", "neighbour").agg(F.sum("weight").alias("weight"))
    other = home.select("ws", F.col("name").alias("neighbour"), F.col("community").alias("there"))
    also = t.select("ws", F.col("name").alias("neighbour"), F.lit(True).alias("touched"))
    near = near.join(other, ["ws", "neighbour"], "left").join(also, ["ws", "neighbour"], "left")
    still = near.where(F.col("touched").isNull() & F.col("there").isNotNull()).groupBy("ws", "name").agg(F.min(F.struct((-F.col("weight")).alias("less"), "neighbour", "there")).alias("b"))
    rows = near.where(F.col("touched").isNotNull()).select("ws", "name", "neighbour", "weight", F.col("there").cast("double").alias("there"))
    rows = rows.unionByName(still.select("ws", "name", F.col("b.neighbour").alias("neighbour"), (-F.col("b.less")).alias("weight"), F.col("b.there").cast("double").alias("there")))
    rows = rows.join(t, ["ws", "name"])

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        at = {n: int(c) for n, c in zip(p["neighbour"], p["there"], strict=True) if not pd.isna(c)}
        near: dict[str, list[tuple[str, float]]] = {}
        for name, neighbour, weight in zip(p["name"], p["neighbour"], p["weight"], strict=True):
            near.setdefault(name, []).append((neighbour, weight))
        order = p.sort_values(["place", "name"])["name"].drop_duplicates()
        to = communities.reassigned(list(order), near, at)
        joined = [n for n in order if n in to and to[n] != at.get(n)]
        # plain objects, as a frame without rows would have no string array to send
        return pd.DataFrame({"ws": pd.Series([key[0]] * len(joined), dtype=object), "name": pd.Series(joined, dtype=object), "community": pd.Series([to[n] for n in joined], dtype="int32")})

    return rows.groupBy("ws").applyInPandas(run, MEMBERS)


class Communities:
    """A sink for changed edges (ws, source, target, place), to be given to foreachBatch.

    graph gives the clusterable edges (ws, source, target, weight) as they are after a batch; share of them is what has to
    change for a full run; now is the time that marks one.
    """

    def __init__(self, folder: str, graph: Callable[[SparkSession, int], DataFrame], share: float = 0.05, now: Callable[[], str] | None = None):
        self.folder, self.graph, self.share, self.now = folder, graph, share, now

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, self.folder
        changes = written(batch.select("ws", "source", "target", "place"))
        edges = self.graph(spark, number)
        before = churn(spark, folder, number).select("ws", "changed")
        new = changes.groupBy("ws").agg(F.count(F.lit(1)).alias("changed"))
        _write(new, f"{folder}/churn", number)
        sums = before.unionByName(new).groupBy("ws").agg(F.sum("changed").alias("changed")).join(new.select("ws"), "ws", "left_semi")
        pairs = written(graph.pair_weights(edges.join(F.broadcast(new.select("ws")), "ws", "left_semi")))
        counts = pairs.groupBy("ws").agg(F.count(F.lit(1)).alias("edges"))
        # a workspace that is left without edges is due with any change, as its share of nothing is nothing
        due = settled(queues.churn_due(sums, sums.select("ws").join(counts, "ws", "left").fillna(0, ["edges"]), self.share).where("due").select("ws"))
        # the ws that run in full get nothing from the quick way: the full partition takes its place
        full = communities.partition(pairs.join(F.broadcast(due), "ws", "left_semi"))
        home = members(spark, folder, number)
        # and where nobody is in a community yet, there is none to join
        quick = settled(home.select("ws").distinct().join(due, "ws", "left_anti").join(new.select("ws"), "ws", "left_semi"))
        of = lambda df: df.join(F.broadcast(quick), "ws", "left_semi")
        hot = [] if quick.isEmpty() else [moved(of(edges), touched(of(changes)), of(home))]
        _write(reduce(DataFrame.unionByName, hot, full), f"{folder}/members", number)
        _write(due.select("ws", (F.current_timestamp() if self.now is None else F.lit(self.now()).cast("timestamp")).alias("at")), f"{folder}/runs", number)


def followed(changes: DataFrame, sink: Communities, checkpoint: str) -> None:
    """Takes in all that the stream has now."""
    changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
