"""Communities: Louvain by workspace, modularity, identity of a partition, summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import member_set_hash
from quillgraph.functions.vector import cosine_distance

GAIN = 1e-12
STALE_FROM = 20


def louvain(n: int, edges: Sequence[tuple[int, int, float]]) -> list[int]:
    """The community of each of n nodes, numbered by first appearance.

    Nodes are visited in order and move to the neighbouring community of the largest gain, the lowest of equal ones,
    if it beats staying by GAIN; levels are folded until nothing joins.
    """
    rows = np.array(edges, np.float64).reshape(-1, 3)
    return louvain_of(n, rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2]).tolist()


def louvain_of(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """louvain() of edges as three arrays; links are held as such, 16 bytes for each end of an edge."""
    loop = a == b
    loops = np.bincount(a[loop], w[loop], n)
    a, b, w = a[~loop], b[~loop], w[~loop]
    starts, ends, weights = adjacent(n, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]))
    member, size = np.arange(n), n
    while True:
        source = np.repeat(np.arange(size), np.diff(starts))
        degree = (np.bincount(source, weights, size) + 2 * loops).tolist()
        whole = sum(degree)
        if whole <= 0:
            return member
        home, total, at = list(range(size)), degree[:], starts.tolist()
        moved = True
        while moved:
            moved = False
            for i in range(size):
                to: dict[int, float] = {}
                for j, x in zip(ends[at[i] : at[i + 1]].tolist(), weights[at[i] : at[i + 1]].tolist(), strict=True):
                    c = home[j]
                    to[c] = to.get(c, 0.0) + x
                own = home[i]
                total[own] -= degree[i]
                best, gain = own, to.get(own, 0.0) - total[own] * degree[i] / whole
                for c in sorted(to):
                    g = to[c] - total[c] * degree[i] / whole
                    if c != own and g > gain + GAIN:
                        best, gain = c, g
                total[best] += degree[i]
                if best != own:
                    home[i], moved = best, True
        _, first, of = np.unique(np.array(home), return_index=True, return_inverse=True)
        named = np.argsort(np.argsort(first))[of]  # by first appearance
        member, found = named[member], len(first)
        if found in (size, 1):
            return member
        x, y = named[source], named[ends]
        inner = (x == y) & (source < ends)
        loops = np.bincount(named, loops, found) + np.bincount(x[inner], weights[inner], found)
        starts, ends, weights = adjacent(found, x[x != y], y[x != y], weights[x != y])
        size = found


def adjacent(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each node's links start, their ends and weights; links with the same ends are one."""
    key, of = np.unique(a * max(1, n) + b, return_inverse=True)
    return np.searchsorted(key, np.arange(n + 1) * max(1, n)), key % max(1, n), np.bincount(of, w, len(key))


def partition(pairs: DataFrame) -> DataFrame:
    """ws, name, community from (ws, a, b, weight): one task a workspace, whose graph has to fit a worker as Arrow columns and
    arrays of numbers."""

    def run(p: pa.Table) -> pa.Table:
        n = p.num_rows
        ends = pa.chunked_array([*p["a"].chunks, *p["b"].chunks], pa.string()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        at = at[ends.indices.to_numpy()]
        got = louvain_of(len(order), at[:n], at[n:], p["weight"].to_numpy())
        ws = pa.repeat(p["ws"][0], len(order)) if n else pa.array([], pa.string())
        return pa.table({"ws": ws, "name": ends.dictionary.take(pa.array(order)), "community": pa.array(got, pa.int32())})

    return pairs.select("ws", "a", "b", "weight").groupBy("ws").applyInArrow(run, "ws string, name string, community int")


def modularity(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """ws, q of a partition (ws, name, community)."""
    at = lambda side: members.select("ws", F.col("name").alias(side), F.col("community").alias(f"c_{side}"))
    p = pairs.join(at("a"), ["ws", "a"]).join(at("b"), ["ws", "b"])
    m = p.groupBy("ws").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    degree = p.select("ws", F.explode(F.array(F.struct(F.col("c_a").alias("c"), "weight"), F.struct(F.col("c_b").alias("c"), "weight"))).alias("e")).groupBy("ws", "e.c").agg(F.sum("e.weight").alias("d"))
    squares = degree.groupBy("ws").agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return m.join(squares, "ws").select("ws", F.round(F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m")), 6).alias("q"))


def member_hashes(members: DataFrame) -> DataFrame:
    """ws, community, n_members, member_hash: a community's identity is the set of its members."""
    return members.groupBy("ws", "community").agg(F.countDistinct("name").alias("n_members"), member_set_hash(F.collect_set("name")).alias("member_hash"))


def swapped(old: DataFrame, new: DataFrame) -> DataFrame:
    """(ws, member_hash, ...) of old that survive a new partition, then what is new without the old columns."""
    kept = old.join(new.select("ws", "member_hash"), ["ws", "member_hash"], "left_semi")
    return kept.unionByName(new.join(old.select("ws", "member_hash"), ["ws", "member_hash"], "left_anti"), allowMissingColumns=True)


def reassigned(touched: Sequence[str], neighbours: dict[str, Sequence[tuple[str, float]]], home: dict[str, int]) -> dict[str, int]:
    """Each touched entity in turn joins the community of its heaviest clustered neighbour; the order matters."""
    home = dict(home)
    for name in touched:
        clustered = sorted((-w, other) for other, w in neighbours.get(name, ()) if other != name and other in home)
        if clustered:
            home[name] = home[clustered[0][1]]
    return home


def urgency(has_summary, model_changed, members):
    return F.when(has_summary & ~model_changed & (members >= STALE_FROM), "lazy").otherwise("eager")


def pending_summaries(communities: DataFrame, summaries: DataFrame, model: str) -> DataFrame:
    """(ws, community, member_hash, n_members) without a summary, or with one of other members or of another model."""
    s = summaries.select("ws", "community", F.col("member_hash").alias("of"), "model")
    j = communities.join(s, ["ws", "community"], "left")
    stale = ~F.col("of").eqNullSafe(F.col("member_hash")) | ~F.col("model").eqNullSafe(F.lit(model))
    changed = F.col("model").isNotNull() & (F.col("model") != model)
    return j.where(stale & (F.col("n_members") > 0)).select("ws", "community", "member_hash", "n_members", urgency(F.col("of").isNotNull(), changed, F.col("n_members")).alias("urgency"))


def summary_progress(communities: DataFrame, summaries: DataFrame, model: str) -> DataFrame:
    """done, total of communities that have members: done are those whose summary is of these members and this model."""
    s = summaries.select("ws", "community", F.col("member_hash").alias("of"), "model")
    j = communities.where(F.col("n_members") > 0).join(s, ["ws", "community"], "left")
    fresh = F.col("of").eqNullSafe(F.col("member_hash")) & F.col("model").eqNullSafe(F.lit(model))
    return j.agg(F.count_if(fresh).alias("done"), F.count(F.lit(1)).alias("total"))


def summaries_by_size(communities: DataFrame, limit: int = 8) -> DataFrame:
    return communities.orderBy(F.desc("n_members"), "ws", "community").limit(max(1, min(limit, 50)))


def summaries_by_similarity(vectors: DataFrame, q, limit: int = 8) -> DataFrame:
    return vectors.select("community", F.round(cosine_distance(F.col("embedding"), q), 6).alias("distance")).orderBy("distance", "community").limit(max(1, min(limit, 50)))
