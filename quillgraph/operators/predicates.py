"""Predicates that every operator shares, each defined once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.settle import written


def live(pages: DataFrame) -> DataFrame:
    return pages.where(~F.col("archived"))


def of_workspace(df: DataFrame, ws: str | None) -> DataFrame:
    return df if ws is None else df.where(F.col("ws") == ws)


def clamp(n: int, most: int) -> int:
    return max(1, min(n, most))


def nearest_above(pages: DataFrame) -> DataFrame:
    """(page_id, found) of (page_id, next, found): what the page or the nearest page above it has found, null if none has.

    Each page knows how things stand some steps up and asks the page there, which knows as much from there on; so the
    steps double, twice a round, and rounds grow with the logarithm of the depth. Pages below one that does not exist or
    in a circle have no row, unless they have found something on the way.
    """
    state = written(pages.select("page_id", "next", "found"))
    closed = F.col("found").isNotNull() | F.col("next").isNull()
    done, open_ = state.where(closed), state.where(~closed)
    for _ in range(state.count().bit_length()):  # a circle would go on for ever
        for _ in range(2):
            above = state.select(F.col("page_id").alias("next"), F.col("next").alias("further"), F.col("found").alias("seen"))
            # those that are through stay as they are, the others look up
            moved = open_.join(above, "next").select("page_id", F.col("further").alias("next"), F.col("seen").alias("found"))
            done, open_ = done.unionByName(moved.where(closed)), moved.where(~closed)
            state = done.unionByName(open_)
        state = written(state)
        done, open_ = state.where(closed), state.where(~closed)
        if open_.isEmpty():
            break
    return done.select("page_id", "found")


def readable(pages: DataFrame, acls: DataFrame) -> DataFrame:
    """page_id, access: the nearest override on the way up, read at a root without one; none is left out."""
    p = pages.select("page_id", F.col("parent_id").alias("next")).join(acls.select("page_id", F.col("access").alias("found")), "page_id", "left")
    return nearest_above(p).select("page_id", F.coalesce("found", F.lit("read")).alias("access")).where(F.col("access") != "none")


def subtree(pages: DataFrame, root: int) -> DataFrame:
    """page_id of a live page and of the live pages below it through live ones."""
    found = F.when(F.col("page_id") == root, True)
    p = live(pages).select("page_id", F.col("parent_id").alias("next"), found.alias("found"))
    return nearest_above(p).where("found").select("page_id")
