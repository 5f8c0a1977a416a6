"""Typed collections: the compiler of view filters and sorts, boards, calendars, relations, rollups, templates."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import relation_slug
from quillgraph.operators.predicates import clamp, live

OPS = ("eq", "neq", "contains", "gt", "lt", "is_empty", "is_not_empty")
KINDS = ("text", "number", "select", "multi_select", "date", "checkbox", "url", "relation", "rollup")


class ViewError(ValueError):
    """An unknown property, operation or kind."""


@dataclass(frozen=True)
class Filter:
    name: str
    op: str
    value: Any = None


def canonical(value: Any) -> str:
    """JSON with numbers alike whatever they were written as."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def predicate(f: Filter, kinds: Mapping[str, str]) -> Column:
    """A filter over a table with one typed column for each property; null is an unset value."""
    if f.name not in kinds:
        raise ViewError(f"no property {f.name}")
    if f.op not in OPS:
        raise ViewError(f"no operation {f.op}")
    col, kind = F.col(f"`{f.name}`"), kinds[f.name]
    if f.op in ("is_empty", "is_not_empty"):
        return col.isNull() if f.op == "is_empty" else col.isNotNull()
    if f.op in ("eq", "neq"):
        same = F.coalesce(col == F.lit(f.value), F.lit(False))
        return same if f.op == "eq" else ~same  # what is unset differs from every value
    if f.op == "contains":
        if kind == "multi_select":
            wanted = f.value if isinstance(f.value, list) else [f.value]
            return F.coalesce(F.size(F.array_except(F.array(*[F.lit(v) for v in wanted]), col)) == 0, F.lit(False))
        return F.coalesce(F.ilike(col.cast("string"), F.lit(f"%{f.value}%")), F.lit(False))
    left, right = (col.cast("double"), F.lit(float(f.value))) if kind in ("number", "rollup") else (col.cast("string"), F.lit(str(f.value)))
    return F.coalesce(left > right if f.op == "gt" else left < right, F.lit(False))


def view(rows: DataFrame, kinds: Mapping[str, str], filters: Sequence[Filter] = (), sorts: Sequence[tuple[str, bool]] = (), limit: int | None = 500, key: str = "page_id", numeric: bool = False) -> DataFrame:
    """Rows that pass all filters, by the sorts (name, descending), unset last, then by key; text order unless numeric."""
    if unknown := [n for n, _ in sorts if n not in kinds]:
        raise ViewError(f"no property {unknown[0]}")
    out = rows.where(reduce(lambda a, b: a & b, [predicate(f, kinds) for f in filters], F.lit(True)))
    by = [(c.desc_nulls_last() if down else c.asc_nulls_last()) for n, down in sorts for c in [F.col(n) if numeric else F.col(n).cast("string")]]
    return out if limit is None else out.orderBy(*by, key).limit(clamp(limit, 500))


def board(rows: DataFrame, by: str, declared: Sequence[str]) -> DataFrame:
    """value, place, n: declared values in order even if empty, then others by name, then those without one."""
    options = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(declared)], "value string, place int")
    n = rows.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = options.join(n, "value", "left").select("value", "place", F.coalesce("n", F.lit(0)).alias("n"))
    stale = n.where(F.col("value").isNotNull()).join(options, "value", "left_anti").select("value", F.lit(len(declared)).alias("place"), "n")
    unset = rows.agg(F.count_if(F.col(by).isNull()).alias("n")).select(F.lit(None).cast("string").alias("value"), F.lit(len(declared) + 1).alias("place"), "n")
    return known.unionByName(stale).unionByName(unset)


def calendar(rows: DataFrame, by: str) -> DataFrame:
    """day, n by the first ten characters; a null day has the undated."""
    return rows.groupBy(F.substring(F.col(by).cast("string"), 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def rollup(parents: DataFrame, related: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """For each parent: n and total, least, most, latest of value over its related rows.

    Without any, n is 0 and the rest null; with rows but no numbers the total is 0 and least and most are null. The
    latest is the last by order, null or not.
    """
    r = related.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.max_by(value, F.struct(*order)).alias("latest"),
    )
    return parents.select(key).join(r, key, "left").fillna(0, ["n"])


def property_edges(values: DataFrame) -> DataFrame:
    """(title, property, kind, values) -> source, target, relation: one for each select, multi_select or relation value."""
    v = values.where(F.col("kind").isin("select", "multi_select", "relation"))
    return v.select(F.col("title").alias("source"), F.explode("values").alias("target"), relation_slug(F.col("property")).alias("relation")).where(F.col("target").isNotNull())


def validated(kind: str, value: str) -> bool:
    """Whether JSON text is a value of a property kind; JSON null always is."""
    if kind not in KINDS:
        raise ViewError(f"no kind {kind}")
    v = json.loads(value)
    if v is None:
        return True
    if kind == "number":
        return isinstance(v, int | float) and not isinstance(v, bool)
    if kind == "checkbox":
        return isinstance(v, bool)
    if kind in ("multi_select", "relation"):
        return isinstance(v, list) and all(isinstance(x, str) for x in v)
    if kind == "date":
        from datetime import datetime

        try:
            datetime.fromisoformat(v)
        except (TypeError, ValueError):
            return False
        return True
    return isinstance(v, str)


def property_edge_count(edges: DataFrame, live_titles: DataFrame) -> DataFrame:
    """How many property edges leave live pages; live_titles has their column title."""
    return edges.join(live_titles.select(F.col("title").alias("source")), "source", "left_semi").agg(F.count(F.lit(1)).alias("edges"))


def property_edge_counts(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(ws, edges): property edges (ws, page_id, ...) of each workspace's live pages."""
    return edges.join(live(pages).select("ws", "page_id"), ["ws", "page_id"], "left_semi").groupBy("ws").agg(F.count(F.lit(1)).alias("edges"))
