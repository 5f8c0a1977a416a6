"""JSON from outside, taken only if it is whole and has the fields that are read, each of its kind."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import is_plausible_entity

# The fields of the store's answers that a client reads. A kind is string, string|null (there, and may be
# null), string? (may be missing, too) or number (finite).
RECORDS: dict[str, dict[str, str]] = {
    "page": {"id": "string", "workspace_id": "string", "parent_id": "string|null", "title": "string", "created_at": "string", "updated_at": "string"},
    "workspace_stats": {"pages": "number", "chunks_indexed": "number", "entities": "number", "edges": "number"},
    "indexing_status": {"embedded": "number", "embed_total": "number", "extracted": "number", "extract_total": "number", "summarised": "number", "summary_total": "number"},
    "quick_hit": {"page_id": "string", "title": "string", "rank": "number"},
    "search_hit": {"page_id": "string", "title": "string", "snippet": "string", "score": "number"},
    "related_hit": {"page_id": "string", "title": "string", "snippet": "string", "distance": "number"},
}
ENTITY = {"name": "string", "entity_type": "string", "description": "string?"}
EDGE = {"source": "string", "target": "string", "relation": "string", "weight": "number"}
EDGES_OF_TEXT = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def parsed(raw: Column) -> Column:
    """The one JSON value that raw is, as a variant; null if it is none, or has a key twice, or anything after it.

    The parser stops at a value's end, so raw is read inside a list whose last item only its own digest can be.
    """
    digest = F.sha2(raw, 256)
    whole = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), digest, F.lit('"]')))
    two = (F.size(F.try_variant_get(whole, "$", "array<variant>")) == 2) & (F.try_variant_get(whole, "$[1]", "string") == digest)
    return F.when(two, F.try_variant_get(whole, "$[0]", "variant"))


def kind(v: Column, path: str = "$") -> Column:
    """STRING, BIGINT, OBJECT<...> and so on of what is at path; null if nothing is."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def has(v: Column, name: str, want: str) -> Column:
    got = kind(v, f"$.{name}")
    if want == "number":
        number = got.isin("BIGINT", "DOUBLE", "FLOAT") | got.startswith("DECIMAL")
        ok = number & (F.abs(F.try_variant_get(v, f"$.{name}", "double")) < float("inf"))
    elif want == "string":
        ok = got == "STRING"
    elif want in ("string|null", "string?"):
        ok = got.isin("STRING", "VOID")
    else:
        raise ValueError(f"no such kind: {want}")
    return F.coalesce(ok, F.lit(want == "string?"))


def accepts(v: Column, fields: Mapping[str, str]) -> Column:
    """Whether v is an object with these fields. Others may be there, so that whoever sends can add some."""
    ok = F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))
    for name, want in fields.items():
        ok = ok & has(v, name, want)
    return ok


def items(v: Column, path: str = "$") -> Column:
    """The list at path as variants; null if there is no list."""
    return F.try_variant_get(v, path, "array<variant>")


def accepts_list(v: Column, fields: Mapping[str, str]) -> Column:
    """Whether v is a list of such objects; one that is not refuses all."""
    return F.coalesce(kind(v).startswith("ARRAY") & F.forall(items(v), lambda x: accepts(x, fields)), F.lit(False))


def fault(v: Column, fields: Mapping[str, str]) -> Column:
    """The first thing that is wrong with v; null if nothing is."""
    found = F.when(v.isNull(), F.lit("not JSON")).when(~kind(v).startswith("OBJECT"), F.lit("not an object"))
    for name, want in fields.items():
        found = found.when(~has(v, name, want), F.lit(f"{name}: no {want}"))
    return found


def record(v: Column, fields: Mapping[str, str]) -> Column:
    return F.struct(*[F.try_variant_get(v, f"$.{name}", "double" if want == "number" else "string").alias(name) for name, want in fields.items()])


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each made once a row: what is generated is not put in place of its name wherever that is read."""
    names = list(columns)
    return df.select("*", F.inline(F.array(F.struct(*[columns[n].alias(n) for n in names]))).alias(*names))


def read(df: DataFrame, raw: str, fields: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """df with record, for rows whose JSON is as it should be, and the others with fault."""
    v = _once(df, __v=parsed(F.col(raw)))
    v = _once(v, fault=fault(F.col("__v"), fields))
    good = v.where(F.col("fault").isNull()).withColumn("record", record(F.col("__v"), fields)).drop("__v", "fault")
    return good, v.where(F.col("fault").isNotNull()).drop("__v")


def _columns(fields: Mapping[str, str]) -> str:
    return ", ".join(f"{name} {'double' if want == 'number' else 'string'}" for name, want in fields.items())


def _alike(kinds: Column, read: Column, fields: Mapping[str, str]) -> Column:
    """True for a list whose items all have these fields and no others, as the kinds of the whole list and what was read of it
    show; else the items have to be looked at one by one. Kinds of a list pass over what an item lacks or has as null.
    """
    number = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+, ?\d+\))"
    of = {"number": number, "string": "STRING", "string?": "(STRING|VOID)"}
    parts = [f"({name}: {of[want]}, )" + ("?" if want == "string?" else "") for name, want in sorted(fields.items())]
    there = lambda e: reduce(and_, [e[n].isNotNull() & (F.abs(e[n]) < float("inf") if want == "number" else F.lit(True)) for n, want in fields.items() if want != "string?"])
    return F.regexp_replace(kinds, ">>$", ", >>").rlike(f"^ARRAY<OBJECT<{''.join(parts)}>>$") & F.forall(read, lambda e: F.coalesce(there(e), F.lit(False)))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGES_OF_TEXT, "")


def extractions(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """df with entities and edges for rows whose raw is a model's answer as asked for, and the others as they came.

    Missing lists are empty; one bad item refuses the answer. Of an answer that is taken, items whose names are no names
    are left out, texts are trimmed, blank descriptions are none, and weights are held between 0 and 1.
    """
    listed = lambda name: F.coalesce(kind(F.col("__v"), f"$.{name}").isNull() | kind(F.col("__v"), f"$.{name}").startswith("ARRAY"), F.lit(False))
    of = lambda name, fields: F.coalesce(F.try_variant_get("__v", f"$.{name}", f"array<struct<{_columns(fields)}>>"), F.array().cast(f"array<struct<{_columns(fields)}>>"))
    each = lambda name, fields: F.forall(F.coalesce(items(F.col("__v"), f"$.{name}"), F.array().cast("array<variant>")), lambda x: accepts(x, fields))
    x = _once(df, __v=parsed(F.col(raw)))
    whole = F.coalesce(kind(F.col("__v")).startswith("OBJECT"), F.lit(False)) & listed("entities") & listed("edges")
    x = _once(x, __whole=whole, __entities=of("entities", ENTITY), __edges=of("edges", EDGE))
    fit = lambda name, fields: F.when(_alike(kind(F.col("__v"), f"$.{name}"), F.col(f"__{name}"), fields), True).otherwise(each(name, fields))
    x = _once(x, __ok=F.col("__whole") & fit("entities", ENTITY) & fit("edges", EDGE))
    named = F.filter("__entities", lambda e: is_plausible_entity(e["name"]))
    entities = F.transform(named, lambda e: F.struct(trimmed(e["name"]).alias("name"), trimmed(e["entity_type"]).alias("entity_type"), F.when(trimmed(e["description"]) != "", e["description"]).alias("description")))
    linked = F.filter("__edges", lambda e: is_plausible_entity(e["source"]) & is_plausible_entity(e["target"]))
    edges = F.transform(linked, lambda e: F.struct(*[trimmed(e[n]).alias(n) for n in ("source", "target", "relation")], F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["weight"])).alias("weight")))
    good = _once(x.where("__ok"), entities=entities, edges=edges).select(*df.columns, "entities", "edges")
    return good, x.where("NOT __ok").select(*df.columns)
