"""What extracted answers change in the graph: one set of frames, equal to applying the answers one by one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import is_plausible_entity, normalised_entity
from quillgraph.operators.knowledge import replaced_edges, resolved

SCOPE = ["ws", "hash", "model"]


@dataclass(frozen=True)
class ChangeSet:
    """entities and edges as they are afterwards; affected (ws, hash, model, seq, place, name) and counts (ws, hash, model, seq,
    edges) say what each answer touched, in order, and how many edges it wrote; written has the edges with their places.
    """

    entities: DataFrame
    edges: DataFrame
    written: DataFrame
    affected: DataFrame
    counts: DataFrame


def edges_of(answers: DataFrame) -> DataFrame:
    """(ws, hash, model, seq, place, source, target, relation, weight): each answer's edges with ends resolved, in order."""
    e = answers.select(*SCOPE, "seq", F.posexplode("edges").alias("place", "e")).where(is_plausible_entity(F.col("e.source")) & is_plausible_entity(F.col("e.target")))
    return e.select(*SCOPE, "seq", "place", normalised_entity(F.col("e.source")).alias("source"), normalised_entity(F.col("e.target")).alias("target"), F.col("e.relation").alias("relation"), F.col("e.weight").alias("weight"))


def affected_by(written: DataFrame) -> DataFrame:
    """Ends of the written edges, each once an answer, in the order in which they first come: source before target."""
    ends = F.explode(F.array(F.struct((F.col("place") * 2).alias("place"), F.col("source").alias("name")), F.struct((F.col("place") * 2 + 1).alias("place"), F.col("target").alias("name"))))
    first = written.select(*SCOPE, "seq", ends.alias("e")).groupBy(*SCOPE, "seq", F.col("e.name").alias("name")).agg(F.min("e.place").alias("at"))
    place = F.row_number().over(W.partitionBy(*SCOPE, "seq").orderBy("at")) - 1
    return first.select(*SCOPE, "seq", place.alias("place"), "name")


def applied(entities: DataFrame, edges: DataFrame, answers: DataFrame) -> ChangeSet:
    """answers (ws, hash, model, seq, entities, edges) over entities (ws, name, entity_type, description) and edges (ws, source,
    target, relation, hash, model, weight).

    seq orders answers; of those for the same chunk and model only the last one's edges stay, and an answer without edges
    leaves its chunk with none. An end of an edge that its answer does not list is an entity all the same, and says
    nothing about a type that is known.
    """
    order = lambda place: F.struct("seq", F.lit(place[0]).alias("part"), F.col(place[1]).alias("place")).alias("seq")
    named = answers.select("ws", "seq", F.posexplode("entities").alias("place", "e")).select("ws", F.col("e.name").alias("name"), F.col("e.entity_type").alias("entity_type"), F.col("e.description").alias("description"), order((0, "place")))
    written = edges_of(answers)
    ends = written.select("ws", F.explode(F.array("source", "target")).alias("name"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("description"), order((1, "place")))
    last = answers.groupBy(*SCOPE).agg(F.max("seq").alias("seq"))
    kept = written.join(last, [*SCOPE, "seq"], "left_semi").select("ws", "source", "target", "relation", "hash", "model", "weight", F.col("place").alias("seq"))
    counts = answers.select(*SCOPE, "seq").join(written.groupBy(*SCOPE, "seq").agg(F.count(F.lit(1)).alias("edges")), [*SCOPE, "seq"], "left").fillna(0, ["edges"])
    return ChangeSet(resolved(entities, named.unionByName(ends)), replaced_edges(edges, kept, answers), written, affected_by(written), counts)
