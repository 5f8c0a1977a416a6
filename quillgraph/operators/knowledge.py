"""Writing the graph and asking it: extraction results in, answers out, with stub providers."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import hop_note, is_plausible_entity, normalised_entity, opening, relevance

THEMES = 8


def resolved(known: DataFrame, found: DataFrame) -> DataFrame:
    """(ws, name, entity_type, description): found over known by name. The last explicit type stays, CONCEPT is the first;
    a description is only ever given, not taken away. seq orders what is found."""
    f = found.where(is_plausible_entity(F.col("name"))).withColumn("name", normalised_entity(F.col("name")))
    f = f.groupBy("ws", "name").agg(F.max_by("entity_type", F.when(F.col("entity_type").isNotNull(), F.col("seq"))).alias("t"), F.max_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("d"))
    j = known.join(f, ["ws", "name"], "full")
    return j.select("ws", "name", F.coalesce("t", "entity_type", F.lit("CONCEPT")).alias("entity_type"), F.coalesce("d", "description").alias("description"))


def replaced_edges(edges: DataFrame, new: DataFrame, scope: DataFrame) -> DataFrame:
    """edges without those of scope (ws, hash, model), and new ones, the last weight by seq of each kept."""
    key = ["ws", "source", "target", "relation", "hash", "model"]
    last = new.groupBy(*key).agg(F.max_by("weight", "seq").alias("weight"))
    return edges.join(scope.select("ws", "hash", "model").distinct(), ["ws", "hash", "model"], "left_anti").select(*key, "weight").unionByName(last)


def clean_weight(w):
    """From 0 to 1; no number is 0."""
    return F.when(w.isNull() | F.isnan(w), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)))


@dataclass
class Citation:
    source: str
    text: str
    hops: int
    note: str


@dataclass
class Answer:
    text: str
    citations: list[Citation] = field(default_factory=list)
    subjects: list[str] = field(default_factory=list)
    skipped: int = 0


class Answerer(ABC):
    @abstractmethod
    def answer(self, question: str, subjects: Sequence[str], passages: Sequence[Citation]) -> str: ...


class StubAnswerer(Answerer):
    """Says what it was given, and nothing else."""

    def answer(self, question, subjects, passages):
        about = ", ".join(subjects) or "no named subject"
        cited = "; ".join(f'{c.source} [{c.note}] "{c.text}"' for c in passages)
        count = "one passage" if len(passages) == 1 else f"{len(passages)} passages"
        return f'On "{question.strip()}" (about {about}), {count}: {cited}.'


def local_answer(hits: DataFrame, pages: DataFrame, subjects: DataFrame, question: str, answerer: Answerer) -> Answer:
    """From hits (page_id, hash, hops, score), some k of them; without any the provider is not asked."""
    rows = hits.join(pages.select("page_id", "title", "text"), "page_id").select("title", opening(F.col("text"), 8).alias("text"), "hops", hop_note(F.col("hops")).alias("note"), "score", "page_id")
    got = [Citation(r["title"], r["text"], r["hops"], r["note"]) for r in rows.orderBy(F.desc("score"), "hops", "page_id").collect()]
    if not got:
        return Answer(f'Nothing on file bears on "{question.strip()}".')
    names = [r["name"] for r in subjects.select("name").distinct().orderBy("name").limit(50).collect()]
    return Answer(answerer.answer(question, names, got), got, names)


def themes(summaries: DataFrame, question: str, limit: int = THEMES) -> DataFrame:
    """(community, n_members, summary, distance) nearest first if distance is known, else largest; with relevance."""
    order = ["distance", "community"] if "distance" in summaries.columns else [F.desc("n_members"), F.col("community")]
    top = summaries.where(F.col("summary").isNotNull()).orderBy(*order).limit(max(1, min(limit, 50)))
    return top.withColumn("relevance", relevance(question, F.col("summary"))).orderBy(F.desc("relevance"), "community")


def global_answer(summaries: DataFrame, question: str, answerer: Answerer) -> Answer:
    """A partial answer of each theme, then one of all; themes without a summary are counted as skipped."""
    skipped = summaries.where(F.col("summary").isNull()).count()
    got = [Citation(f"theme {r['community']}", r["summary"], 0, f"relevance {r['relevance']:.2f}") for r in themes(summaries, question).collect()]
    if not got:
        return Answer(f'Nothing on file bears on "{question.strip()}".', skipped=skipped)
    partial = [Citation(c.source, answerer.answer(question, [], [c]), 0, c.note) for c in got]
    return Answer(answerer.answer(question, [], partial), got, skipped=skipped)


def stub_summary(members: DataFrame, most: int = 5) -> DataFrame:
    """(ws, community, summary) of the first members by name."""
    k = F.row_number().over(W.partitionBy("ws", "community").orderBy("name"))
    m = members.select("ws", "community", "name", k.alias("k"), F.count(F.lit(1)).over(W.partitionBy("ws", "community")).alias("n")).where(F.col("k") <= most)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ")
    return m.groupBy("ws", "community").agg(F.concat(F.first("n").cast("string"), F.lit(" entities: "), names).alias("summary"))


def pending_summary_embeddings(summaries: DataFrame, embedded: DataFrame) -> DataFrame:
    """(ws, community, summary) without a vector, or with that of another text."""
    done = embedded.select("ws", "community", F.col("summary_hash").alias("of"))
    return summaries.join(done, ["ws", "community"], "left").where(~F.col("of").eqNullSafe(F.md5("summary"))).select("ws", "community", "summary")


def unpartitioned(edges: DataFrame, communities: DataFrame) -> DataFrame:
    return edges.select("ws").distinct().join(communities.select("ws").distinct(), "ws", "left_anti")
