"""The life of a community's summary: written, left behind by its members, marked as such or written again.

A summary is valid when it is of its community's present members. One that is behind is stale_usable if its community is
large and the model still the same, as it says most of what there is to say, and is only written again when it is asked
for; any other is written again at once.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.communities import member_hashes, pending_summaries
from quillgraph.plans.settle import settled

VALID, STALE = "valid", "stale_usable"
SUMMARIES = "ws string, community int, model string, summary string, state string, member_hash string, created_at timestamp"
#: Names of a community that a summariser is given.
NAMED = 50


class Summariser(ABC):
    """Prose about a community's members. What raises, or is blank, leaves the community waiting."""

    model_id: str

    @abstractmethod
    def summarise(self, names: Sequence[str], members: int) -> str: ...


class StubSummariser(Summariser):
    model_id = "stub-summariser"

    def summarise(self, names, members):
        return f"{members} entities: {', '.join(names[:5])}"


def facts(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ws, community, n_members, names, member_hash) of the communities of wanted as their members are now.

    The hash is of the members that are described, not the one that the queue saw; names are the first by name.
    """
    m = members.join(wanted.select("ws", "community"), ["ws", "community"], "left_semi")
    names = m.groupBy("ws", "community").agg(F.slice(F.array_sort(F.collect_set("name")), 1, NAMED).alias("names"))
    return member_hashes(m).join(names, ["ws", "community"])


def written(facts: DataFrame, summariser: Summariser) -> DataFrame:
    """(ws, community, member_hash, summary): summary is null where there is nothing that could be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, names in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                try:
                    text = summariser.summarise(names, n)
                except Exception:  # a provider's own errors are not known here; the community stays in the queue
                    text = ""
                out.append(text if text and text.strip() else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], ["ws", "community", "member_hash", "summary"])

    kinds = dict(facts.dtypes)
    return facts.select("ws", "community", "member_hash", "n_members", "names").mapInArrow(run, f"ws string, community {kinds['community']}, member_hash string, summary string")


@dataclass(frozen=True)
class Pass:
    """summaries as they are afterwards, and (marked_stale, regenerated, failed) of what was done."""

    summaries: DataFrame
    counts: DataFrame


def _regenerated(summaries: DataFrame, members: DataFrame, wanted: DataFrame, summariser: Summariser, now) -> tuple[DataFrame, DataFrame]:
    tried = settled(written(facts(members, wanted), summariser))
    new = tried.where(F.col("summary").isNotNull()).select("ws", "community", F.lit(summariser.model_id).alias("model"), "summary", F.lit(VALID).alias("state"), "member_hash", now.alias("created_at"))
    return summaries.join(new.select("ws", "community"), ["ws", "community"], "left_anti").select(*new.columns).unionByName(new), tried


def run_once(communities: DataFrame, members: DataFrame, summaries: DataFrame, summariser: Summariser, now=None) -> Pass:
    """One pass over what is pending in communities (ws, community, member_hash, n_members): lazy ones are marked, eager ones
    written. What fails keeps the summary it had, and is pending still.
    """
    now = F.current_timestamp() if now is None else now
    pending = settled(pending_summaries(communities, summaries, summariser.model_id))
    lazy, eager = pending.where(F.col("urgency") == "lazy"), pending.where(F.col("urgency") == "eager")
    marked = summaries.join(lazy.select("ws", "community", F.lit(True).alias("__lazy")), ["ws", "community"], "left")
    marked = marked.withColumn("state", F.when(F.col("__lazy"), STALE).otherwise(F.col("state"))).drop("__lazy")
    out, tried = _regenerated(marked, members, eager, summariser, now)
    counts = tried.agg(F.count_if(F.col("summary").isNotNull()).alias("regenerated"))
    counts = counts.join(pending.agg(F.count_if(F.col("urgency") == "lazy").alias("marked_stale"), F.count_if(F.col("urgency") == "eager").alias("eager")))  # a row each
    return Pass(out, counts.select("marked_stale", "regenerated", (F.col("eager") - F.col("regenerated")).alias("failed")))


def refresh(communities: DataFrame, members: DataFrame, summaries: DataFrame, asked: DataFrame, summariser: Summariser, now=None) -> DataFrame:
    """summaries after a reader has touched those of asked (ws, community): such as are pending are written, whatever their
    urgency; for the others no model is called.
    """
    now = F.current_timestamp() if now is None else now
    wanted = pending_summaries(communities, summaries, summariser.model_id).join(asked.select("ws", "community"), ["ws", "community"], "left_semi")
    return _regenerated(summaries, members, settled(wanted), summariser, now)[0]


def _skipped(communities: DataFrame, usable: DataFrame) -> DataFrame:
    return communities.groupBy("ws").agg(F.count(F.lit(1)).alias("all")).join(usable.groupBy("ws").agg(F.count(F.lit(1)).alias("usable")), "ws", "left").select("ws", (F.col("all") - F.coalesce("usable", F.lit(0))).alias("skipped"))


def _best(candidates: DataFrame, order: list, limit: int) -> DataFrame:
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("ws").orderBy(*order))
    return candidates.withColumn("k", k).where(F.col("k") <= max(1, min(limit, 50)))


def for_search(communities: DataFrame, summaries: DataFrame, model: str, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """The themes of each workspace that a question may read, largest first, then newest, and (ws, skipped): communities that the
    model has no summary of.
    """
    s = summaries.where(F.col("model") == model).select("ws", "community", "summary", "state", "created_at")
    c = communities.select("ws", "community", "n_members").join(s, ["ws", "community"])
    top = _best(c, [F.desc("n_members"), F.desc("created_at"), F.col("community")], limit)
    return top.select("ws", "community", "summary", "state", "n_members"), _skipped(communities, c)


def by_similarity(communities: DataFrame, summaries: DataFrame, vectors: DataFrame, distance, model: str, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """The same, nearest first: distance is a column over vectors (ws, community, ...). Skipped are those without a summary or
    without its vector.
    """
    s = summaries.where(F.col("model") == model).select("ws", "community", "summary", "state")
    v = vectors.select("ws", "community", distance.alias("distance"))
    c = communities.select("ws", "community", "n_members").join(s, ["ws", "community"]).join(v, ["ws", "community"])
    top = _best(c, [F.col("distance"), F.col("community")], limit)
    return top.select("ws", "community", "summary", "state", "n_members", "distance"), _skipped(communities, c)


def workspaces_to_embed(communities: DataFrame, summaries: DataFrame, vectors: DataFrame, model: str, limit: int) -> DataFrame:
    """ws of the workspaces with a summary of model whose vector is missing or of another text (ws, community, summary_hash), those
    with the oldest community first, so that a bounded pass starves none.
    """
    s = summaries.where(F.col("model") == model).select("ws", "community", F.md5("summary").alias("wanted"))
    v = vectors.select("ws", "community", "summary_hash")
    c = communities.select("ws", "community", "created_at").join(s, ["ws", "community"]).join(v, ["ws", "community"], "left")
    c = c.where(~F.col("summary_hash").eqNullSafe(F.col("wanted")))
    return c.groupBy("ws").agg(F.min("created_at").alias("oldest")).orderBy("oldest", "ws").limit(limit)
