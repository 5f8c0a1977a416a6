"""Background work over the queues: providers by name, extraction fanned out to tenants, draining, full runs, plugins."""

from __future__ import annotations

import re
import signal
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators import communities, graph, ingest, summaries
from quillgraph.operators.predicates import live
from quillgraph.operators.queues import pending_extraction

STALLED = 3
TRIM = re.compile(r"^[\W_]+|[\W_]+$")


class ProviderError(ValueError):
    """A provider's name that says nothing known."""


@dataclass(frozen=True)
class Provider:
    kind: str
    model: str | None = None


def provider(spec: str) -> Provider:
    """stub, or kind:model with a kind that is known here; anything else is an error, not a default."""
    kind, colon, model = spec.partition(":")
    if spec == "stub":
        return Provider("stub")
    if kind in ("ollama", "gemini") and colon and model:
        return Provider(kind, model)
    raise ProviderError(spec)


class RateLimited(Exception):
    """The provider takes no more for now, from any text."""


class Extractor(ABC):
    model_id: str

    @abstractmethod
    def extract(self, text: str) -> tuple[list[str], list[tuple[str, str, str, float]]]:
        """Names, and (source, target, relation, weight)."""


class StubExtractor(Extractor):
    """Capitalised words, each linked with the one after it."""

    model_id = "stub-extractor"

    def extract(self, text):
        names = [n for w in text.split() if w[0].isupper() and (n := TRIM.sub("", w))]
        return names, [(a, b, "mentions_with", 1.0) for a, b in zip(names, names[1:], strict=False)]


def extracted(pages: DataFrame, done: DataFrame, extractor: Extractor) -> DataFrame:
    """(hash, model, names, edges, failed) of the chunks that some workspace waits for, each extracted once.

    A failure is one chunk's own. When the provider is rate-limited a task asks it no more: what it has not asked for has
    no row, and waits for the next pass.
    """
    wanted = pending_extraction(pages, done).select("hash").distinct()
    texts = live(pages).join(wanted, "hash", "left_semi").groupBy("hash").agg(F.first("text").alias("text"))
    edge = pa.struct([("source", pa.string()), ("target", pa.string()), ("relation", pa.string()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, names, edges, failed, limited = [], [], [], [], False
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    n, e = extractor.extract(text or "")
                    bad = False
                except RateLimited:
                    limited = True
                    break
                except Exception:  # one text's failure is its own; it stays pending
                    n, e, bad = [], [], True
                hashes.append(h)
                names.append(n)
                edges.append([dict(zip(("source", "target", "relation", "weight"), x, strict=True)) for x in e])
                failed.append(bad)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array([extractor.model_id] * len(hashes), pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(edges, pa.list_(edge)), pa.array(failed, pa.bool_())], ["hash", "model", "names", "edges", "failed"])
            if limited:
                return

    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("weight", T.DoubleType())])
    schema = T.StructType([T.StructField("hash", T.StringType()), T.StructField("model", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("edges", T.ArrayType(kind)), T.StructField("failed", T.BooleanType())])
    return texts.mapInArrow(run, schema)


def fanned_out(results: DataFrame, pages: DataFrame) -> DataFrame:
    """results for every workspace with a live page that has the chunk."""
    return results.where(~F.col("failed")).join(live(pages).select("ws", "hash").distinct(), "hash")


def drain(step: Callable[[], int], stalled: int = STALLED) -> int:
    """Calls step until its queue is empty (None), or it has done nothing so many times in a row; what it did in all."""
    done = idle = 0
    while idle < stalled:
        n = step()
        if n is None:
            break
        done, idle = done + n, 0 if n else idle + 1
    return done


def full_run(pages: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members of the new communities, and these by member hash, with what known has of those that survive."""
    members = communities.partition(graph.pair_weights(graph.clusterable_of(pages)))
    new = communities.member_hashes(members)
    return members, new if known is None else communities.swapped(known, new)


def backfilled(pages: DataFrame, embedder: ingest.Embedder, summariser: summaries.Summariser | None = None) -> dict[str, DataFrame]:
    """All stages from pages on, each over what the one before it made: chunks, vectors, the graph without what no live page
    holds up any more, communities, and with a summariser their summaries and these texts' vectors.
    """
    chunks = ingest.chunked(live(pages))
    unique = ingest.deduplicated_chunks(chunks)
    edges = graph.edges(pages)
    members, named = full_run(pages)
    kept = graph.clusterable(edges, pages)
    out = {"page_chunks": chunks, "chunks": unique, "embeddings": ingest.embedded(unique, embedder), "edges": kept, "reaped": graph.reap_counts(edges, graph.entities(pages), pages), "members": members, "communities": named}
    if summariser is not None:
        none = pages.sparkSession.createDataFrame([], summaries.SUMMARIES)
        out["summaries"] = summaries.run_once(named, members, none, summariser).summaries
        out["summary_embeddings"] = ingest.embedded(out["summaries"].select(F.md5("summary").alias("hash"), F.col("summary").alias("text")).distinct(), embedder)
    return out


class Plugins:
    """Column functions by name, which SQL can call, with what they may know of their host."""

    def __init__(self, spark: SparkSession, ws: str, settings: dict[str, str] | None = None):
        self.spark, self.ws, self.settings, self.names = spark, ws, dict(settings or {}), []

    def register(self, name: str, f: Callable, returns: str, seconds: float | None = 10.0) -> None:
        """f(host, *values) on one row's values, which come in Arrow batches; host has ws and settings. A call that raises, or
        takes longer than that many seconds, gives null and costs its row alone.
        """
        host = {"ws": self.ws, "settings": self.settings}

        def guarded(*values):
            with deadline(seconds):
                try:
                    return f(host, *values)
                except Exception:  # whatever a plugin does wrong is its own row's
                    return None

        self.spark.udf.register(name, F.udf(guarded, returns, useArrow=True))
        self.names.append(name)


class TookTooLong(Exception):
    pass


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Raises TookTooLong in what runs within once the time is over; for a worker's main thread."""
    if seconds is None:
        yield
        return

    def over(*_):
        raise TookTooLong

    before = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
