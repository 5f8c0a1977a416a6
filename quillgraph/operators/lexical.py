"""Full-text search over a stored index: where each lexeme stands in each block, and how densely a block covers a query."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import fts
from quillgraph.functions.vector import cosine_distance
from quillgraph.operators.predicates import live
from quillgraph.plans.settle import settled

TOKEN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"
RRF, LEXICAL, VECTOR, CUTOFF = 60, 50, 100, 0.45
BUCKETS = 64
#: Blocks that a task numbers the words of at once, and words whose stems it keeps.
ROWS, WORDS = 500, 200_000
POSTINGS = "lexeme string, page_id long, block_index int, places array<int>, bucket int"


def placed(batches: Iterator[pa.RecordBatch], only: Collection[str] | None = None) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (page_id, block_index, words) -> (lexeme, page_id, block_index, places), some blocks at a time; of all
    lexemes or of some only.

    Words are numbered, so that each is stemmed once, and a block's places never leave their row.
    """
    stems: dict[str, str | None] = dict.fromkeys(fts.STOP)
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            b = whole.slice(start, ROWS)
            n = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
            words = b.column(2).flatten().dictionary_encode()
            if len(stems) > WORDS:
                stems = dict.fromkeys(fts.STOP)
            known = words.dictionary.to_pylist()
            for w in known:
                if w not in stems:
                    stems[w] = fts.stem(w)
            lexemes = list(dict.fromkeys(x for w in known if (x := stems[w]) is not None and (only is None or x in only)))
            at = {x: i for i, x in enumerate(lexemes)}
            lexeme = np.array([at.get(stems[w], -1) for w in known], np.int64)[words.indices.to_numpy()]
            kept = np.flatnonzero(lexeme >= 0)
            kept = kept[np.argsort(lexeme[kept], kind="stable")]  # rows and places are in order already
            lexeme, row, place = lexeme[kept], row[kept], place[kept]
            first = np.flatnonzero(np.diff(lexeme, prepend=-1).astype(bool) | np.diff(row, prepend=-1).astype(bool))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(place)), pa.int32()), pa.array(place, pa.int32()))
            of = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([pa.array(lexemes, pa.string()).take(pa.array(lexeme[first])), b.column(0).take(of), b.column(1).take(of), places], ["lexeme", "page_id", "block_index", "places"])


def postings(blocks: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """(lexeme, page_id, block_index, places) of blocks (page_id, block_index, text), of some lexemes only if these are given: one
    question needs no stored index. Places count all words, stop words too, from 1; a block without words has no rows.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    tokens = blocks.select(F.col("page_id").cast("long").alias("page_id"), F.col("block_index").cast("int").alias("block_index"), words.alias("words"))
    return tokens.mapInArrow(placed if only is None else partial(placed, only=frozenset(only)), "lexeme string, page_id long, block_index int, places array<int>")


def _bucket(lexeme: Column) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(BUCKETS)).cast("int")


def store(blocks: DataFrame, folder: str) -> None:
    """Writes the index of blocks, by buckets of lexemes. Each task writes its blocks' part of every bucket, sorted by lexeme,
    so nothing is shuffled; a block has to be in one row.
    """
    out = postings(blocks).withColumn("bucket", _bucket(F.col("lexeme"))).sortWithinPartitions("bucket", "lexeme")
    out.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def lookup(spark: SparkSession, folder: str, lexemes: Sequence[str]) -> DataFrame:
    """The postings of these lexemes; buckets that have none of them are not read."""
    wanted = spark.read.schema(POSTINGS).parquet(folder)
    if not lexemes:
        return wanted.limit(0).drop("bucket")
    buckets = [r[0] for r in spark.createDataFrame([(x,) for x in lexemes], "lexeme string").select(_bucket(F.col("lexeme"))).distinct().collect()]
    return wanted.where(F.col("bucket").isin(buckets) & F.col("lexeme").isin(list(lexemes))).drop("bucket")


def query_lexemes(q: str) -> list[str]:
    """Of the words of a question, stop words left out; empty if there are no others."""
    return sorted({w for w, _ in fts.lexemes(q)})


def density(places: Column, n: int) -> Column:
    """Of places (place, k), in order, of n lexemes k: the sum over the shortest spans with all of them, of n over 1 and the words
    in between that are none of them.
    """
    start = F.struct(F.lit(0.0).alias("total"), F.array_repeat(F.lit(0), n).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda p, k: F.when(k == x["k"], x["place"]).otherwise(p))
        first = F.array_min(last)  # 0 while one is missing
        more = F.when(first > 0, F.lit(float(n)) / (F.lit(2.0) + x["place"] - first - n)).otherwise(0.0)
        return F.struct((acc["total"] + more).alias("total"), F.transform(last, lambda p: F.when(p > first, p).otherwise(0)).alias("last"))

    return F.aggregate(places, start, step, lambda acc: acc["total"])


def matched(found: DataFrame, lexemes: Sequence[str]) -> DataFrame:
    """(page_id, block_index, density) of the blocks that have all lexemes, from their postings; none without lexemes."""
    n = len(lexemes)
    k = F.array_position(F.array(*[F.lit(x) for x in lexemes]), F.col("lexeme")).cast("int") - 1 if n else F.lit(0)
    each = found.withColumn("k", k).select("page_id", "block_index", "k", F.transform("places", lambda p: F.struct(p.alias("place"), F.col("k").alias("k"))).alias("places"))
    of_block = each.groupBy("page_id", "block_index").agg(F.count_distinct("k").alias("n"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    return of_block.where(F.col("n") == n).select("page_id", "block_index", F.round(density(F.col("places"), n), 9).alias("density"))


def lexical_arm(found: DataFrame, lexemes: Sequence[str], ids: DataFrame, most: int = LEXICAL) -> DataFrame:
    """(page_id, block_index, rank) of the best blocks on pages of ids, filtered before they are cut to their best."""
    order = [F.desc("density"), F.col("page_id"), F.col("block_index")]
    top = matched(found.join(ids, "page_id", "left_semi"), lexemes).orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # over what is left of them


def nearest_chunks(vectors: DataFrame, page_chunks: DataFrame, q: Column, cutoff: float, most: int) -> DataFrame:
    """(hash, distance) of the nearest vectors (hash, embedding, ...) nearer than cutoff among the chunks of page_chunks."""
    near = vectors.join(page_chunks.select("hash").distinct(), "hash", "left_semi").select("hash", F.round(cosine_distance(F.col("embedding"), q), 6).alias("distance"))
    return near.where(F.col("distance") < cutoff).orderBy("distance", "hash").limit(most)


def best_chunks(near: DataFrame, page_chunks: DataFrame) -> DataFrame:
    """(page_id, hash, distance): of each page its nearest chunk. A chunk may be on many pages."""
    best = page_chunks.join(F.broadcast(near), "hash").groupBy("page_id").agg(F.min(F.struct("distance", "hash")).alias("b"))  # near is cut to some 100
    return best.select("page_id", "b.hash", "b.distance")


def vector_arm(vectors: DataFrame, page_chunks: DataFrame, q: Sequence[float], ids: DataFrame, cutoff: float = CUTOFF, most: int = VECTOR) -> DataFrame:
    """(page_id, hash, rank) of the pages of ids whose chunks are nearest to q."""
    mine = page_chunks.join(ids, "page_id", "left_semi").select("page_id", "hash")
    pages = best_chunks(nearest_chunks(vectors, mine, F.lit(list(map(float, q))), cutoff, most), mine)
    return pages.withColumn("rank", F.row_number().over(W.orderBy("distance", "page_id")))


def texts_of(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """(hash, snippet) of the chunks of hits, of which there are no more than a search takes."""
    return texts.select("hash", F.col("text").alias("snippet")).join(F.broadcast(hits.select("hash").distinct()), "hash", "left_semi").dropDuplicates(["hash"])


def hybrid(pages: DataFrame, blocks: DataFrame, found: DataFrame, lexemes: Sequence[str], vectors: DataFrame, page_chunks: DataFrame, texts: DataFrame, q: Sequence[float], readable: DataFrame | None = None, cutoff: float = CUTOFF, limit: int = 20) -> DataFrame:
    """(page_id, title, snippet, score, lexical), best first, of live and readable pages: ranks in both arms, fused.

    A page has a rank for each of its blocks that match and one for its nearest chunk; its snippet is the text of the
    best of these, the block if both rank alike. Ties go to pages that the words found.
    """
    ids = live(pages).select("page_id")
    ids = settled(ids if readable is None else ids.join(readable.select("page_id"), "page_id", "left_semi"))
    # the arms are cut to their best by now, so they go to where the texts are
    lex = blocks.select("page_id", "block_index", F.col("text").alias("snippet")).join(F.broadcast(settled(lexical_arm(found, lexemes, ids))), ["page_id", "block_index"])
    vec = settled(vector_arm(vectors, page_chunks, q, ids, cutoff))
    vec = vec.join(texts_of(texts, vec), "hash")
    arms = lex.select("page_id", "rank", F.lit(0).alias("arm"), "block_index", "snippet").unionByName(vec.select("page_id", "rank", F.lit(1).alias("arm"), F.lit(0).alias("block_index"), "snippet"))
    out = arms.groupBy("page_id").agg(
        F.round(F.sum(1 / (F.lit(float(RRF)) + F.col("rank"))), 6).alias("score"), F.bool_or(F.col("arm") == 0).alias("lexical"), F.min_by("snippet", F.struct("rank", "arm", "block_index")).alias("snippet"),
    )
    out = out.join(pages.select("page_id", "title"), "page_id")
    return out.select("page_id", "title", "snippet", "score", "lexical").orderBy(F.desc("score"), F.desc("lexical"), "page_id").limit(limit)


def related(pages: DataFrame, page_chunks: DataFrame, vectors: DataFrame, texts: DataFrame, page_id: int, limit: int = 5, cutoff: float = CUTOFF) -> DataFrame:
    """(page_id, title, snippet, distance): the live pages of its workspace with the chunks nearest to a page's first one.

    Five times as many chunks as pages are looked up, as many may be on one page; a page counts once, by its nearest.
    A page whose chunks have no vector is related to none.
    """
    mine = page_chunks.where(F.col("page_id") == page_id).join(vectors.select("hash", "embedding"), "hash").orderBy("chunk_index").select("embedding").first()
    q = F.lit(list(map(float, mine[0]))) if mine else F.lit(None).cast("array<double>")
    home = F.broadcast(pages.where(F.col("page_id") == page_id).select("ws").limit(1))
    others = live(pages).where(F.col("page_id") != page_id).join(home, "ws", "left_semi").select("page_id", "title")
    chunks = page_chunks.join(others.select("page_id"), "page_id", "left_semi").select("page_id", "hash")
    best = best_chunks(nearest_chunks(vectors, chunks, q, cutoff, 5 * limit), chunks)
    best = settled(best.orderBy("distance", "page_id").limit(limit))
    best = best.join(texts_of(texts, best), "hash").join(others, "page_id")
    return best.select("page_id", "title", "snippet", "distance").orderBy("distance", "page_id")
