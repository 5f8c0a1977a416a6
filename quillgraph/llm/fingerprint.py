"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

Sketches of that kind merge by union, and compare documents of very unequal length: the share of one's retained
hashes that the other has estimates how much of it the other contains.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE, ascii_lower, settle, table
from quillgraph.llm.spans import bound

SHINGLE = 5
#: One in so many hashes is retained.
SCALE = 8
#: Rows that one step of the order by doc_id holds on average, and the most steps there are.
PER_STEP, STEPS = 1000, 1 << 14


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The retained hashes, distinct and sorted, as array<bigint>.

    Words are ASCII-lower-cased. A text of fewer words than a shingle is one shingle; a text without words has none.
    Short texts may have none below the fraction, too; nothing else is kept, so that the sketch of two texts' shingles is
    always the union of their sketches.
    """
    most = F.lit(-(2**63) + 2**64 // scale)
    trimmed = F.trim(ascii_lower(text), F.lit(" \t\n\x0b\x0c\r"))
    hashed = F.transform(F.split(trimmed, SPACE), lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
        return F.when(F.size(h) >= shingle, many).otherwise(F.array(F.xxhash64(h)))

    def retained(h: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(h, lambda x: x < most)))

    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(bound(bound(hashed, shingled), retained))


def printed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def contained(a: Column, b: Column) -> Column:
    """The share of a's retained hashes that b has, too: 1 if both are empty, 0 if one is."""
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(share)


def resemblance(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_next(docs: DataFrame, carried: list[str], made: Mapping[str, Callable[[Column], Column]] | None = None, per_step: int = PER_STEP) -> DataFrame:
    """doc_id and carried columns, and next, a struct of the carried columns of the row after it; the last has the first.

    made are more columns, functions of the first carried one; they are made once for each row and head of a step.

    Rows are ordered by doc_id (null first), then by the first carried column. Steps between quantiles of doc_id are
    sorted each on its own, so no task holds more than some steps; the end of one looks up the head of the next.
    """
    stats = docs.agg(F.count(F.lit(1)).alias("n")).first()
    steps = 1 << min(int(math.log2(STEPS)), max(0, math.ceil(math.log2(max(1, stats["n"] / per_step)))))
    cuts = []
    if steps > 1:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / steps for i in range(1, steps)], steps * 50).alias("q")).first()["q"] or []
    bounds = F.lit(sorted(cuts) + [2**63 - 1] * (steps - 1 - len(cuts))) if steps > 1 else None
    step = F.lit(0)
    if bounds is not None:
        halves = F.lit([steps >> k for k in range(1, steps.bit_length())])
        step = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(bounds, at + half - 1) < F.col("doc_id"), at + half).otherwise(at))
    order = [F.col("doc_id").asc_nulls_first(), F.col(carried[0]).asc_nulls_first()]
    more = {k: f(F.col(carried[0])) for k, f in (made or {}).items()}
    every = [*carried, *more]
    rows = docs.select("doc_id", *carried, *[v.alias(k) for k, v in more.items()], F.coalesce(step, F.lit(0)).alias("step"))
    # at most STEPS ids, so this is small enough to send to every task
    heads = docs.select("doc_id", F.coalesce(step, F.lit(0)).alias("step")).groupBy("step").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("no_id"))
    heads = heads.select("step", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"))
    ring = W.orderBy("step")
    after = heads.select("doc_id", F.coalesce(F.lag("step").over(ring), F.max("step").over(W.partitionBy())).alias("step"))
    head = F.struct(*carried)
    heads = docs.join(F.broadcast(settle(after)).alias("h"), docs["doc_id"].eqNullSafe(F.col("h.doc_id"))).groupBy("h.step").agg(F.min_by(head, F.struct(F.col(carried[0]).isNotNull(), F.col(carried[0]))).alias("head"))
    heads = settle(heads).select("step", "head.*").select("step", F.struct(*carried, *[v.alias(k) for k, v in more.items()]).alias("head"))
    rows = rows.withColumn("next", F.lead(F.struct(*every)).over(W.partitionBy("step").orderBy(*order)))
    return rows.join(heads, "step", "left").select("doc_id", *every, F.coalesce("next", "head").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, alike_edited, alike_next.

    near is containment of the document's fingerprint in the other, alike their resemblance. A null text is an empty
    one. Rows of one doc_id follow each other by text; a table of one row is its own next. Fingerprints are 16 hex
    digits for each retained hash, in the hashes' order, and empty for texts without words.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(rows, ["text"], {"own": lambda text: sketch(text)})
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", edited.alias("edited"), F.col("next.own").alias("other"))
    rows = rows.withColumns({"edited_own": sketch(F.col("edited"))})
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("own")).alias("fingerprint"), printed(F.col("edited_own")).alias("edited_fingerprint"),
        contained(F.col("own"), F.col("edited_own")).alias("near_edited"), contained(F.col("own"), F.col("other")).alias("near_next"),
        resemblance(F.col("own"), F.col("edited_own")).alias("alike_edited"), resemblance(F.col("own"), F.col("other")).alias("alike_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
