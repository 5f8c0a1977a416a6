"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words; a document's expected number of copies is its source's target over its
source's size. The whole part is allotted to every document; the rest is the document's inclusion probability p,
and the sample is the head of the Pareto order, by u / (1 - u) over p / (1 - p), as far as the words that the whole
copies leave. The sample's size is fixed in words, so a source misses its target by less than a small document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import n_words, sent_if_small, settle, table, unit

#: Documents of a source that fall into one step of its Pareto order on average; what is sorted finely is two such
#: steps and as many documents again as CLOSING, however large the source.
PER_STEP = 1024
#: How many documents past the cut may close the gap that is left before it.
CLOSING = 64
#: The most row numbers that are sent to every executor, 16 bytes each.
PICKS = 200_000


def targets(sizes: DataFrame, ratio: float, most: float, weights: Sequence[float]) -> DataFrame:
    """(skey, n, source_size) by source -> with target: ratio of all words dealt by weight, none above most times its size.

    Sources rank by cap over weight; the capped ones come first, and the level that all the others share is what
    these leave over the weights that are left. A row for each source, so its windows are small.
    """
    at = W.orderBy("skey")
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(at) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "skey")
    s = s.withColumns({
        "total": F.sum("source_size").over(W.partitionBy()) * F.lit(float(ratio)),
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level of the first source that is below its cap holds for all that follow
    s = s.withColumn("share", F.max(F.when(F.col("free"), F.col("level"))).over(W.partitionBy()))
    return s.select("skey", "n", "source_size", F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, ratio: float = 1.5, most: float = 2.0, weights: Sequence[float] = (3, 1, 2), seed: str = "mix", keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: a row for each row of docs. With keep, all columns of
    docs come first, but for those of the new names; without, other columns are not looked at.

    Null texts and texts without words have size 0 and take no words; texts are counted whole, however long. Sources are
    dealt weights by code point, null last. Equal rows count one by one, so one may get a copy more than the other; rows
    of one doc_id and size share their random number and are ordered by where they were read. An empty table gives an
    empty result.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    sized = docs.select(
        *row, "doc_id", "source", n_words(F.col("text")).alias("size"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("skey"),
    )
    sized = settle(sized.withColumns({"u": unit(F.lit(seed), "doc_id", "size"), "rid": F.monotonically_increasing_id()}))
    by_source = sized.groupBy("skey").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    aims = targets(by_source, ratio, most, weights)
    aims = aims.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    aims = aims.withColumn("whole", F.floor(F.col("rate")).cast("long"))
    aims = aims.withColumns({"p": F.col("rate") - F.col("whole"), "rest": F.col("target") - F.col("whole") * F.col("source_size"), "steps": F.greatest(F.lit(1), F.floor(F.col("n") / PER_STEP)).cast("long")})
    # a hot source's rows stay where they are, as long as there are few sources
    aims = sent_if_small(settle(aims))

    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    d = sized.drop("row").join(aims, "skey").where(F.col("p") > 0).select("skey", "rid", "doc_id", "size", "rest", odds.alias("q"), F.floor(F.col("u") * F.col("steps")).alias("step"))
    # a source's p is one number, so steps of u are steps of the Pareto order
    cells = d.groupBy("skey", "step", "rest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("m"))
    run = W.partitionBy("skey").orderBy("step")
    cells = cells.withColumns({"end": F.sum("words").over(run), "docs_end": F.sum("m").over(run)})
    cut = cells.where(F.col("end") > F.col("rest")).groupBy("skey").agg(
        F.min_by(F.struct("step", "docs_end", (F.col("rest") - F.col("end") + F.col("words")).alias("gap")), "step").alias("c"))
    last = cells.join(cut, "skey").where(F.col("step") > F.col("c.step")).where(F.col("docs_end") - F.col("m") < F.col("c.docs_end") + CLOSING)
    cut = cut.join(last.groupBy("skey").agg(F.max("step").alias("last")), "skey", "left").select("skey", F.col("c.step").alias("step"), F.col("c.gap").alias("gap"), F.coalesce("last", "c.step").alias("last"))
    cut = sent_if_small(settle(cut))

    zone = d.drop("rest").alias("d").join(cut.alias("c"), "skey").where(F.col("d.step").between(F.col("c.step"), F.col("last")))
    zone = zone.groupBy("skey", "gap").agg(F.array_sort(F.collect_list(F.struct("q", "doc_id", "rid", "size"))).alias("docs"))
    picked = F.expr("""aggregate(docs, named_struct('left', gap, 'picks', cast(array() as array<bigint>)),
        (a, x) -> if(x.size <= a.left, named_struct('left', a.left - x.size, 'picks', array_append(a.picks, x.rid)), a), a -> a.picks)""")
    # a number for each document near the cut; while these are few the rows, whole texts with keep, stay where they are
    picks = sent_if_small(settle(zone.select(F.explode(picked).alias("rid")).withColumn("more", F.lit(1))), PICKS)

    out = sized.join(aims.select("skey", "source_size", "target", "whole", "p", "steps"), "skey").join(cut.select("skey", F.col("step").alias("cut"), F.lit(1).alias("is_cut")), "skey", "left")
    out = out.join(picks, "rid", "left")
    before = F.when(F.col("p") <= 0, 0).when(F.col("is_cut").isNull(), 1).when(F.floor(F.col("u") * F.col("steps")) < F.col("cut"), 1).otherwise(F.coalesce("more", F.lit(0)))
    copies = (F.col("whole") + before).cast("long")
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": F.col("size") * copies}
    first = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new] if keep else [F.col("doc_id"), F.col("source")]
    return out.select(*first, *[v.alias(k) for k, v in new.items()])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "copies")
