"""Spans of pattern matches in code points, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Matches whose running sums one fold makes; a fold copies what it has so far for each of them.
SUMS = 256


def bound(col: Column, use) -> Column:
    """use(col) with col made once, where use reads it again and again."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def summed(lengths: Column) -> Column:
    """Running sums."""
    return F.aggregate(lengths, F.array().cast("array<int>"), lambda a, x: F.array_append(a, x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))))


def one_at(x: Column, i: Column, blocks: Column, ends: Column) -> Column:
    k = F.floor(i / SUMS).cast("int")
    end = F.get(F.get(blocks, k), i % SUMS) + F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0))
    return F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("hit"))


def spans(text: Column, pattern: str) -> Column:
    """[(start, end, hit)] of the leftmost matches that do not overlap; end is exclusive.

    pattern has no capturing groups. Each match is taken together with the gap before it, whose lengths add up to
    its place; \\G keeps a gap that nothing follows from being tried from each of its characters. So \\G in a pattern is the end of the match before.
    """
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def placed(pairs: Column) -> Column:
        """Ends are running sums of lengths, made block by block, so that no long array is copied for every match."""
        lengths = F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["hit"]))
        firsts = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / SUMS).cast("int"))
        blocks = bound(lengths, lambda n: F.transform(firsts, lambda k: summed(F.slice(n, k * SUMS + 1, F.lit(SUMS)))))

        def within(blocks: Column) -> Column:
            # where each block ends
            ends = summed(F.transform(blocks, lambda b: F.element_at(b, -1)))
            return bound(ends, lambda at: F.transform(pairs, lambda x, i: one_at(x, i, blocks, at)))

        return bound(blocks, within)

    pairs = F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"))
    return bound(pairs, lambda p: F.when(F.size(p) == 0, none).otherwise(placed(p)))


def where_any(text: Column, hint: str, found: Column) -> Column:
    """found where text has a match of hint, a cheap necessary pattern; else an empty array."""
    return F.when(F.rlike(text, F.lit(hint)), found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def labelled(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(found: Column, names: list[str]) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = lambda k: F.get(F.array(*[F.lit(n) for n in names]), k)
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
