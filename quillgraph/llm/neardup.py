"""MinHash near-dedup by bottom-k sketches of one hash function.

Documents with one set of shingles are one class. A class retains the K least hashes of its set; inverted lists of
retained values give pairs that overlap; the sketch of a pair's union estimates their resemblance; pairs that may
reach the threshold are confirmed on full sets.

No list is taken whole to make all pairs of it. Two sketches of linked sets share Bounds.shared values or more (by
chance fewer with a probability of LOST; sets of up to Bounds.exact shingles are retained whole and share what the
threshold says). So their rarest K - shared + 3 values, by how many classes retain them, have three in common, and only
the lists of these are made. Of lists with up to SHORT classes all pairs are made, and those that share two such lists
are kept. Each longer one elects a hub, the class whose values are the most widespread, and a class is compared with
the one hub that most of its long lists have. What then has not come into the component that holds most of a list is
looked for by full sets: shingles in the order of how many classes of long lists have them, the first one that two sets
share leaves them no more in common than what follows it in either, so it has to be early in both.

Each class also has its parity bits: the bits of a vector, each flipped by every shingle that hashes to it. Shingles that
only one of two sets has are all that makes their vectors differ, each in one bit at most, so sets whose vectors differ in
more bits than linked sets may differ in shingles are not linked. That is exact, and holds for folded vectors as well:
all candidates are looked at by it, those of the full sets within the join that makes them.

Where many rows have one key, a value or a hub, dealt() copies what they are joined with, so that no task gets them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import WordHashes, compact, mixed, scratch, settle, small_batches, table
from quillgraph.llm.components import components

K = 64
#: The chance that two sketches of linked sets share fewer values than what is asked of them.
LOST = 2e-8
SHORT = 16
#: A key that more than one in so many rows have is dealt to several tasks.
PARTS = 1024
#: How often a class that is apart from most of a list is compared with one more of these, before it is with all.
ROUNDS = 4
#: And with how many of those left it is compared first then; four times as many each time after.
PICKS = 4
#: So many pairs or fewer are compared at once.
FEW_PAIRS = 20_000
#: Rounds end once fewer than one in so many of the compared are linked: pairs chosen by full sets then do better.
WORTH = 4
#: Parity vectors have one to two bits a shingle, within these; FOLD bits of all are kept beside.
FOLD, MOST_PARITY = 512, 1 << 16
#: Values asked of approx_top_k and tracked by it: those of more than one in PARTS of all are among them.
ASKED, TRACKED = 2 * PARTS, 20 * PARTS
TIMES = np.uint64(0xC2B2AE3D27D4EB4F)
TOP = np.uint64(1 << 63)
#: Bits of the filter that picks the documents whose sets are needed: 2 MB, or up to 8 MB for more; what would fill
#: that, too, is joined.
PICK_BITS, MOST_PICK_BITS = 24, 26


class Bounds(NamedTuple):
    least: int  # per cent
    shared: int  # values that sketches of linked sets have in common
    exact: int  # up to so many shingles a linked set's sketch is the set, and so is that of its partner


def bounds(least: int) -> Bounds:
    """A union's sketch has K values at most, each of them shared with a probability of least per cent or more."""
    p, below = least / 100, 0.0
    for shared in range(K + 1):
        below += math.comb(K, shared) * p**shared * (1 - p) ** (K - shared)
        if below > LOST:
            return Bounds(least, shared, K * least // 100)
    return Bounds(least, K, K)


def dealt(left: DataFrame, right: DataFrame, key: str, often: DataFrame | None, by: Column) -> DataFrame:
    """left joined with right on key. often (key, m) has the keys of more than one in PARTS of left's rows, so no more
    than PARTS of them: their rows of left are dealt out by a hash of by, and their rows of right copied to each part.
    """
    if often is None:
        return left.join(right, key)
    often = F.broadcast(often.select(key, F.col("m").alias("_m")))
    x = left.join(often, key, "left").withColumn("_part", F.when(F.col("_m").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_m"))).cast("int")).drop("_m")
    y = right.join(often, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_m", F.lit(1)).cast("int") - 1))).drop("_m")
    return x.join(y, [key, "_part"]).drop("_part")


def frequent(counts: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """often of dealt(): keys with more than one in PARTS of total rows, and the number of parts that they take; None if
    there are none. They are no more than PARTS, and so come to the driver."""
    share = max(SHORT, total // PARTS)
    found = counts.where(F.col(n) > share).select(key, F.ceil(F.col(n) / share).alias("m")).toArrow()
    return counts.sparkSession.createDataFrame(found) if found.num_rows else None


def shingle_set(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; of fewer words than a shingle, that of all of them."""
    h = hashes.of(words, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            out = mixed(out * TIMES + h[k : k + n])
        if len(h) < size:
            out = mixed(out + np.uint64(len(h)))
    return np.unique(out)


def lower_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def signature(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each remainder of hashes: whether an odd number of them has it. As 64-bit words."""
    bits = min(MOST_PARITY, max(FOLD, 1 << (max(1, len(s)) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """The parity of the same hashes in fewer words."""
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def apart_by_parity(x: np.ndarray, y: np.ndarray) -> int:
    """No more than the number of shingles that one of two sets has and the other has not."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def sketching(size: int):
    """mapInArrow over (doc_id, text, print): doc_id, print, n, sig, sketch (in unsigned order, as signed numbers of that order),
    odd (parity), fold (its FOLD bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, sig, sketch, odd, fold = [], [], [], [], []
            for text in b.column(1):
                s = shingle_set(lower_words(text.as_py()), hashes, size)
                n.append(len(s))
                sig.append(signature(s))
                sketch.append((s[:K] ^ TOP).view(np.int64))
                bits = parity(s)
                odd.append(bits.tobytes())
                fold.append(folded(bits, FOLD // 64).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketch])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sketch])))
            folds = pa.ListArray.from_arrays(pa.array(np.arange(len(fold) + 1) * (FOLD // 64), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *fold])))
            columns = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists, pa.array(odd, pa.binary()), folds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n", "sig", "sketch", "odd", "fold"])

    return run


def estimating(maybe: float, least: int):
    """(a, b, look of a, look of b) -> a, b of those whose union's sketch and parity say that they may be linked.

    A whole set may be its sketch: then the union's sketch ends where the shorter-sighted of the two ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sides = [[c.field(k) for k in ("sketch", "odd", "n")] for c in (batch.column(2), batch.column(3))]
            sizes = sides[0][2].to_numpy() + sides[1][2].to_numpy()
            for x, y, p, q, n in zip(sides[0][0], sides[1][0], sides[0][1], sides[1][1], sizes, strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                union = np.union1d(x, y)[:K]
                both = np.intersect1d(x, y, assume_unique=True)
                shared = int(np.searchsorted(both, union[-1], side="right"))
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                keep.append(shared >= maybe * len(union) and apart_by_parity(p, q) * (100 + least) <= n * (100 - least))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def pick(h: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(h.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def picked(size: int):
    """mapInArrow: ids -> the bytes that they set in a filter of 2 ** size bits, as (place, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pick(b.column(0).to_numpy(zero_copy_only=False), size)
            found, k = np.unique(at >> 3, return_inverse=True)
            bits = np.zeros(len(found), np.uint8)
            np.bitwise_or.at(bits, k, np.uint8(1) << (at & 7).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(bits.astype(np.int64))], ["place", "bits"])

    return run


def sets_of(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(vid, members): the full set of each needed (vid, id, sig), settled, as bytes of sorted hashes.

    The texts stay where they are: a filter, sent to all, picks the documents whose sets are made; what it picks too
    many the join drops. Where more are needed than the largest filter can tell apart, texts are joined with ids.
    """
    read = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "text")
    n = needed.count()
    width = min(MOST_PICK_BITS, max(PICK_BITS, n.bit_length() + 3))
    shared = None
    if n << 2 > 1 << width:
        read = read.join(needed.select("id").distinct(), "id", "left_semi")
    else:
        bits = np.zeros(1 << (width - 3), np.uint8)
        for part in needed.select("id").mapInArrow(picked(width), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
            bits[part.column(0).to_numpy()] = part.column(1).to_numpy().astype(np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), None if shared is None else shared.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            hit = np.arange(len(ids))
            if bits is not None:
                at = pick(ids, width)
                hit = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for i in range(0, len(hit), 500):
                part = hit[i : i + 500]
                sets = [shingle_set(lower_words(b.column(1)[int(k)].as_py()), hashes, size) for k in part]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "sig", "members"])

    made = read.mapInArrow(run, "id long, sig binary, members binary")
    # a class has one id and sig, by which its sets stand together after the join
    return made.join(needed.select("vid", "id", "sig"), ["id", "sig"]).dropDuplicates(["id", "sig"]).select("vid", "members")


def confirming(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class Linker:
    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, least: Bounds):
        self.docs, self.classes, self.size, self.bounds = docs, classes, size, least

    def near(self, x: Column, y: Column) -> Column:
        """Whether set sizes allow the link."""
        return F.least(x, y) * 100 >= F.greatest(x, y) * self.bounds.least

    def parity_near(self, x: Column, y: Column, n: Column, m: Column) -> Column:
        """Whether folds of sets of these sizes allow the link."""
        bits = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(FOLD // 64)), F.lit(0))
        return bits * (100 + self.bounds.least) <= (n + m) * (100 - self.bounds.least)

    def of(self, some: DataFrame) -> DataFrame:
        return compact(self.classes.join(some, "vid").select("vid", "id", "sig"))

    def with_both(self, pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
        """Settled pairs (a, b) with x and y, the values (vid, name) of a and b."""
        total = pairs.count()
        for side, out in (("a", "x"), ("b", "y")):
            often = frequent(pairs.groupBy(F.col(side).alias("vid")).agg(F.count(F.lit(1)).alias("n")), "vid", "n", total)
            pairs = dealt(pairs.withColumnRenamed(side, "vid"), values.select("vid", F.col(name).alias(out)), "vid", often, F.col("b" if side == "a" else "a")).withColumnRenamed("vid", side)
        return pairs.select("a", "b", "x", "y")

    def may_link(self, pairs: DataFrame) -> DataFrame:
        """Of settled pairs (a, b)."""
        s = compact(self.classes.select("vid", F.struct("sketch", "odd", "n").alias("look")).join(ends_of(pairs), "vid", "left_semi"), 20_000)
        return compact(self.with_both(pairs, s, "look").mapInArrow(estimating(self.bounds.shared / K - 0.005, self.bounds.least), "a long, b long"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of settled pairs (a, b)."""
        full = compact(sets_of(self.docs, self.of(ends_of(pairs)), self.size), 10_000)
        return compact(self.with_both(pairs, full, "members").mapInArrow(confirming(self.bounds.least), "a long, b long"))

    def connected(self, maybe: DataFrame, found: DataFrame | None, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links found before, and of pairs (a, b) those that connect what these leave apart; and the roots.

        First each class with the partner of the widest reach, which connects most groups; then what this left apart.
        """
        sides = maybe.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(maybe.select(F.col("b").alias("x"), F.col("a").alias("y")))
        often = frequent(sides.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y", "n", 2 * maybe.count())
        first = dealt(sides, reach, "y", often, F.col("x")).groupBy("x").agg(F.max_by("y", F.struct("reach", -F.col("y"))).alias("y"))
        first = compact(first.select(*pair_of(F.col("x"), F.col("y"))).distinct())
        links = self.confirmed(first)
        found = links if found is None else compact(found.unionByName(links))
        roots = settle(components(found))
        rest = compact(rooted(rooted(maybe, roots, "a"), roots, "b").where(F.col("a_root") != F.col("b_root")).select("a", "b").join(first, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            found = compact(found.unionByName(self.confirmed(rest)))
            roots = settle(components(found))
        return found, roots

    def few_by_few(self, left: DataFrame, found: DataFrame, roots: DataFrame, width: int = PICKS) -> DataFrame:
        """Links found before, and of pairs (a, b, x), x being the end that is apart, those that connect what these leave apart.

        Each x tries some partners, and more the next time; what has come together meanwhile is not looked at any more. So
        a class that links with a large component tries a few of its classes, and one that does not tries all there are.
        """
        place = F.row_number().over(W.partitionBy("x").orderBy(F.xxhash64("a", "b"), "a", "b"))
        while n := left.count():
            width = max(width, n) if n <= FEW_PAIRS else width
            ranked = left.withColumn("place", F.lit(1) if width >= n else place)
            links = self.confirmed(self.may_link(compact(ranked.where(F.col("place") <= width).select("a", "b"))))
            rest = ranked.where(F.col("place") > width).select("a", "b", "x")
            if not links.isEmpty():
                found = compact(found.unionByName(links))
                roots = settle(components(found))
                rest = rooted(rooted(rest, roots, "a"), roots, "b").where(F.col("a_root") != F.col("b_root")).select("a", "b", "x")
            left, width = compact(rest, 200_000), 4 * width
        return found

    def early(self, some: DataFrame) -> DataFrame:
        """(vid, value, i, n, df): of the full sets of some classes, the shingles that may be the first shared by a linked
        pair of these, rarest among these first, with their places."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for vid, members in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    values = np.frombuffer(members.as_py(), np.int64)
                    for i in range(0, len(values), 50_000):
                        v = values[i : i + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), vid)), pa.array(v), pa.array(np.full(len(v), len(values)))], ["vid", "value", "n"])

        full = sets_of(self.docs, self.of(some), self.size)
        values = compact(full.mapInArrow(spread, "vid long, value long, n long"), 500_000)
        counts = compact(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= 2))
        per = dealt(values, counts, "value", frequent(counts, "value", "df", values.count()), F.col("vid"))
        per = per.groupBy("vid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"), F.count(F.lit(1)).alias("shared"))
        # shingles of one class alone come first and find no partner
        per = per.select("vid", "n", "shared", F.posexplode("values").alias("i", "v"))
        per = per.select("vid", F.col("v.value").alias("value"), F.col("v.df").alias("df"), "n", (F.col("i") + F.col("n") - F.col("shared")).alias("i"))
        return compact(per.where((F.col("n") - F.col("i")) * 100 >= F.col("n") * self.bounds.least))


def pair_of(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("vid")).unionByName(pairs.select(F.col("b").alias("vid"))).distinct()


def spread(posts: DataFrame) -> DataFrame:
    """posts (value, ...) with df, how many have the value, without values of one alone.

    Values meet once, where they are counted; those that very many have are counted before and stay where they are. A
    value too few or too many among these changes the work and not the result.
    """
    top = posts.agg(F.expr(f"approx_top_k(value, {ASKED}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    share = max(SHORT, top["n"] // PARTS)
    hot = [(x["item"],) for x in top["top"] or [] if x["count"] > share]
    counted = lambda rows: rows.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("value"))).where(F.col("df") >= 2)
    if not hot:
        return counted(posts)
    values = F.broadcast(posts.sparkSession.createDataFrame(pa.table({"value": pa.array([x for (x,) in hot], pa.int64())})))
    counts = posts.join(values, "value").groupBy("value").agg(F.count(F.lit(1)).alias("df"))
    counts = F.broadcast(posts.sparkSession.createDataFrame(counts.toArrow()))
    return counted(posts.join(values, "value", "left_anti")).unionByName(posts.join(counts, "value").where(F.col("df") >= 2))


def listed(classes: DataFrame, b: Bounds) -> DataFrame:
    """(vid, n, reach, c, value, m): the postings of rare values, settled, with the length of their list. c is how many
    values a linked pair has in common among these."""
    per = spread(classes.select("vid", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value")))
    per = per.groupBy("vid", "n", "kept").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"), F.count(F.lit(1)).alias("found"), F.sum(F.log2("df")).alias("reach"))
    o = F.when(F.col("n") <= b.exact, F.ceil(F.col("n") * b.least / 100)).otherwise(F.lit(b.shared)).cast("int")
    c = F.when(o >= 12, 3).otherwise(1)
    # values of one class only come first, have no partner and take their places
    slots = F.col("found").cast("int") - o + c
    rare = compact(per.where(slots > 0).select("vid", "n", (F.col("reach") / F.col("kept")).alias("reach"), c.alias("c"), F.slice("values", F.lit(1), slots).alias("values")), 20_000)
    posts = rare.select("vid", "n", "reach", "c", F.explode("values.value").alias("value"))
    sizes = compact(posts.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= 2), 200_000)
    total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    return compact(dealt(posts, sizes, "value", frequent(sizes, "value", "m", total), F.col("vid")), 200_000)


def links(docs: DataFrame, classes: DataFrame, size: int, least: int) -> DataFrame | None:
    """(a, b) links that connect all classes that are linked; None if there are none."""
    linker = Linker(docs, classes, size, bounds(least))
    near = linker.near
    posts = listed(classes, linker.bounds)

    lists = posts.where(F.col("m") <= SHORT).groupBy("value").agg(F.collect_list(F.struct("vid", "n", "c")).alias("l"))
    later = lambda x, i: F.transform(F.filter(F.slice(F.col("l"), i + 2, F.size("l")), lambda y: near(x["n"], y["n"])), lambda y: F.struct(*pair_of(x["vid"], y["vid"]), F.least(x["c"], y["c"]).alias("c")))
    pairs = lists.select(F.explode(F.flatten(F.transform("l", later))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("times"), F.min("p.c").alias("c"))
    pairs = pairs.where(F.col("times") >= F.when(F.col("c") == 1, 1).otherwise(2)).select("a", "b")

    long = posts.where(F.col("m") > SHORT)
    enough = long.groupBy("vid").agg(F.count(F.lit(1)).alias("t"), F.min("c").alias("least")).where((F.col("t") >= 2) | (F.col("least") == 1)).select("vid")
    long = compact(long.drop("m").join(enough, "vid"), 200_000)
    any_long = not long.isEmpty()
    if any_long:
        hubs = compact(long.groupBy("value").agg(F.max_by(F.struct("vid", "n"), F.struct("reach", -F.col("vid"))).alias("hub"), F.count(F.lit(1)).alias("m")))
        often = frequent(hubs, "value", "m", long.count())
        stars = dealt(long, hubs.drop("m"), "value", often, F.col("vid")).where((F.col("vid") != F.col("hub.vid")) & near(F.col("n"), F.col("hub.n")))
        votes = stars.groupBy("vid", F.col("hub.vid").alias("hub")).agg(F.count(F.lit(1)).alias("votes"))
        best = votes.groupBy("vid").agg(F.max_by("hub", F.struct("votes", -F.col("hub"))).alias("hub"))
        pairs = pairs.unionByName(best.select(*pair_of(F.col("vid"), F.col("hub")))).distinct()
    pairs = compact(pairs)
    maybe = linker.may_link(pairs)

    reach = compact(posts.select(F.col("vid").alias("y"), "reach").distinct(), 200_000)
    found, roots = linker.connected(maybe, None, reach)
    if found.isEmpty() and not any_long and maybe.isEmpty():
        return None
    if not any_long:
        return found
    at, main = apart(long.withColumn("rank", F.lit(0)), roots)
    some = dealt(at, main.select("value"), "value", frequent(main, "value", "m", long.count()), F.col("vid")).select("vid").distinct()
    first = linker.early(compact(some)).join(reach.withColumnRenamed("y", "vid"), "vid")
    first = compact(first.join(classes.select("vid", "fold"), "vid"), 200_000)
    total = first.count()
    for k in range(ROUNDS):
        at, main = apart(first.withColumn("rank", F.col("reach") if k == 0 else F.xxhash64("vid", F.lit(k))), roots)
        outs = dealt(at, main, "value", frequent(main, "value", "m", total), F.col("vid")).where((F.col("root") != F.col("main")))
        votes = outs.groupBy("vid", "pick").agg(F.count(F.lit(1)).alias("votes")).groupBy("vid").agg(F.max_by("pick", F.struct("votes", "pick")).alias("pick"))
        tried = compact(votes.select(*pair_of(F.col("vid"), F.col("pick"))).distinct().join(pairs, ["a", "b"], "left_anti"))
        if tried.isEmpty():
            break
        pairs = compact(pairs.unionByName(tried))
        more = linker.confirmed(linker.may_link(tried))
        if more.isEmpty():
            break
        found = compact(found.unionByName(more))
        roots = settle(components(found))
        if more.count() * WORTH < tried.count():
            break
    at, main = apart(first.withColumn("rank", F.lit(0)), roots)
    often = frequent(main, "value", "m", total)
    first = compact(dealt(at, main.select("value", "main"), "value", often, F.col("vid")), 200_000)
    other = first.select("value", F.col("vid").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("y_root"), F.col("fold").alias("y_fold"))
    can = near(F.col("n"), F.col("m")) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) * (100 + least) >= (F.col("n") + F.col("m")) * least)
    can = can & linker.parity_near(F.col("fold"), F.col("y_fold"), F.col("n"), F.col("m"))
    more = dealt(other, first.where(F.col("root") != F.col("main")), "value", often, F.col("y")).where((F.col("root") != F.col("y_root")) & can)
    # of two that are both apart from the list's main component, one way is enough
    more = more.where((F.col("y_root") == F.col("main")) | (F.col("vid") < F.col("y")))
    left = more.groupBy(*pair_of(F.col("vid"), F.col("y"))).agg(F.min("vid").alias("x")).join(pairs, ["a", "b"], "left_anti")
    return linker.few_by_few(compact(left, 200_000), found, roots)


def apart(lists: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of lists (vid, value, rank, ...) with their root; and of each value that more than one component has:
    main, the component with most of its classes, pick, the one of these with the highest rank, and m, how many have it."""
    at = compact(lists.join(roots.select(F.col("v").alias("vid"), "root"), "vid", "left").withColumn("root", F.coalesce("root", "vid")), 200_000)
    by_root = at.groupBy("value", "root").agg(F.count(F.lit(1)).alias("m"), F.max_by("vid", F.struct("rank", "vid")).alias("pick"))
    best = F.max_by(F.struct("root", "pick"), F.struct("m", -F.col("root"))).alias("best")
    main = by_root.groupBy("value").agg(best, F.count(F.lit(1)).alias("roots"), F.sum("m").alias("m")).where(F.col("roots") > 1)
    return at.drop("rank"), compact(main.select("value", F.col("best.root").alias("main"), F.col("best.pick").alias("pick"), "m"))


def rooted(pairs: DataFrame, roots: DataFrame, side: str) -> DataFrame:
    return pairs.join(roots.select(F.col("v").alias(side), F.col("root").alias(f"{side}_root")), side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))


def grouped(docs: DataFrame, size: int, least: int) -> DataFrame:
    """doc_id, print (a hash of the text), n, root, top: a row for each row of docs. root is the same for all rows of a
    component, null for rows without shingles; top is the component's least doc_id."""
    with small_batches(docs.sparkSession), scratch(docs.sparkSession) as written:  # all that runs Python is written in here
        found = settle(_grouped(docs, size, least))
        written.pop()  # which alone stays
        return found


def _grouped(docs: DataFrame, size: int, least: int) -> DataFrame:
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    schema = "doc_id long, print long, n long, sig binary, sketch array<bigint>, odd binary, fold array<bigint>"
    rows = settle(read.select("doc_id", "text", "print").mapInArrow(sketching(size), schema))
    classes = rows.where(F.col("n") > 0).groupBy("sig").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "sketch", "odd", "fold")])
    # rows without a doc_id are looked up as 0
    classes = settle(classes.withColumns({"vid": F.monotonically_increasing_id(), "id": F.coalesce("least", F.lit(0))}))
    found = links(read, classes, size, least)
    members = classes.select("sig", "vid", "least")
    if found is None:
        members = members.select("sig", F.col("vid").alias("root"), F.col("least").alias("top"))
    else:
        roots = settle(components(found))
        members = members.join(roots.select(F.col("v").alias("vid"), "root"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
        # a class alone needs no look at the others
        tops = members.groupBy("root").agg(F.min("least").alias("top"))
        members = members.join(tops, "root").select("sig", "root", "top")
    often = frequent(rows.where(F.col("n") > 0).groupBy("sig").agg(F.count(F.lit(1)).alias("m")), "sig", "m", rows.count())
    rows = rows.select("doc_id", "print", "n", "sig")
    some = dealt(rows.where(F.col("n") > 0), members, "sig", often, F.struct("doc_id", "print")).drop("sig")
    return some.unionByName(rows.where(F.col("n") == 0).select("doc_id", "print", "n", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("top")))


def groups(docs: DataFrame, size: int = 2, least: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs; links from a resemblance of least per cent on.

    A null text, or one without words, has no shingles and is its own component. Equal texts are linked; rows that
    share a doc_id keep their own texts, and the component's least doc_id is the id of all, those without a doc_id
    too; where none has one, component_id is null and all are kept. An empty table gives an empty result; other columns
    are not looked at. Texts are taken whole, however long.
    """
    found = grouped(docs, size, least)
    component = F.coalesce("top", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, least: int = 80) -> DataFrame:
    """docs, all columns, without the rows that are a near copy of one that stays: of each group the row with the least
    doc_id, null last, then the least hash of its text. Rows without words stay, all of them.
    """
    found = grouped(docs, size, least)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    groups = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    # of a group of one row nothing goes, so only the rows of others are looked up
    groups = settle(groups.where(F.col("rows") > 1))
    if groups.isEmpty():
        return docs
    often = frequent(groups, "root", "rows", found.count())
    copies = dealt(found.where(F.col("root").isNotNull()), groups.select("root", "first"), "root", often, order)
    copies = settle(copies.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("rows"), F.max(order == F.col("first")).alias("is_first")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_print"))
    same = (F.col("_id").eqNullSafe(F.col("doc_id"))) & (F.col("_print") == F.col("print"))
    rows = rows.join(copies, same, "left").where(F.col("rows").isNull() | F.col("is_first"))
    # rows that are equal in id and text: one of them
    once = rows.where(F.coalesce("rows", F.lit(1)) == 1).select("row")
    again = rows.where(F.col("rows") > 1).groupBy("_id", "_print").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.unionByName(again.select("row")).select("row.*")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
