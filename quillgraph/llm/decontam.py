"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages, whose runs of words are looked up in every document as they stand; a distributed
randomised SVD of the TF-IDF matrix of all passages, with document frequencies of all documents, gives a latent space, that
of the collection which is searched. Windows of every document are projected into it; those with a cosine of COSINE
or more to a passage are candidates, too, and the longest common subsequence of words, together with the passage's rarest
words (its answer, as far as a bare text has one), decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import mixed, table

WORDS = re.compile(r"\w+")
#: Words of a passage, dimensions of the latent space.
PASSAGE, RANK = 64, 192
#: Items handled at once; a larger benchmark is gone through in blocks, each over all documents.
ITEMS = 20_000
COSINE = 0.4
#: Shares of a passage that a document has to have in order: enough alone, or enough with ANSWER of its rarest words.
IN_ORDER, PARTLY, ANSWER = 0.7, 0.5, 0.6
#: Passages with fewer words count only where they stand word for word.
SHORT = 8
#: Words whose windows are projected at once.
PIECE = 4096
#: Windows by words that are marked at once.
CELLS = 1 << 22
#: Words of texts that are looked through together, and passages of one matrix product.
GROUP, TILE = 131_072, 1024
#: Dimensions that the range of the matrix is sought with beyond RANK.
OVERSAMPLE = 8
HITS = "array<struct<item_id:bigint,overlap:double,start:int>>"


#: Of Latin-1, by byte, the lower letter, and a blank for what is in no word.
LOWER = bytes(ord(chr(i).lower()) if WORDS.match(chr(i).lower()) else 32 for i in range(256))


def tokens(text: str | None) -> list[str]:
    """WORDS of the lower-cased text; one of Latin-1 alone, where each letter has one lower one, is split by bytes."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(LOWER).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text.lower())


def passages_of(words: list[str]) -> list[list[str]]:
    """Pieces of PASSAGE words; a rest of less than half joins the piece before it."""
    if len(words) <= PASSAGE:
        return [words] if words else []
    n = max(1, round(len(words) / PASSAGE))
    cuts = [round(i * len(words) / n) for i in range(n + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def scale_of(n: int) -> int:
    """The window that passages of n words are looked for with."""
    return min(PASSAGE, max(4, 1 << round(np.log2(max(1, n)))))


def run_hashes(at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    m = max(0, len(at) - n + 1)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + at[i : i + m].astype(np.uint64)
    return mixed(h)


def runs_of(passages: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By number of words, sorted by hash: the whole of passages shorter than SHORT, of others every run of SHORT words from a multiple of it on."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, at in enumerate(passages):
        n = min(SHORT, len(at))
        found.setdefault(n, []).extend((h, k, i * n) for i, h in enumerate(run_hashes(at, n)[::n].tolist()))
    out = {}
    for n, rows in sorted(found.items()):
        rows.sort()
        out[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32))
    return out


@dataclass
class Index:
    words: dict[str, int]  # from 1 on
    idf: np.ndarray  # 0 is for all other words, which weigh nothing
    latent: np.ndarray  # by word, idf times basis; a row of zeros for 0
    items: list[int]  # by passage
    passages: list[list[str]]
    places: list[dict[str, int]]  # places_of each
    answers: list[set[str]]
    units: np.ndarray  # images of length 1
    scales: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray  # by passage its words, then zeros
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by number of words: hash, passage, place in it

    def search(self, text: str | None) -> list[tuple[int, float, int]]:
        """search_all of one text."""
        return next(self.search_all([text]))

    def search_all(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, float, int]]]:
        """For each text (item, overlap, word where its region begins) of each item that is in it; the best passage of each.

        Texts are laid one behind the other and looked through together, GROUP words or one longer text at once. None
        has a part in what is found for another.
        """
        group, n = [], 0
        for text in texts:
            group.append(tokens(text))
            n += len(group[-1])
            if n >= GROUP:
                yield from self.searched(group)
                group, n = [], 0
        yield from self.searched(group)

    def searched(self, group: list[list[str]]) -> Iterator[list[tuple[int, float, int]]]:
        candidates: list[dict[tuple[int, int], float]] = [{} for _ in group]
        if self.items and any(group):
            laid = Laid.of(group, self.words)
            for k, s, i in self.verbatim(laid):
                candidates[i][k, s] = 1.0
            for k, s, i, cosine in self.alike(laid):
                candidates[i].setdefault((k, s), cosine)
        for t, there in zip(group, candidates, strict=True):
            yield self.decided(t, there)

    def decided(self, t: list[str], candidates: dict[tuple[int, int], float]) -> list[tuple[int, float, int]]:
        best: dict[int, tuple[float, int]] = {}
        for (k, s), _ in sorted(candidates.items(), key=lambda c: (-c[1], c[0])):
            item, p = self.items[k], self.passages[k]
            if item in best and best[item][0] == 1.0:
                continue
            first = max(0, s - len(p) // 2)
            region = t[first : s + int(self.scales[k]) + len(p) // 2]
            if len(p) < SHORT:
                share = float(any(region[i : i + len(p)] == p for i in range(len(region) - len(p) + 1)))
                good = share == 1.0
            else:
                there = set(region)
                if sum(map(there.__contains__, p)) < PARTLY * len(p):
                    continue  # no common subsequence is longer
                share = in_order(self.places[k], len(p), region) / len(p)
                answer = self.answers[k]
                good = share >= IN_ORDER or share >= PARTLY and len(answer.intersection(region)) >= ANSWER * len(answer)
            if good and share > best.get(item, (0.0, 0))[0]:
                best[item] = (share, first)
        return [(item, share, first) for item, (share, first) in sorted(best.items())]

    def verbatim(self, laid: Laid) -> Iterator[tuple[int, int, int]]:
        """(passage, where it would begin, text) of every run of words that a passage and a text have in common."""
        at, known = laid.at, laid.known
        for n, (hashes, passage, place) in self.runs.items():
            first = np.flatnonzero(known[n:] - known[:-n] == n)
            h = run_hashes(at, n)[first]
            low = np.searchsorted(hashes, h)
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h)
            high = np.searchsorted(hashes, h[hit], "right")
            doc = laid.doc_of(first[hit])
            for i, d, a, b in zip((first[hit] - laid.begin[doc]).tolist(), doc.tolist(), low[hit].tolist(), high.tolist(), strict=True):
                for j in range(a, b):
                    yield int(passage[j]), max(0, i - int(place[j])), d

    def alike(self, laid: Laid) -> Iterator[tuple[int, int, int, float]]:
        """(passage, window, text, cosine) of windows that the latent space holds alike and that have enough of its words.

        Both lengths are those of the images in the space: an aligned copy has a cosine of 1, whatever the space keeps.
        """
        at, known, end = laid.at, laid.known, len(laid.at)
        plans = []
        for scale in np.unique(self.scales[self.lengths >= SHORT]).tolist():
            of_scale = np.flatnonzero((self.scales == scale) & (self.lengths >= SHORT))
            length = self.lengths[of_scale]
            half, start = int(length.max()) // 2, laid.starts(scale)
            # what is known around a window is no less than what a subsequence could have
            start = start[known[np.minimum(start + scale + half, end)] - known[np.maximum(start - half, 0)] >= PARTLY * length.min()]
            plans.append((scale, of_scale, length, half, start, [np.ascontiguousarray(self.units[of_scale[i : i + TILE]].T) for i in range(0, len(of_scale), TILE)]))
        for c in range(0, end, PIECE):
            sums, step = None, 0
            for scale, of_scale, length, half, starts, units in plans:
                start = starts[np.searchsorted(starts, c) : np.searchsorted(starts, c + PIECE)]
                if not len(start):
                    continue
                if sums is None:
                    sums = self.summed(at[c : c + PIECE + PASSAGE], scale // 4)
                else:
                    more = scale // 4 // step
                    sums = sum(sums[i::more] for i in range(1, more)) + sums[::more]
                step = scale // 4
                x = self.images(at, start, scale, c, sums)
                far = COSINE * (np.sqrt(np.einsum("ij,ij->i", x, x)) + 1e-12)
                w, k, dot = multiplied(x, units, far)
                if len(w):
                    enough = self.words_there(at, start, w, of_scale[k], scale, half) >= PARTLY * length[k]
                    w, k, dot = w[enough], k[enough], dot[enough]
                    doc = laid.doc_of(start[w])
                    yield from zip(of_scale[k].tolist(), (start[w] - laid.begin[doc]).tolist(), doc.tolist(), (dot / far[w] * COSINE).tolist(), strict=True)

    def words_there(self, at: np.ndarray, start: np.ndarray, w: np.ndarray, k: np.ndarray, scale: int, half: int) -> np.ndarray:
        """How many words of each passage k are around its window w (ascending): no common subsequence is longer."""
        out = np.zeros(len(w), np.int64)
        row = np.cumsum(np.append(0, w[1:] != w[:-1]))
        rows = w[np.append(True, w[1:] != w[:-1])]
        around, size = np.arange(-half, scale + half), len(self.idf)
        codes = np.ascontiguousarray(self.codes[:, : int(self.lengths[k].max(initial=0))].T)
        some = max(1, CELLS // size)
        for i in range(0, len(rows), some):
            begin = start[rows[i : i + some]]
            # what is before the first word is taken as that, which is around then, and behind the last one is a zero
            word = at.take(begin[:, None] + around, mode="clip") + np.arange(len(begin))[:, None] * size
            there = np.zeros(len(begin) * size, np.uint8)
            there[word] = 1
            there[::size] = 0
            a, b = np.searchsorted(row, [i, i + some])
            out[a:b] = there[codes[:, k[a:b]] + (row[a:b] - i) * size].sum(axis=0, dtype=np.uint8)  # passages are shorter than 256
        return out

    def summed(self, at: np.ndarray, step: int) -> np.ndarray:
        """Sums of step words each in the latent space; at is whole passages long."""
        return sum((self.latent[at[i::step]] for i in range(1, step)), self.latent[at[::step]])

    def images(self, at: np.ndarray, start: np.ndarray, scale: int, c: int, sums: np.ndarray) -> np.ndarray:
        """The windows of scale words from each start in the latent space; sums are of a quarter of it each, from c on."""
        step = scale // 4
        half = sums[:-1] + sums[1:]
        out = (half[:-2] + half[2:])[(start - c) // step]
        off = np.flatnonzero(start % step)
        for i in range(0, len(off), 64):
            out[off[i : i + 64]] = self.latent[at[start[off[i : i + 64], None] + np.arange(scale)]].sum(axis=1)
        return out


@dataclass
class Laid:
    """The words of texts one behind the other. Each begins at a multiple of PASSAGE, with PASSAGE zeros or more behind it."""

    at: np.ndarray
    known: np.ndarray  # before each place, how many words that the benchmark has
    begin: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, group: list[list[str]], words: dict[str, int]) -> Laid:
        n = np.array([len(t) for t in group], np.int64)
        room = (n + PASSAGE - 1) // PASSAGE * PASSAGE + PASSAGE
        begin = np.cumsum(room) - room
        at = np.zeros(int(room.sum()) + PASSAGE, np.int32)
        for t, b in zip(group, begin.tolist(), strict=True):
            at[b : b + len(t)] = np.fromiter(map(words.get, t, repeat(0)), np.int32, len(t))
        return cls(at, np.concatenate([[0], np.cumsum(at > 0)]), begin, n)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, "right") - 1

    def starts(self, scale: int) -> np.ndarray:
        """Where windows begin: every quarter of one within a text, its first words and its last ones."""
        grid = np.arange(0, len(self.at), scale // 4)
        doc = self.doc_of(grid)
        within = grid - self.begin[doc]
        last = (self.begin + self.n - scale)[(self.n > scale) & ((self.n - scale) % (scale // 4) != 0)]
        return np.sort(np.concatenate([grid[(within + scale <= self.n[doc]) | (within == 0)], last]))


def multiplied(x: np.ndarray, units: list[np.ndarray], far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x (ascending), column of units, TILE of them in each, and product where it is no less than far of the row.

    Spark's workers have one thread for a product, so one over all rows takes the least CPU time.
    """
    found = []
    for b, unit in enumerate(units):
        product = x @ unit
        at = np.flatnonzero(product >= far[:, None])
        w, k = np.divmod(at, unit.shape[1])
        found.append((w, b * TILE + k, product.ravel()[at]))
    if len(found) == 1:
        return found[0]
    w, k, dot = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.argsort(w, kind="stable")
    return w[order], k[order], dot[order]


def places_of(a: list[str]) -> dict[str, int]:
    """By word a bit for each place it has in a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    return places


def in_order(places: dict[str, int], n: int, b: list[str]) -> int:
    """Length of the longest common subsequence of n words and b, by a bit vector over the former."""
    full = (1 << n) - 1
    v = full
    for m in filter(None, map(places.get, b)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def common(a: list[str], b: list[str]) -> int:
    return in_order(places_of(a), len(a), b)


def document_frequencies(docs: DataFrame, words: dict[str, int]) -> tuple[np.ndarray, int]:
    """By word, how many of all documents have it; and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, n = shared.value, Counter(), 0
        every = frozenset(known)
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                df.update(every.intersection(tokens(text)))
        rows = [(known[w], c) for w, c in df.items()] + [(0, n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["word", "df"])

    out = np.zeros(len(words) + 1)
    for r in docs.select("text").mapInArrow(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect():
        out[r["word"]] = r["df"]
    return out, int(out[0])


def rows_of(texts: list[str | None], words: dict[str, int], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse TF-IDF rows (places, weights) of the passages of texts."""
    for text in texts:
        for p in passages_of(tokens(text)):
            at, n = np.unique(np.fromiter(map(words.get, p, repeat(0)), np.int64, len(p)), return_counts=True)
            n = n[at > 0]
            at = at[at > 0]
            if len(at):
                yield at, n * idf[at]


def basis(spark: SparkSession, matrix: DataFrame, words: dict[str, int], idf: np.ndarray, rank: int) -> np.ndarray:
    """(words + 1) x rank: the first right singular vectors of the matrix (text, weight), by a randomised SVD.

    A first pass over the rows multiplies random vectors by the matrix and its transpose, which gives a basis of its range
    with OVERSAMPLE dimensions to spare; a second one projects the rows into it, and the small matrix of their products
    has the singular values and vectors. Every partition multiplies its own rows; only sums come to the driver.
    """
    size = len(words) + 1
    wide = min(rank + OVERSAMPLE, size)

    def added_up(right: np.ndarray, by_word: bool) -> np.ndarray:
        """The sum over rows r of r times right(r) by word, or of right(r) times itself."""
        shared = spark.sparkContext.broadcast((words, idf, right))

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, idf, right = shared.value
            z = np.zeros((len(right) if by_word else right.shape[1], right.shape[1]), np.float32)
            for b in batches:
                for text, weight in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for at, x in rows_of([text], words, idf):
                        y = weight * (x @ right[at])
                        if by_word:
                            z[at] += weight * x[:, None].astype(np.float32) * y
                        else:
                            z += np.outer(y, y)
            used = np.flatnonzero(z.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([z[i].tobytes() for i in used], pa.binary())], ["at", "z"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z: dict[int, np.ndarray] = {}
            for b in batches:
                for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    v = np.frombuffer(v, np.float32)
                    z[k] = z[k] + v if k in z else v
            yield pa.RecordBatch.from_arrays([pa.array(list(z), pa.int64()), pa.array([v.tobytes() for v in z.values()], pa.binary())], ["at", "z"])

        out = np.zeros((size if by_word else wide, wide))
        for r in matrix.mapInArrow(products, "at long, z binary").repartition("at").mapInArrow(added, "at long, z binary").collect():
            out[r["at"]] = np.frombuffer(r["z"], np.float32)
        return out

    start = np.random.default_rng(0).standard_normal((size, wide)).astype(np.float32)
    q = np.linalg.qr(added_up(start, True))[0].astype(np.float32)
    _, turn = np.linalg.eigh(added_up(q, False))  # squares of the singular values, ascending
    return (q @ turn[:, ::-1][:, :rank].astype(np.float32)).astype(np.float32)


def build(docs: DataFrame, benchmark: DataFrame) -> Index:
    """From at most ITEMS items (item_id, text)."""
    spark = docs.sparkSession
    got = sorted((r["item_id"], r["text"]) for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).collect())
    cut = [(item, p) for item, text in got for p in passages_of(tokens(text))]
    words = {w: i + 1 for i, w in enumerate(sorted({w for _, p in cut for w in p}))}
    df, n = document_frequencies(docs, words)
    idf = np.log(1 + (n + 1) / (df + 1))
    idf[0] = 0
    rank = max(1, min(RANK, len(cut), len(words)))
    latent = basis(spark, benchmark.select("text", F.lit(1.0).alias("weight")), words, idf, rank) * idf[:, None]
    latent[0] = 0
    latent = latent.astype(np.float32)
    at = [np.array([words[w] for w in p], np.int64) for _, p in cut]
    projected = np.array([latent[a].sum(axis=0) for a in at], np.float32).reshape(-1, latent.shape[1])
    lengths = np.array([len(a) for a in at], np.int64)
    codes = np.zeros((len(at), int(lengths.max(initial=0))), np.int32)
    for row, a in zip(codes, at, strict=True):
        row[: len(a)] = a
    rarest = [set(sorted(set(p), key=lambda w: (-idf[words[w]], w))[: max(3, len(p) // 5)]) for _, p in cut]
    return Index(
        words, idf, latent, [item for item, _ in cut], [p for _, p in cut], [places_of(p) for _, p in cut], rarest, projected / (np.linalg.norm(projected, axis=1)[:, None] + np.float32(1e-12)),
        np.array([scale_of(len(p)) for _, p in cut], np.int64), lengths, codes, runs_of(at),
    )


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with hits: (item_id, overlap, start) of every benchmark item whose passage a text has, by item.

    start is the word near which it begins. A null or empty text has no hits, nor have items that are null or have no
    word. Equal texts have equal hits. A column hits of docs is replaced. An empty benchmark gives no hits.
    """
    docs = docs.select(*[c for c in docs.columns if c != "hits"])
    spark, names = docs.sparkSession, docs.columns
    blocks = max(1, -(-benchmark.count() // ITEMS))
    out = docs.withColumn("hits", F.array().cast(HITS))
    for k in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(build(docs, part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=names.index("text"), kind=pa.list_(pa.struct([("item_id", pa.int64()), ("overlap", pa.float64()), ("start", pa.int32())]))) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                found = index.search_all(text.as_py() for text in b.column(at))
                hits = [[*old, *({"item_id": i, "overlap": o, "start": s} for i, o, s in new)] for new, old in zip(found, b.column(b.num_columns - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hits, kind)], b.schema.names)

        kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("overlap", T.DoubleType()), T.StructField("start", T.IntegerType())]))
        out = out.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("hits", kind)]))
    return out.withColumn("hits", F.array_sort("hits"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (comma-joined), overlap (the largest; 0 without hits)."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
        F.array_join(F.transform("hits", lambda h: h["item_id"].cast("string")), ",").alias("item_ids"), F.coalesce(F.array_max("hits.overlap"), F.lit(0.0)).alias("overlap"),
    )
