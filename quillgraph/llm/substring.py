"""Substring dedup: words covered by a window of words that also starts elsewhere are removed.

A window is known by its anchor, the least hash of its GRAM-word runs: two equal windows have equal anchors, so a
window occurs no more often than its anchor does. Pass 1 counts anchors in count-min sketches, one for each partition,
merged by addition; a window whose anchor's estimate is 1 is certainly unique. Pass 2 groups the windows that are left
by anchor and window hash (128 bits in all) and counts them exactly, so no repeated window is lost and no other window
is taken for one. What the sketch overestimates costs time alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import WordHashes, mixed, table, words_of

WINDOW = 35
GRAM = 8
#: Windows that share an anchor lie this close; also the bits of a mask.
REACH = WINDOW - GRAM + 1
#: Rows of the count-min sketch, and cells of each as a power of two. What a merged sketch tells is two bits a cell
#: (repeated, frequent): 32 MB for both rows together at any size of input, which is what is sent to every executor.
#: With more anchors than cells the sketch lets more unique windows pass; the result stays the same.
ROWS, BITS = 2, 26
BLOCK_BITS = 20
#: An anchor estimated this often is frequent: its windows are dealt out each by its own hash, not by anchor.
FREQUENT = 2000
#: Words handled at a time; bounds the memory whatever the batch.
MOST_WORDS = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the 0..n and to the 0..-n, modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (BASE, inverse))
    return up, down


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Of every run of size values of h, one for each start."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n = 1 << max(16, int(len(h)).bit_length())
    up, down = powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        return mixed((sums[size:] - sums[:-size]) * down[: len(h) - size + 1])


def least_of(x: np.ndarray, size: int, least=np.minimum) -> np.ndarray:
    """Sliding minimum (or maximum) over size values, by doubling."""
    have = 1
    while 2 * have <= size:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


class Windows:
    """The windows of a few documents laid end to end: where they start, their hashes and anchors, and their anchors' places."""

    def __init__(self, lengths: np.ndarray, h: np.ndarray):
        ends = np.cumsum(lengths)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        grams = run_hashes(h, GRAM)
        if len(h) < WINDOW:
            self.start = self.window = self.anchor = np.zeros(0, np.uint64)
            self.start = self.start.astype(np.int64)
            self.places = self.start
            self.grams = grams
            return
        anchor = least_of(grams, REACH)
        starts = np.arange(len(anchor))
        inside = ends[self.doc[: len(anchor)]] - starts >= WINDOW
        self.start = starts[inside]
        self.window = run_hashes(h, WINDOW)[inside]
        self.anchor = anchor[inside]
        # a gram's place counts if some window has it for its anchor
        shown = np.zeros(len(grams), np.uint64)
        shown[: len(anchor)] = np.where(inside, anchor, np.uint64(0))
        padded = np.concatenate([np.zeros(REACH - 1, np.uint64), shown])
        self.places = np.flatnonzero(least_of(padded, REACH, np.maximum) == grams)
        self.grams = grams


def documents_of(hashes: WordHashes, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first, number of words of each, hashes of all) of runs of documents with MOST_WORDS or so."""
    first, lengths, parts, n = 0, [], [], 0
    for i, text in enumerate(column):
        w = words_of(text.as_py())
        lengths.append(len(w))
        parts.append(hashes.of(w, len(w)))
        n += len(w)
        if n >= MOST_WORDS:
            yield first, np.array(lengths, np.int64), np.concatenate(parts)
            first, lengths, parts, n = i + 1, [], [], 0
    if lengths:
        yield first, np.array(lengths, np.int64), np.concatenate(parts)


def cells(anchor: np.ndarray, row: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(anchor + STEP * np.uint64(row)) >> np.uint64(64 - BITS)).astype(np.int64)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's sketch as it grows: (block, cells of it, counts), without the cells that are 0."""
    hashes = WordHashes(60_000)
    for b in batches:
        for _, lengths, h in documents_of(hashes, b.column(0)):
            w = Windows(lengths, h)
            anchors = w.grams[w.places]
            rows = []
            for row in range(ROWS):
                at, n = np.unique(cells(anchors, row), return_counts=True)
                cuts = np.flatnonzero(np.diff(at >> BLOCK_BITS)) + 1
                for c, k in zip(np.split(at, cuts), np.split(np.minimum(n, 65535), cuts), strict=True):
                    if len(c):
                        rows.append(((row << (BITS - BLOCK_BITS)) + int(c[0] >> BLOCK_BITS), (c & ((1 << BLOCK_BITS) - 1)).astype(np.uint32).tobytes(), k.astype(np.uint16).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["block", "at", "n"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the cells of each block; a partition has all rows of its blocks, of which there are a fixed number."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            t = total.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint16))
            at, n = np.frombuffer(at, np.uint32), np.frombuffer(n, np.uint16)
            t[at] += np.minimum(n, 65535 - t[at])
    for block, t in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(t >= 2).tobytes()], pa.binary()), pa.array([np.packbits(t >= FREQUENT).tobytes()], pa.binary())], ["block", "repeated", "frequent"])


class Sketch:
    """Of each cell whether its count is 2 or more, and whether it is FREQUENT or more; blocks without such are left out."""

    def __init__(self, blocks: list):
        self.blocks = {r["block"]: (r["repeated"], r["frequent"] if bytes(r["frequent"]).strip(b"\0") else None) for r in blocks}

    def unpacked(self) -> tuple[np.ndarray, np.ndarray]:
        """Made once a process; the blocks go then."""
        if self.blocks is None:
            return self.out
        out = tuple(np.zeros((ROWS << (BITS - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8) for _ in range(2))
        for block, pair in self.blocks.items():
            for o, packed in zip(out, pair, strict=True):
                if packed is not None:
                    o[block] = np.frombuffer(packed, np.uint8)
        self.blocks, self.out = None, tuple(o.reshape(ROWS, -1) for o in out)
        return self.out


def estimated(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whether the least of the rows' cells has reached the bits' count."""
    out = np.ones(len(anchor), bool)
    for row in range(ROWS):
        at = cells(anchor, row)
        out &= (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def candidates_of(shared):
    """mapInArrow over (rid, rid2, text): rows (deal, anchor, rid, rid2, start, known, heavy, shown, hashes), one for each
    run of windows with one anchor.

    Within a batch a window's hash is sent once, however often it occurs there, with the weight 2 if it occurs more
    than once; that these occurrences are repeated is known at once, as bits of known from the run's start on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = shared.value.unpacked()
        hashes = WordHashes(60_000)
        for b in batches:
            rids, rids2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, lengths, h in documents_of(hashes, b.column(2)):
                w = Windows(lengths, h)
                keep = estimated(repeated, w.anchor)
                start, window, anchor = w.start[keep], w.window[keep], w.anchor[keep]
                if not len(start):
                    continue
                order = np.lexsort((anchor, window))
                same = (window[order][1:] == window[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
                lead = np.concatenate([[True], ~same])
                many = lead & np.concatenate([same, [False]])
                sent, known, weight = (np.zeros(len(start), bool) for _ in range(3))
                sent[order] = lead
                known[order] = ~lead | many
                weight[order] = many
                doc = w.doc[start]
                often = estimated(frequent, anchor)
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | often[1:]])
                # a run has as many windows as a mask has bits, at most
                head = np.flatnonzero(new)
                at = np.arange(len(start)) - np.repeat(head, np.diff(np.append(head, len(start))))
                new |= (at % REACH == 0)
                head = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                bit = np.arange(len(start)) - head[group]
                masks = np.zeros(len(head), np.int64)
                np.bitwise_or.at(masks, group[known], np.int64(1) << bit[known])
                heavy = np.zeros(len(head), np.int64)
                np.bitwise_or.at(heavy, group[weight], np.int64(1) << bit[weight])
                shown = np.zeros(len(head), np.int64)
                np.bitwise_or.at(shown, group[sent], np.int64(1) << bit[sent])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(group[sent], minlength=len(head)))])
                d = doc[head]
                place = start[head] - (np.cumsum(lengths) - lengths)[d]
                rid = rids[first + d]
                # frequent anchors are dealt out by window; runs with nothing to send by their own place
                deal = np.where(often[head], mixed(window[head]), anchor[head])
                with np.errstate(over="ignore"):
                    deal = np.where(shown == 0, mixed(rid.astype(np.uint64) * STEP + place.astype(np.uint64)), deal)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(window[sent].view(np.int64)))
                arrays = [pa.array(deal.view(np.int64)), pa.array(anchor[head].view(np.int64)), pa.array(rid), pa.array(rids2[first + d]), pa.array(place.astype(np.int32)), pa.array(masks), pa.array(heavy), pa.array(shown), lists]
                whole = pa.RecordBatch.from_arrays(arrays, ["deal", "anchor", "rid", "rid2", "start", "known", "heavy", "shown", "hashes"])
                for i in range(0, whole.num_rows, 20_000):
                    yield whole.slice(i, 20_000)

    return run


def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, starts, masks) -> doc_id, n_words, n_removed, kept."""
    for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
        counts, removed, kept = [], [], []
        texts = b.column(1)
        for i in range(b.num_rows):
            w = words_of(texts[i].as_py())
            starts = b.column(2)[i].as_py()
            counts.append(len(w))
            if not starts:
                removed.append(0)
                kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
                continue
            edge = np.zeros(len(w) + 1, np.int64)
            for s, mask in zip(starts, b.column(3)[i].as_py(), strict=True):
                for k in range(REACH):
                    if mask >> k & 1:
                        edge[s + k] += 1
                        edge[s + k + WINDOW] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space): a row for each row of docs.

    A null text has no words. Rows are told apart by place, so equal rows with 35 words or more lose them all, and
    rows that share a doc_id are judged each on its own. An empty table gives an empty result; other columns are not
    looked at. Words are never split or changed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = rows.select("text").mapInArrow(sketched, "block long, at binary, n binary").repartition("block").mapInArrow(summed, "block long, repeated binary, frequent binary")
    shared = docs.sparkSession.sparkContext.broadcast(Sketch(sketch.collect()))
    # a row is known by its id and text, not by its place: a lost task's rows may be read again in another order
    rows = rows.withColumns({"rid": F.xxhash64("doc_id", "text"), "rid2": F.hash("text", "doc_id")})
    runs = rows.select("rid", "rid2", "text").mapInArrow(candidates_of(shared), "deal long, anchor long, rid long, rid2 int, start int, known long, heavy long, shown long, hashes array<long>")
    # of the windows that a run sends, the k-th has the place of the k-th bit of shown
    places = F.filter(F.sequence(F.lit(0), F.lit(REACH - 1)), lambda k: F.getbit("shown", k) == 1)
    runs = runs.repartition("deal").withColumn("w", F.explode_outer(F.arrays_zip(places.alias("k"), F.col("hashes").alias("h"))))
    one = runs.select("deal", "anchor", "rid", "rid2", "start", "known", F.col("w.k").alias("k"), F.col("w.h").alias("h"), F.when(F.expr("getbit(heavy, w.k) = 1"), 2).otherwise(1).alias("weight"))
    # each hash comes from a batch once, so a group has no more rows than there are batches
    n = F.sum("weight").over(W.partitionBy("deal", "anchor", "h"))
    one = one.withColumn("bit", F.when(F.col("k").isNotNull() & (n >= 2), F.expr("shiftleft(1L, k)")).otherwise(F.lit(0)))
    masks = one.groupBy("rid", "rid2", "start").agg(F.bit_or(F.col("bit").bitwiseOR(F.col("known"))).alias("mask")).where(F.col("mask") != 0)
    masks = masks.groupBy("rid", "rid2").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))
    joined = rows.join(masks, ["rid", "rid2"], "left").select("doc_id", "text", "starts", "masks")
    return joined.mapInArrow(rewritten, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
