"""Toxicity by class-conditional Kneser-Ney bigram models.

Each class, toxic and ordinary, has its own bigram and word counts with absolute discounting; what the discounts free
goes to a backoff that both share: of how many different left neighbours each word is seen with in the whole corpus.
An expression keeps counts of its own only if the share of documents that have it differs between the classes by more
than chance would; rarer and evenly spread ones have the shared counts alone, in both models, and cancel.
A text's feature is the difference of its two log-likelihoods over its number of words; a logistic curve fitted on
held-back labelled rows turns it into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import crc_of, table

#: The labelled sample: about so many documents of each class, by hash.
DOCS = 2_000
#: The most words the models know, and in how many sampled documents a word has to be.
WORDS, LEAST_DOCS = 50_000, 3
#: How often a pair has to be seen in the sample to have a probability of its own.
LEAST_PAIRS = 3
#: Standard errors by which document frequencies have to differ.
APART = 4.0
DISCOUNT = 0.75
#: Left neighbours are told apart by so many bits of their hash; with a word's place they fill 63.
HASH = 47
#: Pairs of words that a task holds at once.
PAIRS = 1_000_000
BLOCK = 400


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without what is no letter or digit at their ends."""
    return [t for w in text.lower().split() if (t := w.strip("\"'.,;:!?()[]{}<>|*#$%&@~`^_=+-/\\"))] if text else []


class Words(dict):
    """Place by word, 0 for unknown ones."""

    def __missing__(self, word: str) -> int:
        return 0


@dataclass
class Model:
    words: Words
    lift: np.ndarray  # by word, log of toxic over ordinary probability with nothing known of the word before
    left: np.ndarray  # by word before, log of the weights that the two classes leave to the above
    pairs: np.ndarray  # before * size + word, sorted
    pair_lift: np.ndarray
    curve: tuple[float, ...] = (0.0, 0.0)

    def coded(self, text: str | None) -> np.ndarray:
        t = tokens(text)
        return np.fromiter(map(self.words.__getitem__, t), np.int64, len(t))

    def ratios(self, at: np.ndarray) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        before = np.concatenate([[0], at[:-1]])
        out = self.left[before] + self.lift[at]
        if len(self.pairs) and len(at):
            key = before * len(self.lift) + at
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[k] == key
            out[hit] = self.pair_lift[k[hit]]
        return out

    def features(self, text: str | None) -> list[float]:
        r = self.ratios(self.coded(text))
        if not len(r):
            return [0.0, 0.0]
        return [float(r.mean()), 1.0]

    def score(self, text: str | None) -> float:
        x, any_word = self.features(text)
        bias, slope = self.curve
        z = bias + slope * x if any_word else min(bias, -1.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def neighbours(shared) -> object:
    """mapInArrow: (pair), a word's place and the low HASH bits of its left neighbour's hash; each pair once for every PAIRS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        hashes: dict[str, int] = {}
        kept, n = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                t = tokens(text)
                if len(t) < 2:
                    continue
                at = np.fromiter(map(words.__getitem__, t), np.int64, len(t))
                h = np.fromiter((hash_of(w, hashes) for w in t[:-1]), np.int64, len(t) - 1)
                kept.append(at[1:] << HASH | h)
                n += len(h)
                if n >= PAIRS:
                    kept = [np.unique(np.concatenate(kept))]
                    # what is known once over stays, unless it is most of what there may be
                    n = len(kept[0])
                    if n > PAIRS // 2:
                        yield from pairs_out(kept[0])
                        kept, n = [], 0
        if kept:
            yield from pairs_out(np.unique(np.concatenate(kept)))

    return run


def pairs_out(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(pairs), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 50_000])], ["pair"])


def hash_of(word: str, known: dict[str, int]) -> int:
    h = known.get(word)
    if h is None:
        import xxhash

        if len(known) > 300_000:
            known.clear()
        h = known[word] = xxhash.xxh64_intdigest(word) & (1 << HASH) - 1
    return h


def shared_backoff(docs: DataFrame, words: Words) -> np.ndarray:
    """By word, how many left neighbours it has in all of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    pairs = docs.select("text").mapInArrow(neighbours(shared), "pair long").distinct()
    out = np.zeros(len(words) + 1)
    for r in pairs.groupBy(F.shiftright("pair", HASH).alias("word")).agg(F.count(F.lit(1)).alias("n")).collect():  # at most WORDS rows
        out[r["word"]] = r["n"]
    return out


def apart(docs: list[list[np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """Which keys (sorted) are in clearly more documents of one class than of the other, by length of the classes."""
    shares, n = [], [max(1, len(d)) for d in docs]
    for of_class in docs:
        flat = np.concatenate([np.zeros(0, np.int64), *[np.unique(d) for d in of_class]])
        at = np.searchsorted(keys, flat)
        known = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == flat) if len(keys) else np.zeros(len(flat), bool)
        shares.append(np.bincount(at[known], minlength=len(keys)))
    p = (shares[0] + shares[1] + 1) / (n[0] + n[1] + 2)
    return np.abs(shares[0] / n[0] - shares[1] / n[1]) > APART * np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))


def model_of(coded: list[np.ndarray], toxic: np.ndarray, words: Words, backoff: np.ndarray) -> Model:
    size = len(words) + 1
    shared = (backoff + 0.5) / (backoff + 0.5).sum()
    by_class = [[d for d, y in zip(coded, toxic, strict=True) if y == label] for label in (1, 0)]
    own = apart(by_class, np.arange(size))
    pairs_of = [[d[:-1] * size + d[1:] for d in docs if len(d) > 1] for docs in by_class]
    counted = [np.unique(np.concatenate([np.zeros(0, np.int64), *p]), return_counts=True) for p in pairs_of]
    pairs = np.unique(np.concatenate([u[n >= LEAST_PAIRS] for u, n in counted]))
    pairs = pairs[apart(pairs_of, pairs)]
    rates, left, likely = [], [], []
    for docs, (u, n) in zip(by_class, counted, strict=True):
        flat = np.concatenate([np.zeros(0, np.int64), *docs])
        c = np.bincount(flat, minlength=size).astype(float)
        kept = np.where(own, np.maximum(c - DISCOUNT, 0), 0.0)
        # what all other words have together is dealt by the shared counts, and the same share of it in both classes
        freed = (c.sum() + 1 - kept.sum()) / shared[~own].sum() if (~own).any() else 0.0
        rates.append(np.where(own, kept + DISCOUNT * shared, freed * shared) / (c.sum() + 1))
        before = np.bincount(np.concatenate([np.zeros(0, np.int64), *[d[:-1] for d in docs if len(d) > 1]]), minlength=size).astype(float)
        m = np.zeros(len(pairs))
        if len(u) and len(pairs):
            at = np.minimum(np.searchsorted(u, pairs), len(u) - 1)
            m = np.where(u[at] == pairs, np.maximum(n[at] - DISCOUNT, 0), 0.0)
        weight = (before - np.bincount(pairs // size, weights=m, minlength=size) + 1) / (before + 1)
        left.append(weight)
        likely.append((m, before))
    lift, weight = np.log(rates[0]) - np.log(rates[1]), np.log(left[0]) - np.log(left[1])
    v, w = pairs // size, pairs % size
    chance = [np.log(m / (before[v] + 1) + left[k][v] * rates[k][w]) for k, (m, before) in enumerate(likely)]
    return Model(words, lift, weight, pairs, chance[0] - chance[1])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Bias and slope by Newton steps with a little ridge; both classes weigh as they come."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = DOCS) -> Model:
    """From docs (doc_id, text) and labels (doc_id, toxic), of which about per_class rows a class are drawn by hash; backoff from all docs."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = Words()
    if len(sizes) < 2:
        none = Model(words, np.zeros(1), np.zeros(1), np.zeros(0, np.int64), np.zeros(0))
        none.curve = (-5.0 if 1 not in sizes else 5.0, 0.0)
        return none
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, per_class / n))])
    # some 2 * per_class rows, so they go to where the texts are
    drawn = labels.where(draw < share[F.col("toxic")]).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    if len({r["toxic"] for r in rows}) < 2:  # labels of documents that are not there
        return fit(docs, labels.where(F.lit(False)), per_class)
    toxic = np.array([r["toxic"] for r in rows])
    texts = [r["text"] for r in rows]
    del rows
    seen = Counter(w for t in texts for w in set(tokens(t)))
    top = sorted((w for w, n in seen.items() if n >= LEAST_DOCS), key=lambda w: (-seen[w], w))[:WORDS]
    words.update({w: i + 1 for i, w in enumerate(top)})
    backoff = shared_backoff(docs, words)
    blank = Model(words, np.zeros(len(words) + 1), np.zeros(len(words) + 1), np.zeros(0, np.int64), np.zeros(0))
    coded = [blank.coded(t) for t in texts]
    # the curve is fitted on rows that the models behind its features haven't seen
    half = np.arange(len(coded)) % 2
    x = np.zeros(len(coded))
    for side in (0, 1):
        other = model_of([c for c, h in zip(coded, half, strict=True) if h != side], toxic[half != side], words, backoff)
        for i in np.flatnonzero(half == side):
            x[i] = other.ratios(coded[i]).mean() if len(coded[i]) else 0.0
    model = model_of(coded, toxic, words, backoff)
    bias, slope = logistic(x, toxic)
    # back from the sample's share of toxic rows to that of all labelled ones
    odds = lambda n: np.log(n.get(1, 0) / n.get(0, 0))
    bias += odds(sizes) - odds({k: int((toxic == k).sum()) for k in (0, 1)}) if 0 < toxic.sum() < len(toxic) else 0.0
    model.curve = (float(bias), slope)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted. Null, empty and word-less texts get the prior's score, below one half.

    Without labelled rows of both classes every text gets one score: near 0, or near 1 if only toxic ones are known.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                s = [m.score(t) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [*b.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False))
    model = fit(docs, labels.where(~held_out))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
