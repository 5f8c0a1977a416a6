"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language. A word it doesn't know falls back to its
character n-grams, five characters first, then ever shorter ones, until some are known. A text's language is the one
with the highest sum.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import crc_of, table

#: The most frequent words kept of each language, and the most languages.
WORDS, LANGUAGES = 20_000, 256
LONGEST = 5
LETTERS = re.compile(r"[^\W\d_]+")
#: Documents scored together; bounds memory whatever the batch.
BLOCK = 400
#: Words that a task counts before it passes their counts on.
COUNTED = 200_000


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # row of scores
    grams: list[dict[str, int]]  # by length
    scores: np.ndarray  # float32, one row for each word and n-gram


def letters(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def build(counts: dict[str, dict[str, int]]) -> Model:
    """From counts of words by language."""
    languages = sorted(counts)
    rows: list[np.ndarray] = []

    def rated(seen: dict[str, np.ndarray]) -> dict[str, int]:
        if not seen:
            return {}
        keys = sorted(seen)
        c = np.array([seen[k] for k in keys])
        rate = np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * len(keys)))
        first = sum(map(len, rows))
        rows.append(rate.astype(np.float32))
        return {k: first + i for i, k in enumerate(keys)}

    by_word: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    by_gram: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(languages))) for _ in range(LONGEST)]
    for k, lang in enumerate(languages):
        for w, n in counts[lang].items():
            by_word[w][k] += n
            padded = f" {w} "
            for size in range(1, LONGEST + 1):
                for i in range(len(padded) - size + 1):
                    by_gram[size - 1][padded[i : i + size]][k] += n
    words, grams = rated(by_word), [rated(g) for g in by_gram]
    return Model(languages, words, grams, np.concatenate(rows) if rows else np.zeros((0, len(languages)), np.float32))


class Scorer(dict):
    """Row of scores by word; rows of unseen words are made as they come, and dropped when there are too many."""

    def __init__(self, model: Model, most: int = 200_000):
        super().__init__(model.words)
        self.model, self.most = model, most
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.update(self.model.words)
        self.extra: list[np.ndarray] = []

    def __missing__(self, word: str) -> int:
        m, padded = self.model, f" {word} "
        score = np.zeros(len(m.languages), np.float32)
        for size in range(min(LONGEST, len(padded)), 0, -1):
            known = [m.grams[size - 1][g] for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) in m.grams[size - 1]]
            if known:
                score = m.scores[known].mean(axis=0)
                break
        self.extra.append(score)
        at = self[word] = len(m.scores) + len(self.extra) - 1
        return at

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.model.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        langs, best = [], []
        if len(self.extra) > self.most:
            self.fresh()
        found = [letters(t) for t in texts]
        rows = [np.fromiter(map(self.__getitem__, ws), np.int64, len(ws)) for ws in found]
        scores = np.concatenate([self.model.scores, np.array(self.extra, np.float32).reshape(-1, len(self.model.languages))]) if self.extra else self.model.scores
        for ws, at in zip(found, rows, strict=True):
            if not any(c.isalpha() for w in ws for c in w):
                langs.append("und")
                best.append(0.0)
                continue
            total = np.zeros(len(self.model.languages))
            for i in range(0, len(at), 100_000):
                total += scores[at[i : i + 100_000]].sum(axis=0, dtype=np.float64)
            k = int(np.argmax(total))
            langs.append(self.model.languages[k])
            best.append(float(1 / np.exp(total - total[k]).sum()))
        return langs, best


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            b = whole.slice(start, BLOCK)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[lang].update(letters(text))
            if sum(map(len, counts.values())) > COUNTED:
                yield from passed_on()
    yield from passed_on()


def fit(train: DataFrame, words: int = WORDS) -> Model:
    """From text and lang of all rows of train; rows without a lang teach nothing."""
    train = train.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return build({})
    counts = train.where(F.col("lang").isin(list(sizes))).select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counts.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= words)
    got: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in top.select("lang", "word", "n").collect():
        got[r["lang"]][r["word"]] = r["n"]
    return build(got)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score in place of any columns of those names.

    A text that is null or has no letter is und, with score 0, and so is every text if nothing was learned. Of
    languages that score the same the first in the order of code points is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*columns)
    at = columns.index("text")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                langs, best = scorer.judge(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(best, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(judged, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of("doc_id") % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
