"""Token counts by a digest cache: what a tokenizer's version once counted for a content is joined, never encoded again.

Content is normalised as far as that keeps every count, and hashed. Digests without a count in the cache are encoded
once each, wherever their copies stand, and appended to it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE, settle, shared_folder, table, words_of

COLUMNS = "digest binary, n_tokens long"
#: Counts of parts that a worker remembers, and digests that it knows again.
PARTS, SEEN = 200_000, 500_000
LIMIT = 2048


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file, .json of tokenizers or .model of sentencepiece. parted: white space gives no token and is always
    a border, so that runs of it are alike and a text has as many tokens as its parts between them have."""

    path: str
    parted: bool = False

    def kind(self) -> str:
        kind = Path(self.path).suffix
        if kind not in (".json", ".model"):
            raise ValueError(f"neither .json nor .model: {self.path}")
        return kind

    def version(self) -> str:
        """A digest of all that a count depends on besides the text: the library, the file, and how texts are prepared."""
        from importlib.metadata import version

        library = "tokenizers" if self.kind() == ".json" else "sentencepiece"
        told = f"{library}:{version(library)}:{self.parted}:".encode()
        return hashlib.sha256(told + Path(self.path).read_bytes()).hexdigest()

    def normalised(self, text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return F.trim(F.regexp_replace(text, SPACE, " ")) if self.parted else text


def encoder(kind: str, vocabulary: bytes) -> Callable[[str], int]:
    """Tokens of a text, without begin, end and added special tokens; special strings inside it as the library does by default."""
    if kind == ".json":
        from tokenizers import Tokenizer as Bpe

        bpe = Bpe.from_str(vocabulary.decode())
        bpe.no_truncation()
        bpe.no_padding()
        return lambda text: len(bpe.encode(text, add_special_tokens=False).ids)
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_proto=vocabulary)
    return lambda text: len(pieces.encode(text))


class Parts(dict):
    """Tokens by part (bytes without ASCII white space). Forgets all once it holds too many."""

    def __init__(self, count: Callable[[str], int], most: int = PARTS):
        super().__init__()
        self.count, self.most = count, most

    def __missing__(self, part: bytes) -> int:
        n = self.count(part.decode("utf-8", "surrogatepass"))
        if len(part) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[part] = n
        return n


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, text) without those whose digest this task has seen, so that a hot text is sent once a task."""
    seen: set[bytes] = set()
    for b in batches:
        new = []
        for d in b.column(0).to_pylist():
            new.append(d not in seen)
            if len(seen) >= SEEN:  # a digest that comes again then is sent again, and told apart after the shuffle
                seen.clear()
            seen.add(d)
        yield b.filter(pa.array(new, pa.bool_()))


def encoded(misses: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of (digest, text), of which equal digests stand in one partition: each is encoded once."""
    kind, shared = tokenizer.kind(), misses.sparkSession.sparkContext.broadcast(Path(tokenizer.path).read_bytes())
    parted = tokenizer.parted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(kind, shared.value)
        parts, seen = Parts(count), set()
        for b in batches:
            digests, counts = [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if d not in seen:
                    t = text.as_py()
                    seen.add(d)
                    digests.append(d)
                    counts.append(sum(map(parts.__getitem__, words_of(t))) if parted else count(t))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return misses.mapInArrow(run, COLUMNS)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n_tokens) of a cache. Two runs at a time may both have appended a digest, with the same count."""
    try:
        got = spark.read.schema(COLUMNS).parquet(folder)
    except AnalysisException:  # nothing is there yet
        return spark.createDataFrame([], COLUMNS)
    return got.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, tokenizer: Tokenizer, cache: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit, in place of any columns of these names.

    cache is a folder that driver and executors share; counts lie in it by tokenizer version. Null and empty texts have
    no bytes and no tokens. Rows that are equal, and those of equal content, share a count. A run that is lost before
    its append ends leaves the cache as it was.
    """
    spark = docs.sparkSession
    folder = f"{cache}/version={tokenizer.version()}"
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(tokenizer.normalised(F.col("text")), 256))
    asked = settle(docs.select(digest.alias("digest")).distinct())
    wanted = settle(asked.join(stored(spark, folder), "digest", "left_anti"))
    if not wanted.isEmpty():
        # dealt by digest once, and by name, so that no skew join parts the copies of a text
        texts = docs.select(digest.alias("digest"), text.alias("text")).mapInArrow(once, "digest binary, text string").repartition("digest")
        encoded(texts.join(wanted.hint("shuffle_hash"), "digest", "left_semi"), tokenizer).write.mode("append").parquet(folder)
    # as a table of one row a digest, so that a skew join can part the rows of a hot one
    counts = settle(asked.join(stored(spark, folder), "digest").select(F.col("digest").alias("__digest"), "n_tokens"))
    known = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "__digest": digest})
    out = known.join(counts, "__digest", "left").drop("__digest")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that each run counts all it is given."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = Tokenizer(public_tokenizers.path("word_bpe_49k.json"), parted=True)
    return counted(docs, tokenizer, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}").select("doc_id", "n_bytes", "n_tokens", "over_limit")
