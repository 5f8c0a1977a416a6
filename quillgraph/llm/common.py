"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Paths of what is settled, of each scratch() that is open.
SCRATCH: list[list[str]] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """df written as Parquet in the session's shared folder, and read from there: no lineage, no plan and no guess at its
    size goes on. (checkpoint() passes on sizes that grow as products over joins; planning these took most of the time.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    if SCRATCH:
        SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is settled within it is deleted at its end, but for what has been taken from the list of paths that it gives."""
    SCRATCH.append([])
    try:
        yield SCRATCH[-1]
    finally:
        for path in SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written between steps, spark.checkpoint.dir. Where none is set, one of this machine's own if
    all of Spark runs in this process, as in tests, and else an error: what one executor writes to its own disk no other sees.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else ""
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """settle(), read back in no more partitions than have so many rows each: for narrow frames that a few tasks can read."""
    out = settle(df)
    return out.coalesce(max(1, -(-out.count() // rows)))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs that run within it pass no more than so many rows at once to Python. Rows with texts or whole sets have kilobytes
    each, and both Spark's side and Python's hold a batch, outside the heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sent_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, marked for broadcast if it has no more rows than that; else left to a shuffled join. df is settled, and narrow."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def n_words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*parts: Column | str) -> Column:
    """A number between 0 and 1, exclusive, fixed by the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\x00")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def crc_of(col: str) -> Column:
    return F.crc32(F.col(col).cast("string"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hash by word (bytes). Forgets all once it holds too many."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=n)


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() parts at the six ASCII white-space characters alone."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
