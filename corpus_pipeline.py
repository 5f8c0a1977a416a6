"""From raw documents to a weighted mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontam, langid, mixing, neardup, pii
from quillgraph.llm.common import shared_folder, table

#: Below this score a language is not taken as known.
LEAST_SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in no language that the labelled ones teach; a null lang becomes the predicted one.

    Where no row has a lang there is nothing to judge by, and all documents with a letter stay out.
    """
    columns = docs.columns
    judged = langid.predict(docs, langid.fit(docs))
    known = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id, null last, then with the least hash of its
    text; of rows that are equal in both, one. Documents without words stay, all of them.
    """
    return neardup.one_of_each(docs, size=5)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have a benchmark passage. Null and empty texts have none, equal rows are judged alike,
    and an empty benchmark takes nothing away.
    """
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text. Null texts stay null, equal
    texts are redacted alike.
    """
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with all their columns, and how often the mix takes each: size, source_size, target, copies, taken.

    Null and empty texts have size 0 and take no words; equal rows get copies one by one, so that they may differ; an
    empty table stays empty. Columns of docs with these names are replaced.
    """
    return mixing.mix(docs, keep=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("private", private), ("mixed", mixed)]
#: Language models, similarity components and projections have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
