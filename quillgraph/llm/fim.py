"""Fill-in-middle: each text cut into prefix, middle and suffix at token borders, and written in another order.

An Arrow-batched pandas UDF does it, a text at a time: the end offsets of a text's tokens stand in one compact array, two
of them cut the text, and hashes of the document's id choose the cuts and the form, so that runs and executors agree.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table

UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many change their order at all, and of 100 of these so many have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def ends_of(text: str) -> array:
    """Where each token of text ends."""
    import regex

    return array("Q", (m.end() for m in regex.finditer(UNIT, text)))


def cut(text: str, doc_id: int | None, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, lengths of prefix and middle, and the text in that form."""
    ends = ends_of(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= CHANGED or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that became output. A changed text has no sentinel of its own, so each stands once, and none arises at
    a border, as a sentinel's first sign is only ever its first.
    """
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def transformed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with fim: n, form, prefix_chars, middle_chars, output and the hashes of output and of the text rebuilt from it.

    Null texts are empty, and empty ones plain; a null id is hashed as an empty string; equal ids cut equal texts
    alike. Batches end by bytes (spark.sql.execution.arrow.maxBytesPerBatch), so that long texts come a few at a time. A
    column fim of docs is replaced.
    """

    @F.pandas_udf(SCHEMA)
    def fim(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            n, form, a, m, output = cut(text or "", None if doc_id is None else int(doc_id), seed)
            rows.append((n, form, a, m, output, sha(output), sha(restored(output, form))))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # ids as strings: a column of long with nulls comes as floats, which do not hold every id
    decimal: Column = F.col("doc_id").cast("string")
    return docs.withColumn("fim", fim(decimal, F.col("text")))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return transformed(docs).select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output_sha256", "fim.restored_sha256")
