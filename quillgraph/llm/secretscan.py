"""Secret scans: three base patterns, and candidate strings by sliding-window entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.llm.spans import joined, labelled, spans, where_any

#: Kinds in the order of the result; what the entropy finds outside these is of the last.
KINDS = ["assign", "access", "hex", "entropy"]
# Fixed values of the base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]++"

#: Candidates are whole runs of these characters, of 20 or more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CANDIDATE = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}+"
WINDOW = 20
#: Bits a character that the most mixed window of a class reaches in a secret. 20 hex digits drawn at random have
#: 3.2 bits on average, 20 of 62 characters 4.0.
HEX_BITS, MIXED_BITS = 2.8, 3.5
#: What looks random and is no secret: UUIDs, addresses, version numbers and dates; and, tested part by part, paths and
#: names of letters with joints. (A repeated group would need stack for each repetition.)
ALLOWED = r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|(?:(?:https?:?)?//|www\.).*|[0-9.+/_=-]+|.*\.(?:com|org|net|html?|php|js|css|png|jpe?g|gif)[.]?)$"
JOINTS, PART = "[./_=+-]+", "^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}|)$"


def most_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy of a window of text in bits a character; of all of it if it is shorter.

    One pass: counts by character and the sum of c * log2(c) over them change by the character that enters and the
    one that leaves.
    """
    part = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    none = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    start = F.struct(none.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        """Counts first; what the sum loses and gains follows from the two counts that have changed."""
        enters, leaves = x["enters"], x["leaves"]
        c, d = F.get(a["counts"], enters), F.get(a["counts"], F.greatest(leaves, F.lit(0)))
        moved = F.when(leaves < 0, part(c + 1) - part(c)).when(leaves == enters, F.lit(0.0)).otherwise(part(c + 1) - part(c) + part(d - 1) - part(d))
        counts = F.transform(a["counts"], lambda v, k: F.when(k == enters, v + 1).otherwise(v) - F.when(k == leaves, 1).otherwise(0))
        total, width = a["total"] + moved, F.least(x["n"], F.lit(window))
        bits = F.when(x["i"] >= width, F.log2(width.cast("double")) - total / width).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(a["best"], bits).alias("best"))

    def over(codes: Column) -> Column:
        moves = F.transform(codes, lambda c, i: F.struct(c.alias("enters"), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1)).alias("leaves"), (i + 1).alias("i"), F.size(codes).alias("n")))
        return F.aggregate(moves, start, step, lambda a: a["best"])

    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.get(F.transform(F.array(codes), over), F.lit(0))  # so that the codes are made once


def secret_kind(hit: Column) -> Column:
    """The place in KINDS of a candidate that its entropy gives away; null for all others."""
    is_hex = hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & hit.rlike("[0-9]") & hit.rlike("[A-Fa-f]")
    classes = sum((F.when(hit.rlike(c), 1).otherwise(0) for c in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    named = F.forall(F.split(hit, JOINTS), lambda part: part.rlike(PART))
    likely = F.when(hit.rlike(ALLOWED) | named, None).when(is_hex, F.when(most_entropy(hit) >= HEX_BITS, 2)).when((classes >= 2) & hit.rlike("[0-9]"), F.when(most_entropy(hit) >= MIXED_BITS, 3))
    return likely.cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_found: a row for each row of docs.

    The counts and the hash are of base spans alone; spans has what the entropy adds, too. A found span never meets
    a base span. A null text is an empty one, and has the hash of the empty list. Equal rows are judged alike; other
    columns are not looked at. A hit is a whole run, however long.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    long_enough = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN_VALUE, 1)) >= 6
    rows = docs.select(
        "doc_id",
        F.filter(where_any(text, "(?i:passw|secret|token|api_?key)", spans(text, ASSIGN)), long_enough).alias("assign"),
        F.filter(where_any(text, "AKIA[A-Z0-9]{16}", spans(text, ACCESS)), lambda s: F.length(s["hit"]) >= 20).alias("access"),
        F.filter(where_any(text, "[0-9a-f]{24}", spans(text, HEX + "(?<=[0-9a-f]{24})")), lambda s: F.length(s["hit"]) >= 24).alias("hex"),
        where_any(text, r"[A-Za-z0-9+/_=.-]{20}", spans(text, CANDIDATE)).alias("candidates"),
    )
    base = F.concat(labelled(F.col("assign"), 0), labelled(F.col("access"), 1), labelled(F.col("hex"), 2))
    rows = rows.withColumn("base", base)
    free = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    judged = F.transform(F.filter("candidates", free), lambda s: F.struct(s["start"].alias("start"), secret_kind(s["hit"]).alias("kind"), s["end"].alias("end")))
    rows = rows.withColumn("found", F.filter(judged, lambda s: s["kind"].isNotNull()))
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "found"), KINDS).alias("spans"), size("found").alias("n_found"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
