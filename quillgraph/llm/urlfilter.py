"""URL filters: host and path rules first, boosted trees on lexical features for what no rule covers.

The urls that a rule decides are the labelled ones. Suffix statistics count all of them; the trees are fitted on
SAMPLE of them at most, those with the smallest hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import boost
from quillgraph.llm.common import ascii_lower, table

#: (rule, verdict); a rule is a host, and the path's beginning from the first slash on.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SAMPLE = 20_000
FEATURES = ("length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "tld_blocked", "tld_seen", "site_blocked", "site_seen")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty if url is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: len(x[0])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(url), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    # an empty pattern splits off no empty strings, but an empty url is one
    entropy = F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    count = lambda col, what: F.regexp_count(col, F.lit(what)).cast("double")
    return {
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "labels": count(host, r"\."), "depth": count(path, "/"),
        "digit_ratio": count(url, "[0-9]") / n, "entropy": entropy, "parameters": count(url, "[?&][^?&#=]+="), "hyphens": count(host, "-"),
    }


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of being blocked), a row for each row of pages.

    A null url counts as an empty one: no host, no path, no rule, judged by the trees. With no labelled url, or
    labels of one kind, all others get the more frequent label (allow if there is none). An empty table gives an
    empty result. Other columns are not looked at.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, decided = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), decided.alias("decided"), F.regexp_extract("host", r"[^.]*$", 0).alias("tld"), F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0).alias("site"))
    for key in ("tld", "site"):
        # what every label says of this suffix, drawn towards an even chance
        known = rows.where(F.col("rule").isNotNull()).groupBy(key).agg(
            ((F.sum((F.col("decided") == "block").cast("double")) + 1) / (F.count(F.lit(1)) + 2)).alias(f"{key}_blocked"), F.log2(F.count(F.lit(1)) + 1).alias(f"{key}_seen"))
        rows = rows.join(known, key, "left").fillna({f"{key}_blocked": 0.5, f"{key}_seen": 0.0})
    rows = rows.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    labelled = rows.where(F.col("rule").isNotNull()).select(F.xxhash64("page_id", "url").alias("h"), (F.col("decided") == "block").cast("double").alias("y"), *FEATURES)
    got = [tuple(r)[1:] for r in labelled.orderBy("h", *FEATURES).limit(sample).collect()]
    data = np.array(got, dtype=float).reshape(-1, len(FEATURES) + 1)
    model = boost.fit(FEATURES, data[:, 1:], data[:, 0]) if len(data) else boost.Boosted(FEATURES, -1.0)
    margin = model.column({f: F.col(f) for f in FEATURES})
    out = rows.select("page_id", "host", "path", "rule", "decided", (1 / (1 + F.exp(-margin))).alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
