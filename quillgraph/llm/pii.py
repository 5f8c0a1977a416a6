"""Personal data: base patterns, and looser candidates that boosted trees judge by format and context.

Generators propose overlapping spans. The trees learn what personal data looks like in forms that the base patterns
miss: each base span of a bounded sample of documents is rewritten in such a form (DISGUISES) within its own context, and
candidates that are just that span are the positive labels. Negative ones are candidates of the texts as they stand that
meet no base span, candidates of another kind in the rewritten ones, and the sign of an address alone between words. Half of the documents fit the trees, the
other half the thresholds: the lowest score at which PRECISION of its candidates at or above it are positive.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import boost
from quillgraph.llm.common import settle, table
from quillgraph.llm.spans import joined, labelled, spans, where_any

#: Kinds in the order of the result.
KINDS = ["email", "ip", "card", "phone"]
# The base patterns. Possessive where nothing that follows could need a shorter match; \G or what is not
# a character of the first run begins a match, since a run that fails from its start fails from within, too.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What is proposed besides, by kind; these may overlap, and base spans may overlap them.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    r"(?<![0-9.])[0-9]++(?:(?:\.|\x20?[(\[](?:\.|dot)[)\]]\x20?)[0-9]++){2,}+",
    r"(?<![0-9])[0-9](?:[\x20.-]{0,2}[0-9]){9,}+",
    r"(?<![0-9+])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
)
HINTS = (r"@|[(\[]at[)\]]", r"[0-9](?:\.|\x20?[(\[](?:\.|dot)[)\]])\x20?[0-9]", r"[0-9](?:[\x20.-]{0,2}[0-9]){9}", r"[0-9](?:[\x20().-]{0,2}[0-9]){6}")
#: What stands for the sign of an address in some of them.
SIGNS = ("@", "(at)", "[at]")
CONTEXT = 24
#: Candidates a kind and documents that the trees are fitted on.
SAMPLE, DOCS = 20_000, 20_000
PRECISION = 0.995
FEATURES = ("length", "digits", "digit_share", "parts", "longest_part", "part_most", "checksum", "plus", "brackets", "dashes", "dots", "at", "letter_before", "letter_after", "digit_near", "cue")
CUES = (r"(?i)mail|contact|schreib|courriel|correo", r"(?i)\b(?:ip|host|server|addr)", r"(?i)card|visa|karte|carte|tarjeta|credit", r"(?i)tel|phone|call|fax|mobil|\bnum")


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digits of a card number, all of them, add up: every second from the right doubled, less 9 above 9."""
    d = F.transform(F.split(F.reverse(number), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def parts_fit(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(256)) <= 255)


def confirmed(kind: int, hit: Column) -> Column:
    n = F.length(digits(hit))
    return (F.lit(True), parts_fit(hit), n.between(12, 19) & luhn(digits(hit)), n.between(9, 15))[kind]


def found_base(text: Column) -> list[Column]:
    """By kind, the spans of the base patterns that pass their checks."""
    hints = ("@", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}", r"\+[0-9]")
    return [F.filter(where_any(text, hint, spans(text, p)), partial(lambda k, s: confirmed(k, s["hit"]), k)) for k, (hint, p) in enumerate(zip(hints, (EMAIL, IP, CARD, PHONE), strict=True))]


def proposed(text: Column, kind: int) -> Column:
    """Candidates of a kind with their features, none of which looks past CONTEXT characters on either side."""
    found = where_any(text, HINTS[kind], spans(text, LOOSE[kind]))

    def described(s: Column) -> Column:
        hit, number = s["hit"], digits(s["hit"])
        before = F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
        after = F.substr(text, s["end"] + 1, F.lit(CONTEXT))
        groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
        double = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
        count = lambda what: double(F.regexp_count(hit, F.lit(what)))
        x = {
            "length": double(F.length(hit)), "digits": double(F.length(number)), "digit_share": F.length(number) / F.length(hit), "parts": double(F.size(groups)),
            "longest_part": double(F.array_max(F.transform(groups, lambda g: F.length(g)))), "part_most": F.least(double(F.array_max(F.transform(groups, lambda g: g.try_cast("double")))), F.lit(1e20)),
            "checksum": double(luhn(number).cast("int")), "plus": double(hit.startswith("+").cast("int")), "brackets": count(r"[()\[\]]"), "dashes": count("-"), "dots": count(r"\."), "at": count("@"),
            "letter_before": double(before.rlike(r"\p{L}$").cast("int")), "letter_after": double(after.rlike(r"^\p{L}").cast("int")),
            "digit_near": double((before.rlike("[0-9][^0-9]{0,2}$") | after.rlike("^[^0-9]{0,2}[0-9]")).cast("int")), "cue": double(before.rlike(CUES[kind]).cast("int")),
        }
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[x[f].alias(f) for f in FEATURES])

    return F.transform(found, described)


def disguised(kind: int, hit: Column) -> list[Column]:
    """DISGUISES: forms in which people write the same datum and which no base pattern matches."""
    number = digits(hit)
    if kind == 0:
        user, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
        return [F.concat(user, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))), F.concat(user, F.lit("[at]"), F.replace(host, F.lit("."), F.lit("[dot]"))), F.concat(user, F.lit(" @ "), host)]
    if kind == 1:
        return [F.replace(hit, F.lit("."), F.lit(dot)) for dot in ("[.]", "[dot]", " (dot) ")]
    if kind == 2:
        return [F.regexp_replace(number, "(.{4})(?=.)", f"$1{gap}") for gap in (".", ". ", "- ")]
    last = F.substr(number, F.greatest(F.length(number) - 9, F.lit(1)))
    return [F.substr(hit, F.lit(2)), F.regexp_replace(last, "^(.{3})(.{3})", "$1-$2-"), F.regexp_replace(last, "^(.{3})(.{3})", "($1) $2 ")]


def examples(docs: DataFrame, number: int = DOCS) -> DataFrame:
    """kind, h (hash of the document), y (1 or 0) and FEATURES of each labelled candidate of about number documents, by hash."""
    h = F.xxhash64("doc_id", "text")
    share = min(1.0, number / max(1, docs.count()))
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = docs.where(F.pmod(h, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(h.alias("h"), text.alias("text"))
    base = F.concat(*[F.transform(b, partial(lambda k, s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")), k)) for k, b in enumerate(found_base(F.col("text")))])
    drawn = drawn.withColumn("base", base)
    tag = lambda k: F.transform(proposed(F.col("text"), k), lambda s: F.struct(F.lit(k).alias("kind"), s.alias("s")))
    every = F.concat(*[tag(k) for k in range(len(KINDS))])
    meets = F.exists("base", lambda b: (b["start"] < F.col("c.s.end")) & (F.col("c.s.start") < b["end"]))
    features = [F.col(f"c.s.{f}").alias(f) for f in FEATURES]
    plain = drawn.select("h", "base", F.explode(every).alias("c")).where(~meets).select("c.kind", "h", F.lit(0.0).alias("y"), *features)

    spans_ = drawn.select("h", "text", F.explode("base").alias("b"))
    before = F.substr("text", F.greatest(F.col("b.start") - CONTEXT + 1, F.lit(1)), F.least(F.col("b.start"), F.lit(CONTEXT)))
    after = F.substr("text", F.col("b.end") + 1, F.lit(CONTEXT))
    pick = F.pmod(F.xxhash64("h", "b.start"), F.lit(3)).cast("int")
    form = F.lit("")
    for k in range(len(KINDS)):
        form = F.when(F.col("b.kind") == k, F.get(F.array(*disguised(k, F.col("b.hit"))), pick)).otherwise(form)
    spans_ = spans_.select("h", F.col("b.kind").alias("true"), before.alias("before"), form.alias("form"), after.alias("after"), F.get(F.array(*map(F.lit, SIGNS)), pick).alias("sign"))
    # once with the datum and, where it is an address, once with no more than its sign between its neighbours
    put = F.explode(F.when(F.col("true") == 0, F.array(F.col("form"), F.col("sign"))).otherwise(F.array(F.col("form")))).alias("put")
    spans_ = spans_.select("h", "true", F.length("before").alias("first"), "before", "after", put)
    spans_ = spans_.select("h", "true", (~F.col("put").isin(*SIGNS)).alias("whole"), "first", (F.col("first") + F.length("put")).alias("last"), F.concat("before", "put", "after").alias("text"))
    near = (F.col("c.s.start") < F.col("last")) & (F.col("first") < F.col("c.s.end"))
    same = F.col("whole") & (F.col("c.s.start") == F.col("first")) & (F.col("c.s.end") == F.col("last")) & (F.col("c.kind") == F.col("true"))
    other = near & (~F.col("whole") | (F.col("c.kind") != F.col("true")))
    hidden = spans_.select("h", "true", "whole", "first", "last", F.explode(every).alias("c")).where(same | other).select("c.kind", "h", same.cast("double").alias("y"), *features)
    return plain.unionByName(hidden)


def fit(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION, number: int = DOCS) -> list[tuple[boost.Boosted, float]]:
    """By kind, the trees and the least score of a redaction; infinite without positive candidates in either half."""
    c = settle(examples(docs, number))
    models = []
    for k in range(len(KINDS)):
        order = F.xxhash64("h", *FEATURES)
        rows = c.where(F.col("kind") == k).orderBy(order, "y", *FEATURES).limit(sample).collect()
        data = np.array([tuple(r)[2:] for r in rows], dtype=float).reshape(-1, len(FEATURES) + 1)
        held = np.array([r["h"] % 2 for r in rows], dtype=bool)
        x, y = data[:, 1:], data[:, 0]
        model = boost.fit(FEATURES, x[~held], y[~held], trees=12)
        models.append((model, boost.threshold_for(model.margin(x[held]), y[held], precision) if y[held].any() and model.trees else float("inf")))
    return models


def detect(docs: DataFrame, models: list[tuple[boost.Boosted, float]] | None = None) -> DataFrame:
    """row (docs' columns as a struct), base and spans, all of them, as arrays of (start, kind, end), kind by place in KINDS.

    A span that the trees add meets no base span, nor another added one that starts before it or is of an earlier
    kind. A null text is an empty one. With no candidate, or none confirmed, nothing is added.
    """
    models = fit(docs) if models is None else models
    used = [k for k, (_, least) in enumerate(models) if least != float("inf")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = row.select("row", F.concat(*[labelled(b, k) for k, b in enumerate(found_base(text))]).alias("base"), *[proposed(text, k).alias(f"loose{k}") for k in used])
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = []
    for k in used:
        sure = partial(lambda m, least, s: m.column({f: s[f] for f in FEATURES}) >= F.lit(least), *models[k])
        added.append(F.transform(F.filter(F.filter(f"loose{k}", free), sure), partial(lambda k, s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")), k)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    more = F.array_sort(F.concat(none, *added))
    # sorted by their starts, so only the last one taken can meet the next
    taken = F.aggregate(
        more, F.struct(F.lit(0).alias("end"), none.alias("spans")),
        lambda a, s: F.when(s["start"] < a["end"], a).otherwise(F.struct(s["end"].alias("end"), F.array_append(a["spans"], s).alias("spans"))),
    )
    apart = taken["spans"]
    return rows.select("row", "base", F.array_sort(F.concat(F.col("base"), apart)).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, a count of base spans by kind, base_sha256, spans, n_added."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "row.doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets; overlapping spans by that of the first.

    All columns stay, in their order; n_chars, if there, is the new length. A null text stays null.
    """
    found = detect(docs)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    name = lambda k: F.get(F.array(*[F.lit(f"<{n.upper()}>") for n in KINDS]), k)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.substr(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], between, name(s["kind"])).alias("out")))

    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.size("spans") > 0, clean).otherwise(F.col("row.text"))
    new = {"text": clean, "n_chars": F.coalesce(F.length(clean).cast("long"), F.lit(0).cast("long"))}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(detect(table(spark, sf_dir, "documents")))
