"""Text functions as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
ALNUM_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
# Fixed ranges: kana, CJK, Hangul; about a token a character.
DENSE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"
MAX_ENTITY_CHARS, MAX_ENTITY_WORDS = 64, 6


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def opening(text: Column, n: int) -> Column:
    """The first n words, joined by blanks; what comes after them is not read."""
    first = F.regexp_extract(text, rf"^[\x20\x09-\x0D]*({WORD}(?:[\x20\x09-\x0D]+{WORD}){{0,{n - 1}}})", 1)
    return F.regexp_replace(first, r"[\x20\x09-\x0D]+", " ")


def collapsed(name: Column) -> Column:
    """White space to single blanks, lower case: how names are stored."""
    return F.lower(F.array_join(words(name), " "))


def normalised_entity(name: Column) -> Column:
    """The resolution key: collapsed, without punctuation at its ends and without a possessive."""
    return F.regexp_replace(F.regexp_replace(collapsed(name), ALNUM_EDGES, ""), "('s|')$", "")


def is_plausible_entity(name: Column) -> Column:
    n = F.trim(name)
    return (n != "") & n.rlike(r"\p{L}") & ~n.rlike("[,;]") & (F.length(n) <= MAX_ENTITY_CHARS) & (F.size(words(n)) <= MAX_ENTITY_WORDS)


def relation_slug(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two blanks before and one after."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of trigrams; 0 if neither has any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def quick_rank(title: Column, q: str) -> Column:
    """1 for the title itself, 0.9 for a beginning, else 0.8 of the similarity; null if the title is no candidate."""
    q = q.lower()

    def ranked(low: Column) -> Column:
        near = F.get(F.transform(F.array(similarity(low, F.lit(q))), lambda x: F.when((x >= 0.3) | F.contains(low, F.lit(q)), x * 0.8)), F.lit(0))
        return F.when(low == q, F.lit(1.0)).when(low.startswith(q), F.lit(0.9)).otherwise(near)

    # the title is made once, however often the rank reads it
    return F.get(F.transform(F.array(F.lower(title)), ranked), F.lit(0))


def estimated_tokens(text: Column) -> Column:
    """1.3 a word and 1 a dense character, a quarter of all characters at least, rounded up."""
    dense = F.regexp_count(text, F.lit(DENSE))
    sparse = F.size(words(F.regexp_replace(text, DENSE, "")))
    return F.ceil(F.greatest(sparse.cast("float") * F.lit(1.3).cast("float") + dense.cast("float"), F.length(text).cast("float") / F.lit(4.0).cast("float"))).cast("int")


def relevance(question: str, summary: Column) -> Column:
    """The share of the question's words of more than two bytes that are somewhere in the summary; 0 without such words."""
    import re

    terms = [w for w in re.split(r"[^\w]|_", question.lower()) if len(w.encode()) > 2]
    if not terms:
        return F.lit(0.0)
    low = F.lower(summary)
    return sum((F.contains(low, F.lit(t)).cast("double") for t in terms), F.lit(0.0)) / len(terms)


def substituted(pattern: Column, values: Mapping[str, Column]) -> Column:
    """{{ key }} by value in one pass; unknown keys stay, and so does an opening that is never closed."""
    parts = F.split(pattern, r"\{\{")
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values())) if values else F.create_map().cast("map<string,string>")

    def filled(part: Column) -> Column:
        end = F.instr(part, "}}")
        key = F.trim(F.substr(part, F.lit(1), F.greatest(end - 1, F.lit(0))))
        value = known[key]
        return F.when((end > 0) & value.isNotNull(), F.concat(value, F.substr(part, end + 2))).otherwise(F.concat(F.lit("{{"), part))

    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), filled)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def hop_note(hops: Column) -> Column:
    return F.when(hops == 0, "found directly by search").when(hops == 1, "1 hop from a subject of the question").otherwise(F.concat(hops.cast("string"), F.lit(" hops from a subject of the question")))


def relative_time(then: Column, now: Column) -> Column:
    """A month has 30 days and a year 365; what lies ahead is just now, and null is unknown."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    out = F.lit("just now")
    for size, name, least in ((60, "minute", 60), (3600, "hour", 3600), (86400, "day", 86400), (604800, "week", 604800), (2592000, "month", 2592000), (31536000, "year", 31536000)):
        n = F.floor(s / size)
        out = F.when(s >= least, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))).otherwise(out)
    return F.when(then.isNull(), "unknown").otherwise(out)


def block_hash(kind: Column, text: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit("\x1f"), text), 256)


def member_set_hash(members: Column) -> Column:
    """Of a collected set of ids, as strings in order, each ended by a unit separator."""
    return F.sha2(F.concat(F.array_join(F.array_sort(members.cast("array<string>")), "\x1f"), F.lit("\x1f")), 256)


def format_count(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)
