"""English full-text search: Porter2 stems, a document's lexemes with places, matching and cover density."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the usual list.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those
    am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to
    from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Fixed values of the Porter2 algorithm.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
ENDS1, ENDS2 = frozenset(("eed", "eedly", "ed", "edly", "ing", "ingly")), frozenset((*STEP2, "ogi", "li"))
ENDS3, ENDS4 = frozenset((*STEP3, "ative")), frozenset((*STEP4, "ion"))
VOWELS = "aeiouy"
#: The last letters of all endings that a step looks for; a word that ends in another is its own stem.
LAST = frozenset("cdegilmnrsty'")


def region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def ends_short(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def longest(word: str, endings: frozenset[str]) -> str:
    for n in range(min(len(word), 7), 0, -1):
        if word[-n:] in endings:
            return word[-n:]
    return ""


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    if word[-1].lower() not in LAST and word[0] != "'":
        return word.lower()
    w = word.removeprefix("'")
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = region(w, 0) if r1 is None else r1
    r2 = region(w, r1)
    w = w.removesuffix("'s'") if w.endswith("'s'") else w.removesuffix("'s") if w.endswith("'s") else w.removesuffix("'")
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in KEPT_1A:
        return w.lower()
    e = longest(w, ENDS1)
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and any(c in VOWELS for c in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif ends_short(w) and len(w) <= r1:
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    e = longest(w, ENDS2)
    if e and len(w) - len(e) >= r1:
        if e in STEP2:
            w = w[: -len(e)] + STEP2[e]
        elif e == "ogi" and w[-4:-3] == "l" or e == "li" and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[: -1 if e == "ogi" else -2]
    e = longest(w, ENDS3)
    if e and len(w) - len(e) >= r1:
        if e != "ative":
            w = w[: -len(e)] + STEP3[e]
        elif len(w) - len(e) >= r2:
            w = w[:-5]
    e = longest(w, ENDS4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not ends_short(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexemes(text: str | None) -> list[tuple[str, int]]:
    """Stems with the places of their words, counted over all words, without stop words."""
    found = re.findall(r"[^\W_]+(?:'[^\W_]+)?", (text or "").lower())
    return [(stem(w), i) for i, w in enumerate(found, 1) if w not in STOP]


def cover_density(text: str | None, query: list[str]) -> float | None:
    """Null without all lexemes of the query; else the sum over the shortest spans with all of them of 1 over the words in between."""
    wanted = set(query)
    places = [(w, i) for w, i in lexemes(text) if w in wanted]
    if not wanted or len({w for w, _ in places}) < len(wanted):
        return None
    total, inside = 0.0, {}
    for w, i in places:
        inside[w] = i
        if len(inside) == len(wanted):
            start = min(inside.values())
            total += len(wanted) / (1 + (i - start + 1 - len(wanted)))
            inside = {x: p for x, p in inside.items() if p > start}
    return total


def rank(text: Column, query: str) -> Column:
    """Cover density of a query's lexemes; null where it doesn't match, and everywhere for stop words alone."""
    wanted = sorted({w for w, _ in lexemes(query)})

    @F.pandas_udf("double")
    def ranked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([cover_density(t, wanted) for t in b], dtype="float64")

    return ranked(text)
