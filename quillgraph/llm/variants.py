"""Spelling variants: words at distance one, found by a trie joined with itself, and the forms they are variants of.

The vocabulary is dealt into cells of words with a common beginning (or end): two words at distance one share the first
half of the shorter or its last half. A task makes a trie of what a cell's words have besides and walks it with active
nodes: those within distance one of the node at hand, each found from the active nodes of its parent. Where both are
ends of words, a pair comes out. Cells of more than MOST words are halved again, beginning and end, until a cell is small or
one letter is left of its words, which an alphabet bounds; so no cell is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import ascii_lower, sent_if_small, settle, table

#: Letters of words.
LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST, LEAST, TIMES = 7, 2, 10
#: One run in so many loses a letter.
ONE_IN = 31
#: Words of a cell that one task takes together.
MOST = 4_000


def runs(text: Column, shortest: int) -> Column:
    """Maximal runs of at least so many letters."""
    return F.regexp_extract_all(text, F.lit(f"({LETTERS}{{{shortest},}})"), F.lit(1))


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """(word, n): lower-cased runs of letters, of which those whose crc32 with the id divides by one_in lose a letter.

    Null texts have no words; a null id counts as an empty one. Runs are counted where they are before any is sent.
    """
    run = docs.select("doc_id", F.explode(runs(F.col("text"), shortest)).alias("run")).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    size = F.length("run")
    run = run.select("run", size.alias("size"), h.alias("h"), (h % size).cast("int").alias("at"))
    less = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2, size)"))
    word = run.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def members(words: DataFrame) -> DataFrame:
    """(word, short, head, tail): the whole vocabulary as one cell for each length; words of that length and the next are in it.

    head and tail are how many letters at either end all words of a cell share.
    """
    lengths = F.array(F.length("word"), F.length("word") - 1)
    return words.select("word", F.explode(lengths).alias("short"), F.lit(0).alias("head"), F.lit(0).alias("tail"))


def halved(cells: DataFrame) -> DataFrame:
    """Each cell as two: its words by one half more of what they have between head and tail at the beginning, or at the end.

    Of a word at distance one either half is the same: the first up to the edit, or the last from there on.
    """
    rest = F.col("short") - F.col("head") - F.col("tail")
    half = F.floor(rest / 2).cast("int")
    parts = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + rest - half).alias("tail")))
    return cells.select("word", "short", F.explode(parts).alias("p")).select("word", "short", "p.head", "p.tail")


def named(cells: DataFrame) -> DataFrame:
    """cells with their key: all that a cell's words have in common, and where."""
    ends = F.concat(F.expr("substring(word, 1, head)"), F.lit("\n"), F.expr("substring(word, length(word) - tail + 1, tail)"))
    return cells.withColumn("cell", F.concat_ws("\n", "short", "head", "tail", ends))


class Trie:
    """Of sorted strings: nodes by number, with children by letter and the string that ends there."""

    def __init__(self, strings: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, s in enumerate(strings):
            node = 0
            for letter in s:
                below = self.children[node].get(letter)
                if below is None:
                    below = self.children[node][letter] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                node = below
            self.ends[node] = i

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Strings at distance one, each pair once, the later string first.

        active holds, of the node at hand, the other nodes within distance one, with their distance. A child's come
        from its parent's: an active node as it is (the child's letter is one too many), its children by the same letter
        (no more distance) or by another (one letter for another), and then theirs, each a letter more.
        """
        children, ends = self.children, self.ends
        stack: list[tuple[int, dict[int, int]]] = [(0, {0: 0} | {below: 1 for below in children[0].values()})]
        while stack:
            node, active = stack.pop()
            own = ends[node]
            if own >= 0:
                for other, distance in active.items():
                    if distance == 1 and 0 <= ends[other] < own:
                        yield own, ends[other]
            for letter, child in children[node].items():
                near: dict[int, int] = {}
                for other, distance in active.items():
                    if distance == 0:
                        near.setdefault(other, 1)
                        for at, below in children[other].items():
                            if at == letter:
                                near[below] = 0
                                for more in children[below].values():
                                    near.setdefault(more, 1)
                            else:
                                near.setdefault(below, 1)
                    else:
                        below = children[other].get(letter)
                        if below is not None:
                            near.setdefault(below, 1)
                stack.append((child, near))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near) of rows (words, short, head, tail), a cell each. Pairs that another cell has, too, come from one of them."""
    for b in batches:
        left, right = [], []
        for words, short, head, tail in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cut = sorted(words)
            rest = [w[head : len(w) - tail] for w in cut]
            order = sorted(range(len(rest)), key=rest.__getitem__)
            for i, j in Trie([rest[k] for k in order]).pairs():
                a, c = cut[order[i]], cut[order[j]]
                if min(len(a), len(c)) == short and first_cell(a, c, short, head, tail):
                    left += (a, c)
                    right += (c, a)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["word", "near"])


def first_cell(a: str, b: str, short: int, head: int, tail: int) -> bool:
    """Whether the cell of that head and tail is the one to name the pair: a pair that both halves of a cell have is the first's.

    Goes down the halves from the whole; at each the first is taken if the pair is in it.
    """
    at, end = 0, 0
    while (at, end) != (head, tail):
        rest = short - at - end
        half = rest // 2
        if rest <= 1:
            return False
        if a[: at + half] == b[: at + half]:
            at += half
        else:
            end += rest - half
        if at > head or end > tail:
            return False
    return True


def pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near), both ways: pairs of different words of (word, ...) at distance one. words has each word once."""
    cells, found = halved(members(words.select("word"))), None
    while True:
        cells = settle(named(cells))
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
        large = settle(sizes.where(F.col("size") > most).select("cell"))
        # one letter is left: as many words as the alphabet and its square have at most, and no half to go on with
        last = F.col("short") - F.col("head") - F.col("tail") <= 1
        all_small = large.isEmpty()
        small = cells if all_small else cells.where(last).unionByName(cells.where(~last).join(sent_if_small(large), "cell", "left_anti"))
        lists = small.groupBy("cell", "short", "head", "tail").agg(F.collect_list("word").alias("words"))
        lists = lists.where((F.size("words") > 1) & F.exists("words", lambda w: F.length(w) == F.col("short")))
        got = settle(lists.select("words", "short", "head", "tail").mapInArrow(joined, "word string, near string"))
        found = got if found is None else found.unionByName(got)
        if all_small:
            return found
        cells = cells.where(~last).join(sent_if_small(large), "cell", "left_semi")
        if cells.isEmpty():
            return found
        cells = halved(cells.select("word", "short", "head", "tail"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where forms lead in the end. Forms only ever get more frequent, so none comes back.

    Each round looks as far again as the one before.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        at = settle(at)
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        at = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def grouped(words: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), each word once: every word has a row, those without near words, too.

    form is the near word of largest n, the first in the order of code points of equal ones, if its n is times the
    word's at least. An empty vocabulary has no rows.
    """
    words = settle(words.select("word", "n"))
    near = pairs(words, most).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * times
    out = settle(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    root = roots(out.where(F.col("form").isNotNull()))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))
