"""Blocks of HTML pages, chunks of blocks, and pluggable providers with deterministic stubs."""

from __future__ import annotations

import hashlib
import math
import re
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks have so many estimated tokens, but for a short end and what can't be split.
LEAST, MOST = 64, 512
A_WORD = np.float32(1.3)
DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")
SENTENCE = re.compile(r"[^.!?]*[.!?]|[^.!?]+")


def tokens_in(text: str) -> int:
    sparse, dense = DENSE.subn("", text)
    return math.ceil(max(np.float32(len(sparse.split())) * A_WORD + np.float32(dense), np.float32(len(text)) / np.float32(4)))


def pieces(sentence: str) -> list[str]:
    """A sentence that is too long alone: by words, or by characters if it is one word."""
    w = sentence.split()
    if len(w) > 1:
        step = int(MOST / 1.3)
        return [" ".join(w[i : i + step]) for i in range(0, len(w), step)]
    step = int(MOST * 0.9)
    return [sentence[i : i + step] for i in range(0, len(sentence), step)]


def split_long(text: str) -> Iterator[str]:
    held = ""
    for sentence in SENTENCE.findall(text):
        alone = tokens_in(sentence) > MOST
        if held.strip() and (alone or tokens_in(held + sentence) > MOST):
            yield held
            held = ""
        if alone:
            yield from pieces(sentence)
        else:
            held += sentence
    if held.strip():
        yield held


def chunks_of(blocks: Iterable[str]) -> list[str]:
    """Short blocks join the one that follows, long ones are split by sentences, a short end stays."""
    out: list[str] = []
    held = ""
    for block in blocks:
        if not (block := block.strip()):
            continue
        held = f"{held}\n{block}" if held else block
        n = tokens_in(held)
        if n >= LEAST:
            out += [p.strip() for p in split_long(held)] if n > MOST else [held]
            held = ""
    return [*out, held] if held else out


def _chunked(parts: DataFrame) -> DataFrame:
    """Of (page_id, parts), parts being the texts of a page's blocks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, c, tokens_in(c), hashlib.sha256(c.encode()).hexdigest()) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(chunks_of(t or []))]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "chunk_index", "text", "token_estimate", "hash"])

    return parts.select("page_id", "parts").mapInArrow(run, "page_id long, chunk_index int, text string, token_estimate int, hash string")


def chunked(pages: DataFrame) -> DataFrame:
    """page_id, chunk_index, text, token_estimate, hash of the lines of each page's text."""
    return _chunked(pages.select("page_id", F.split("text", "\n").alias("parts")))


def chunked_blocks(blocks: DataFrame) -> DataFrame:
    """The same of blocks (page_id, block_index, text). A page's blocks are brought together."""
    of_page = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_index", F.coalesce("text", F.lit("")).alias("text")))).alias("blocks"))
    return _chunked(of_page.select("page_id", F.transform("blocks", lambda x: x["text"]).alias("parts")))


class Blocks(HTMLParser):
    """One block for each element straight under the body; elements inside a block end lines, inline ones do not."""

    # Elements whose text runs on, and elements without content of their own.
    INLINE = frozenset("a abbr b br code em i img mark s small span strong sub sup u".split())
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    SKIPPED = frozenset("script style head template noscript".split())
    DEPTH = 64

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.lines: list[str] = []
        self.skip = 0

    def ended(self) -> None:
        text = "\n".join(x for line in self.lines if (x := " ".join(line.split())))
        if self.open and text:
            self.found.append((self.open[0], text))
        self.lines = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.SKIPPED:
            self.skip += 1
        if tag in self.VOID or tag in self.INLINE or tag in ("html", "body") or self.skip or len(self.open) >= self.DEPTH:
            return
        self.open.append(tag)
        self.lines.append("")

    def handle_endtag(self, tag) -> None:
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag not in self.open:
            return
        at = len(self.open) - 1 - self.open[::-1].index(tag)
        if at == 0:
            self.ended()
        del self.open[at:]
        self.lines.append("")

    def handle_data(self, data) -> None:
        if self.skip:
            return
        if not self.open:
            if text := " ".join(data.split()):
                self.found.append(("p", text))
            return
        if not self.lines:
            self.lines.append("")
        self.lines[-1] += data


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_index, kind, text, hash of (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parser = Blocks()
                parser.feed(html or "")
                parser.close()
                parser.ended()
                rows += [(p, i, k, t, hashlib.sha256(f"{k}\x1f{t}".encode()).hexdigest()) for i, (k, t) in enumerate(parser.found)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "block_index", "kind", "text", "hash"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, block_index int, kind string, text string, hash string")


class Embedder(ABC):
    """Vectors of a fixed length for texts."""

    model_id: str
    size: int

    @abstractmethod
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder(Embedder):
    """Deterministic and without meaning: signs by word hash, of unit length."""

    model_id, size = "hash-64", 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in t.lower().split():
                h = hashlib.md5(w.encode()).digest()
                v[h[0] % self.size] += 1 if h[1] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """hash, model_id, embedding; a batch that fails is tried text by text, and what fails alone is left pending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            try:
                got = list(zip(hashes, embedder.embed(texts), strict=True))
            except Exception:
                got = []
                for h, t in zip(hashes, texts, strict=True):
                    try:
                        got.append((h, embedder.embed([t])[0]))
                    except Exception:  # the provider's own errors are not known here; the text stays in the queue
                        continue
            got = [(h, v) for h, v in got if len(v) == embedder.size]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in got], pa.string()), pa.array([embedder.model_id] * len(got), pa.string()), pa.array([v for _, v in got], pa.list_(pa.float32()))], ["hash", "model_id", "embedding"])

    return chunks.select("hash", "text").mapInArrow(run, "hash string, model_id string, embedding array<float>")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """new over old: the last write of a key wins."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def deduplicated_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each content; the text is the same whichever row it is from."""
    return chunks.groupBy("hash").agg(F.first("text").alias("text"), F.first("token_estimate").alias("token_estimate"))
