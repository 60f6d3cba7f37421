"""Splitting oversized texts at natural boundaries by packing a structure tree.

A text is parsed once into a tree of spans that tile it: headed sections by level (lines in code fences are no headings),
blocks of markup, paragraphs, list items, lines, sentences, runs of non-blank characters. Neighbouring subtrees are merged
bottom-up while they fit the limit; only a node that alone exceeds the limit is descended into, so a cut falls at the highest
boundary that serves. Each piece after the first then reaches back into its predecessor by the overlap, to a blank or
better. An unbroken run longer than the limit is cut hard.

Defined results: null or empty text gives no piece; a text within the limit is one piece; an unknown source (no limit)
gives one piece of the whole text; an overlap of half the limit or more is held to just under half, and the pieces say so
(overlap_held); sizes are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprigwork.session import small, spread
from sprigwork.tables import load

_HEADING = re.compile(r"^(#{1,6})[ \t]+\S.*$", re.M)
_FENCE = re.compile(r"^[ ]{0,3}(?:```|~~~).*$", re.M)
_MARKUP = re.compile(r"<(?:section|article|div|h[1-6]|p|ul|ol|li|table|tr|blockquote|pre)\b[^<>]*>", re.I)
_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\(?\d{1,3}[.)])[ \t]+(?=\S)", re.M)
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")
_LINE = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"[.!?][\"')\]»”]*[ \t\r\n]+(?=[\"'(\[«„“]?[^\s\W])")
_BLANK = re.compile(r"[ \t\r\n]+")
#: Levels of the tree below the whole text, from the coarsest boundary to the finest.
LEVELS = ("h1", "h2", "h3", "h4", "h5", "h6", "markup", "paragraph", "item", "line", "sentence", "word")

Span = tuple[int, int]


class Tree:
    """The boundaries of a text by level: those down to lines from one parse, finer ones inside the spans that need them."""

    def __init__(self, text: str) -> None:
        self.text = text
        fences = [m.start() for m in _FENCE.finditer(text)]
        outside = lambda at: bisect_right(fences, at) % 2 == 0
        heads = [(m.start(), len(m[1])) for m in _HEADING.finditer(text) if outside(m.start())]
        self.cuts = {f"h{depth}": [at for at, d in heads if d == depth] for depth in range(1, 7)}
        self.cuts["markup"] = [m.start() for m in _MARKUP.finditer(text)]
        self.cuts["paragraph"] = [m.end() for m in _PARAGRAPH.finditer(text)]
        self.cuts["item"] = [m.start() for m in _ITEM.finditer(text) if outside(m.start())]
        self.cuts["line"] = [m.end() for m in _LINE.finditer(text)]

    def children(self, span: Span, level: str) -> list[Span]:
        """The spans that tile a span at a level; one span where the level has no boundary in it."""
        start, end = span
        if level in self.cuts:
            own = self.cuts[level]
            cuts = own[bisect_right(own, start) : bisect_left(own, end)]
        else:
            pattern = _SENTENCE if level == "sentence" else _BLANK
            cuts = [m.end() for m in pattern.finditer(self.text, start, end) if start < m.end() < end]
        edges = [start, *cuts, end]
        return list(zip(edges, edges[1:]))


def _blank_cut(span: Span, limit: int) -> list[Span]:
    """Cuts of the limit's length: of an unbroken run that is too long, or of blanks."""
    start, end = span
    out = []
    while end - start > limit:
        out.append((start, start + limit))
        start += limit
    return [*out, (start, end)]


def pack(tree: Tree, span: Span, depth: int, budget: int, limit: int, hard: set[int]) -> list[Span]:
    """Spans within the budget that tile a span: siblings merged in order, oversized ones descended into.

    hard: gets the ends of spans inside an unbroken run.
    """
    if span[1] - span[0] <= budget:
        return [span]
    text = tree.text
    if depth == len(LEVELS):
        run = _BLANK.search(text, *span)
        solid = (run.start() if run else span[1]) - span[0]
        if budget < solid <= limit:  # an unbroken run that fits without overlap stays whole
            rest = (span[0] + solid, span[1])
            return [(span[0], rest[0]), *(_blank_cut(rest, budget) if rest[0] < rest[1] else [])]
        out = _blank_cut(span, budget)
        hard.update(end for _, end in out if end < span[0] + solid)
        return out
    out = []
    open_end = False  # the last span may still take a sibling
    for child in tree.children(span, LEVELS[depth]):
        if open_end and child[1] - out[-1][0] <= budget:
            out[-1] = (out[-1][0], child[1])
        else:
            parts = pack(tree, child, depth + 1, budget, limit, hard)
            if open_end and parts[0][1] - out[-1][0] <= budget and len(parts) > 1:
                out[-1] = (out[-1][0], parts[0][1])
                parts = parts[1:]
            out += parts
        open_end = True
    return out


def longest_run(text: str) -> int:
    """Length of the longest stretch without space, tab or line end."""
    return max((len(x) for x in _BLANK.split(text)), default=0)


def held_overlap(limit: int, overlap: int | None) -> int:
    """The overlap that is used: what is asked for, but less than half the limit."""
    return max(0, min(overlap or 0, (limit - 1) // 2))


def split(text: str, limit: int | None, overlap: int = 0) -> list[tuple[int, int, int, bool]]:
    """Pieces of a text as (start, core start, end, ends in a hard cut); the cores tile the text."""
    if not text:
        return []
    size = len(text)
    if limit is None or limit <= 0 or size <= limit:
        return [(0, 0, size, False)]
    overlap = held_overlap(limit, overlap)
    ends: set[int] = set()
    cores = pack(Tree(text), (0, size), 0, limit - overlap, limit, ends)
    out = []
    for k, (start, end) in enumerate(cores):
        back = start
        room = min(overlap, limit - (end - start))
        if k and room > 0:
            low = max(0, start - room)
            # The overlap begins behind a blank if there is one in its first half, else exactly at the wanted length.
            blank = _BLANK.search(text, low, max(low + 1, low + room // 2))
            back = low if low == 0 or text[low - 1] in " \t\r\n" else (blank.end() if blank and blank.end() < start else low)
        out.append((back, start, end, end in ends))
    return out


_DDL = "fulltext_key bigint, piece int, core_start int, start int, end int, hard boolean, overlap_held boolean, piece_text string"
_SCHEMA = pa.schema([("fulltext_key", pa.int64()), ("piece", pa.int32()), ("core_start", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hard", pa.bool_()), ("overlap_held", pa.bool_()), ("piece_text", pa.string())])
#: Characters of pieces that one output batch holds before it is handed on.
BATCH_CHARS = 4_000_000


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    chars = 0

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    for batch in batches:
        for key, text, limit, overlap in zip(*(batch.column(i) for i in range(4))):
            text, limit, overlap = text.as_py(), limit.as_py(), overlap.as_py() or 0
            held = bool(limit and limit > 0 and overlap > held_overlap(limit, overlap))
            for n, (start, core, end, hard) in enumerate(split(text, limit, overlap)):
                rows.append((key.as_py(), n, core, start, end, hard, held, text[start:end]))
                chars += end - start
            if chars > BATCH_CHARS:
                yield give()
                rows, chars = [], 0
    if rows:
        yield give()


def pieces(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """texts(fulltext_key, source, text), limits(source, max_chars, overlap_chars: one row a source) -> pieces."""
    known = limits.groupBy("source").agg(F.max("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    joined = spread(texts.select(F.col("fulltext_key").cast("bigint").alias("fulltext_key"), "source", F.col("text").cast("string").alias("text"))).join(small(known), "source", "left")
    return joined.select("fulltext_key", "text", F.col("max_chars").cast("int"), F.col("overlap_chars").cast("int")).mapInArrow(_split, _DDL)


def all_pieces(spark, sf_dir: str) -> DataFrame:
    return pieces(load(spark, sf_dir, "fulltext"), load(spark, sf_dir, "chunk_limits"))


def found(spark, sf_dir: str) -> DataFrame:
    """The texts that had to be cut, and whether at an unbroken run."""
    by_text = all_pieces(spark, sf_dir).groupBy("fulltext_key").agg(F.count("*").alias("n"), F.max("hard").alias("hard"))
    return by_text.where("n > 1").select("fulltext_key", F.when(F.col("hard"), "hard").otherwise("soft").alias("cut"))


def rejoined(spark, sf_dir: str) -> DataFrame:
    """Of each text the characters and checksum of its pieces' cores put together, and whether every piece is within the limit."""
    limits = load(spark, sf_dir, "chunk_limits").groupBy("source").agg(F.max("max_chars").alias("max_chars"))
    source = load(spark, sf_dir, "fulltext").select(F.col("fulltext_key").cast("bigint").alias("fulltext_key"), "source")
    core = F.expr("substring(piece_text, core_start - start + 1, end - core_start)")
    # One text's pieces come together again: no more than the text that one row held before.
    whole = all_pieces(spark, sf_dir).groupBy("fulltext_key").agg(F.sort_array(F.collect_list(F.struct("piece", core.alias("core")))).alias("p"), F.max(F.length("piece_text")).alias("longest"))
    text = F.array_join(F.transform("p", lambda x: x["core"]), "")
    joined = whole.join(source, "fulltext_key").join(small(limits), "source", "left")
    return joined.select("fulltext_key", F.length(text).alias("n_chars"), F.md5(text).alias("checksum"), F.coalesce(F.col("longest") <= F.col("max_chars"), F.lit(True)).alias("within"))
