"""Cutting oversized texts at natural boundaries with a fixed overlap.

Every position of a text has a boundary strength (paragraph, heading, line, list item, sentence, clause, word, inside a
word). Sparse tables answer "strongest cut in this window, rightmost on ties" in constant time, so a piece costs the
same however long the text is; they are made for blocks of the text, as the window reaches them, so that memory beside
the text is a byte a character. The next piece begins `overlap` characters before the cut.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import explode_texts
from tidemark.session import table

DEFAULT_SIZE, DEFAULT_OVERLAP = 900, 120
BLANKS = " \t\r\n"
# Strengths of a cut just after what the pattern matches, weakest first; later ones win.
_BOUNDARIES = (
    (1, re.compile(r"[ \t]+")),
    (2, re.compile(r"[,;:)\]}、，；：][ \t]*")),
    (3, re.compile(r"[.?!…][\"'”’»)\]]*[ \t]+|[。！？]")),
    (4, re.compile(r"[ \t]*(?:\r\n|\r|\n)")),
    (5, re.compile(r"[.?!:;。！？}][\"'”’»)\]]*[ \t]*(?:\r\n|\r|\n)|(?:\r\n|\r|\n)(?=[ \t]*(?:[-*+•]|\d+[.)])[ \t])")),
    (6, re.compile(r"(?:\r\n|\r|\n)(?=#{1,6}[ \t])|\n```[ \t]*(?:\r\n|\r|\n)")),
    (7, re.compile(r"(?:(?:\r\n|\r|\n)[ \t]*){2,}")),
)


def strengths(text: str) -> np.ndarray:
    """strength[i]: how good a cut between characters i-1 and i is; 0 inside a word. Combining marks and the halves of
    joined characters are never parted (-1)."""
    out = np.zeros(len(text) + 1, np.int8)
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            out[m.end()] = strength
    for m in re.finditer("[̀-ͯ‍︎️\U0001f3fb-\U0001f3ff]|(?<=‍).|(?<=\r)\n", text):
        out[m.start()] = -1
    return out


BLOCK, LEVELS = 1 << 16, 13  # positions of one sparse table, and its rows
HELD = 8  # tables kept, the latest


class RangeMaximum:
    """Sparse tables over blocks of strengths; the position of the maximum of [lo, hi], the rightmost of equals."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.tables: dict[int, list[np.ndarray]] = {}

    def _rows(self, block: int) -> list[np.ndarray]:
        rows = self.tables.get(block)
        if rows is None:
            if len(self.tables) >= HELD:
                del self.tables[min(self.tables)]
            part = self.values[block * BLOCK : (block + 1) * BLOCK]
            # Strength and position in one key: equal strengths compare by position.
            rows = [part.astype(np.int32) * BLOCK + np.arange(len(part), dtype=np.int32)]
            while len(rows) < LEVELS and 2 << (len(rows) - 1) <= len(part):
                span = 1 << (len(rows) - 1)
                rows.append(np.maximum(rows[-1][:-span], rows[-1][span:]))
            self.tables[block] = rows
        return rows

    def argmax(self, lo: int, hi: int) -> int:
        best, at = -(1 << 40), lo
        for block in range(lo // BLOCK, hi // BLOCK + 1):
            rows, first = self._rows(block), block * BLOCK
            a, b = max(lo - first, 0), min(hi - first, BLOCK - 1)
            level = min((b - a + 1).bit_length(), len(rows)) - 1
            row, span = rows[level], 1 << level
            top = max(int(row[a]), int(row[b - span + 1]))
            for i in range(a + span, b - span + 1, span):  # only where the window is wider than the table
                top = max(top, int(row[i]))
            if top // BLOCK >= best:
                best, at = top // BLOCK, first + top % BLOCK
        return at


def pieces(text: str | None, size: int | None, overlap: int | None) -> list[tuple[int, int, int]]:
    """(start, end, carried) of each piece of the text, in characters of the text as it came; carried of them repeat the
    end of the piece before.

    size: the most characters of a piece (null: 900; under 1 counts as 1). overlap: characters repeated (null: 120),
    exactly this many except where a joined character would be parted; one that is not less than size cannot be met, as
    no piece would hold anything new, and counts as half of size. White space at both ends of the text belongs to no piece. Null and blank texts
    have none; a text that fits is one piece.
    """
    if text is None:
        return []
    lo, hi = len(text) - len(text.lstrip(BLANKS)), len(text.rstrip(BLANKS))
    if lo >= hi:
        return []
    size = DEFAULT_SIZE if size is None else max(1, int(size))
    overlap = DEFAULT_OVERLAP if overlap is None else max(0, int(overlap))
    if overlap >= size:
        overlap = size // 2
    if hi - lo <= size:
        return [(lo, hi, 0)]
    values = strengths(text)
    table_ = RangeMaximum(values)
    out: list[tuple[int, int, int]] = []
    start, carried = lo, 0
    while True:
        if hi - start <= size:
            out.append((start, hi, carried))
            return out
        # Beyond what is repeated, and in the last part of the window, so that pieces come out nearly full.
        first = start + max(carried + 1, overlap + 1, size - max(1, size // 2))
        last = start + size
        cut = table_.argmax(min(first, last), last)
        lowest = start + max(carried, overlap) + 1
        if values[cut] <= 0 and lowest < first:  # nothing in the last part: a boundary before it
            earlier = table_.argmax(lowest, min(first, last) - 1)
            if values[earlier] > 0:
                cut = earlier
        if values[cut] <= 0 and values[last] >= 0:
            cut = last  # an unbroken stretch: as long as may be
        if values[cut] < 0:
            cut = last
        out.append((start, cut, carried))
        nxt = max(cut - overlap, start + 1)
        while nxt < cut and values[nxt] < 0:
            nxt += 1
        start, carried = nxt, cut - nxt


def split_texts(texts: DataFrame) -> DataFrame:
    """id, piece_no, n_pieces, start, length, carried, piece: the ordered pieces of every text that is not blank.

    texts: id, text, chunk_size, overlap. Positions count code points from 0. Concatenating each piece without its first
    `carried` characters gives the text back without the white space at its ends.
    """

    def make():
        def rows(key, text, size, overlap) -> list[tuple]:
            cut = pieces(text, size, overlap)
            return [(key, i, len(cut), s, e - s, c, text[s:e]) for i, (s, e, c) in enumerate(cut)]

        return rows

    return explode_texts(texts.select("id", "text", "chunk_size", "overlap"), make, "id string, piece_no int, n_pieces int, start int, length int, carried int, piece string")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries").select(F.col("entry_id").alias("id"), F.col("content").alias("text"), F.col("chunk_size").cast("int"), F.col("overlap").cast("int"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(_entries(spark, sf_dir)).withColumnRenamed("id", "entry_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the operator cut: their first pieces, where there are more."""
    cut = split_texts(_entries(spark, sf_dir)).where("piece_no = 0 and n_pieces > 1")
    return cut.select(F.col("id").alias("entry_id"))


ORACLES = {
    "p3_found": """select entry_id from entries
        where length(rtrim(ltrim(content, chr(32) || chr(9) || chr(13) || chr(10)), chr(32) || chr(9) || chr(13) || chr(10))) > coalesce(chunk_size, 900)""",
}
QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
