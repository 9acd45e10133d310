"""Cutting of oversized items at natural boundaries.

The text is split by a hierarchy of separators: sections, paragraphs, sentences, words, characters.  A unit longer than
what a piece can newly hold is split by the next level, and only such a unit; the units are then packed greedily into
pieces of at most `max_size` code points, and each piece but the first begins exactly `overlap` code points before the
end of the one before it.

Defined results: items of at most `max_size` are not cut and give no rows (null and empty contents neither); pieces
tile the content, so dropping the first `overlap` characters of all but the first gives it back; `start_line` and
`end_line` count \\n, \\r\\n and \\r as one break each, from `lines.start_line`, and are null where that is; repeated rows
are cut alike; other columns of the table do not matter.

Scale: a narrow projection; the length filter runs before Python sees a row, nothing is shuffled, and work is linear in
the length of an item.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("section", "paragraph", "sentence", "word", "character")
_SECTION = re.compile(r"(?m)^(?=#{1,6}[ \t]|={1,6}[ \t]|\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\b)")
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")
_SENTENCE = re.compile(r"(?:\r\n|\r|\n)|(?<=[.!?])[ \t]+")
_WORD = re.compile(r"[ \t\r\n]+")
_BREAK = re.compile(r"\r\n|\r|\n")
_SCHEMA = (
    "chunk_id bigint, piece_no int, begin_char int, end_char int, piece string, start_line int, end_line int, "
    "boundary string, cut_kind string"
)


def _level_cuts(text: str) -> list[list[int]]:
    """For each level but the last, the places where a unit of that level ends."""
    sections = [m.start() for m in _SECTION.finditer(text)]
    paragraphs = [m.end() for m in _PARAGRAPH.finditer(text)]
    sentences = [m.end() for m in _SENTENCE.finditer(text)]
    words = [m.end() for m in _WORD.finditer(text)]
    return [sections, paragraphs, sentences, words]


def unit_ends(text: str, room: int) -> list[tuple[int, int]]:
    """(end, level) of the units: each is as high in the hierarchy as its length, at most `room`, allows."""
    cuts = _level_cuts(text)
    ends: list[tuple[int, int]] = []

    def divide(begin: int, end: int, level: int, own: int) -> None:
        if end - begin <= room:
            ends.append((end, own))
            return
        if level == len(cuts):
            ends.extend((at, level) for at in range(begin + room, end, room))
            ends.append((end, own))
            return
        inner = cuts[level]
        places = [at for at in inner[bisect_right(inner, begin) : bisect_left(inner, end)]]
        for at in places:
            divide(begin, at, level + 1, level)
            begin = at
        divide(begin, end, level + 1, own)

    divide(0, len(text), 0, 0)
    return ends


def cut(text: str, max_size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, end, level of the boundary at the end) of each piece of a text."""
    if len(text) <= max_size:
        return [(0, len(text), 0)]
    pieces, begin, end, at = [], 0, 0, 0
    for stop, level in unit_ends(text, max_size - overlap):
        if stop - begin > max_size:
            pieces.append((begin, end, at))
            begin = end - overlap
        end, at = stop, level
    pieces.append((begin, end, at))
    return pieces


def longest_word(text: str) -> int:
    """Length of the longest run without white space."""
    return max(map(len, _WORD.split(text)), default=0)


def is_oversized(content: Column, max_size: int) -> Column:
    return F.length(content) > max_size


def split_oversized(
    df: DataFrame,
    max_size: int,
    overlap: int,
    id_column: str = "chunk_id",
    content_column: str = "content",
    lines_column: str = "lines",
) -> DataFrame:
    """The pieces of every item whose content is longer than `max_size` code points.

    `boundary` is the level of the cut at the piece's end, `cut_kind` is `forced` for all pieces of an item with a run of
    more than `max_size` characters without white space, which no cut between words can keep under the limit, else
    `natural`."""
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be smaller than the limit")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text, first in zip(*(batch.column(i).to_pylist() for i in range(3))):
                breaks = [m.end() for m in _BREAK.finditer(text)]
                pieces_of = cut(text, max_size, overlap)
                kind = "forced" if any(level == len(LEVELS) - 1 for *_, level in pieces_of) and longest_word(text) > max_size else "natural"
                for number, (begin, end, level) in enumerate(pieces_of, 1):
                    start_line = None if first is None else first + bisect_right(breaks, begin)
                    end_line = None if first is None else first + bisect_right(breaks, max(begin, end - 1))
                    rows.append((item, number, begin, end, text[begin:end], start_line, end_line, LEVELS[level], kind))
                if len(rows) > 2000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    content = F.col(content_column)
    source = df.where(is_oversized(content, max_size)).select(
        F.col(id_column).cast("bigint").alias("chunk_id"),
        content.cast("string").alias("content"),
        F.col(lines_column)["start_line"].cast("int").alias("first_line"),
    )
    return source.mapInArrow(pieces, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), *[pa.int32()] * 3, pa.string(), *[pa.int32()] * 2, pa.string(), pa.string()]
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
