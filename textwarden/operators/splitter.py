"""Chunks of a text along its paragraphs, lines and words, with an overlap, row by row.

A text is split at the first separator that it holds (blank line, line end,
blank, then letter by letter); a piece as long as a chunk is split again by
the next one. Separators stay in front of what follows them. Pieces are then
merged in order: a chunk ends before the piece that would make it longer than
``size``, and the next one begins with the last whole pieces that fit into
``overlap`` and leave room for that piece. Pieces that had to be split again
are merged among themselves alone. Chunks lose the white space around them;
empty ones are left out.

Only the places of pieces take part, and a chunk finds its ends among them by
bisection: what is done per word is a split and a sum, all else per chunk.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows

# Separators from coarse to fine; after the last one, single letters.
SEPARATORS = ("\n\n", "\n", " ")


def _merged(places: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the chunks of neighbouring pieces; ``places``: where each begins, and the end of the last."""
    i, last = 0, len(places) - 1
    while True:
        k = bisect_right(places, places[i] + size) - 1
        yield places[i], places[k]
        if k == last:
            return
        end = places[k]
        i = bisect_left(places, max(end - overlap, places[k + 1] - size), i, k)


def chunk_bounds(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS, at: int = 0) -> Iterator[tuple[int, int]]:
    """Begin and end of every chunk of a text that starts ``at``, before white space is taken off."""
    if len(text) <= size:
        if text:
            yield at, at + len(text)
        return
    if not separators:
        yield from _merged(range(at, at + len(text) + 1), size, overlap)
        return
    wide = len(separators[0])
    parts = text.split(separators[0])
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + wide) - wide
    places = np.concatenate([[0], ends]) if parts[0] else ends
    long = np.flatnonzero(np.diff(places) >= size).tolist()
    places, done = places.tolist(), 0
    for k in [*long, len(places) - 1]:
        if done < k:
            yield from _merged([at + p for p in places[done : k + 1]], size, overlap)
        if k < len(places) - 1:
            yield from chunk_bounds(text[places[k] : places[k + 1]], size, overlap, separators[1:], at + places[k])
        done = k + 1


def _chunks_udf(size: int, overlap: int, separators: Sequence[str]):
    """UDF: text to its chunks."""

    def chunks(value: pa.Scalar) -> list[str]:
        text = (value.as_py() or b"").decode("utf-8", "replace")
        found = (text[a:b].strip() for a, b in chunk_bounds(text, size, overlap, separators))
        return [c for c in found if c]

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array(map(chunks, texts.cast(pa.binary())), pa.list_(pa.string()))

    return split


def split_text(df: DataFrame, *keep: str, text: str = "text", size: int = 1000, overlap: int = 150, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """``keep``, chunk, chunk_no of every chunk of every row; null and blank texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than a chunk")
    split = _chunks_udf(size, overlap, separators)
    return explode_rows(df.withColumn("__c", split(F.col(text).cast("string"))), keep, "__c", "chunk", "chunk_no")
