"""Packing documents into training sequences by swap-based local search.

Each text becomes token ids and the end id; only documents longer than a
sequence are cut, into full pieces of which the first may be shorter. Pieces
are dealt by hash into groups of about ``GROUP``, and each group is packed on
its own: best fit decreasing, then local search that moves or exchanges
documents (one for one, two for one) between underfull bins as long as the sum
of squared fills grows, until bins run empty. Only lengths take part; ids
never move, and what a task holds is bounded by ``GROUP``.

Defined results: text null or "" is a piece of one id; repeated rows are
packed as often as they come; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, stored
from .tokens import REMEMBERED, default_vocabulary, encode_arrays

SEQUENCE = 2048
GROUP = 20_000


def pieces(docs: DataFrame, vocabulary: str, size: int, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode_arrays(part.column(1), vocabulary, remembered), strict=True):
                    ids, n = ids.astype("<u4", copy=False), len(ids)
                    end = n % size or min(n, size)
                    start = piece = 0
                    while start < n:
                        rows.append((doc, piece, start, end - start, zlib.crc32(ids[start:end])))
                        start, end, piece = end, end + size, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers; longest items first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    lowest = np.zeros(size + 2, bool)  # which free sizes have a bin
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        at = int(np.argmax(lowest[need:])) + need
        if lowest[at]:
            b = by_free[at].pop()
            lowest[at] = bool(by_free[at])
            bins[b].append(int(i))
            free = at - need
        else:
            b = len(bins)
            bins.append([int(i)])
            free = size - need
        if free:
            by_free[free].append(b)
            lowest[free] = True
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], size: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that raise the sum of squared fills.

    Stops when no step helps, or when the free space of all bins is less than
    one bin, so that no bin can be saved any more.
    """
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    least = -(-int(lengths.sum()) // size)
    kept = [b for b in range(len(bins)) if fill[b] == size]
    loose = [b for b in range(len(bins)) if fill[b] < size]
    if len(kept) + len(loose) <= least:
        return bins
    items = np.array([i for b in loose for i in bins[b]], np.int64)
    where = np.array([k for k, b in enumerate(loose) for _ in bins[b]], np.int64)
    length, fill = lengths[items].astype(np.int64), fill[loose]
    live = int((fill > 0).sum())

    def gain(a: int, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        """By how much squared fill grows when ``d`` goes from bin a to bins b."""
        return 2 * d * (fill[b] - fill[a] + d)

    for a in np.argsort(fill, kind="stable"):
        while fill[a]:
            own = np.flatnonzero(where == a)
            own = own[np.argsort(-length[own], kind="stable")]
            best = (0, None)
            free = size - fill[where]
            other = where != a
            for k in own:  # a move, or one for one
                room = size - fill
                room[a] = -1
                fits = np.flatnonzero((room >= length[k]) & (fill > 0))
                if len(fits):
                    g = gain(a, fits, np.full(len(fits), length[k]))
                    if g.max() > best[0]:
                        best = (int(g.max()), ([k], [], int(fits[g.argmax()])))
                d = length[k] - length
                swap = np.flatnonzero(other & (d > 0) & (d <= free))
                if len(swap):
                    g = gain(a, where[swap], d[swap])
                    if g.max() > best[0]:
                        j = swap[g.argmax()]
                        best = (int(g.max()), ([k], [j], int(where[j])))
            for n, k in enumerate(own[:8]):  # two for one
                for m in own[n + 1 : 8]:
                    d = length[k] + length[m] - length
                    swap = np.flatnonzero(other & (d > 0) & (d <= free))
                    if len(swap):
                        g = gain(a, where[swap], d[swap])
                        if g.max() > best[0]:
                            j = swap[g.argmax()]
                            best = (int(g.max()), ([k, m], [j], int(where[j])))
            if best[1] is None:
                break
            out, back, b = best[1]
            moved = int(length[out].sum() - length[back].sum())
            where[out], where[back] = b, a
            fill[a] -= moved
            fill[b] += moved
        if not fill[a]:
            live -= 1
            if len(kept) + live <= least:
                break
    packed: list[list[int]] = [[] for _ in loose]
    for i, b in zip(items, where, strict=True):
        packed[b].append(int(i))
    return [bins[b] for b in kept] + [b for b in packed if b]


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, group: int = GROUP, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    rows = stored(pieces(docs, vocabulary or default_vocabulary(), size, remembered))
    groups = rows.count() // group + 1

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(local_search(lengths, best_fit(lengths, size), size)):
            ends = np.cumsum(lengths[b])
            sequence[b] = (int(key[0]) << 32) + k
            offset[b] = ends - lengths[b]
        return pdf.assign(sequence_id=sequence, offset=offset).drop(columns="__g")

    dealt = rows.withColumn("__g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("__g").applyInPandas(run, schema)
