"""Periodic runs of words in each document, by a descending-LCP Kruskal over its suffixes.

The suffixes of a document are sorted by prefix doubling, and neighbours in
that order are joined by edges that weigh their longest common prefix (LCP).
Edges are taken by descending weight, as Kruskal's algorithm does, and unite
classes of suffixes by union-find; a class keeps its positions in order. When
two positions i < j become neighbours in a class while the weight is L and
j - i <= L, the words from i to j + L have period j - i: a seed. Every maximal
run with smallest period q that starts at s has its seed (s, s + q), because a
position of the class between them would give a smaller period; so a seed is a
run if its left neighbours differ, and each run comes once, with its length
j - i + L. As j - i <= L, a run of at least ``least`` words has a weight of
half of that, where the descent stops; texts in which no such long sequence
of words recurs are told by one sort of hashes and skipped.

A document is worked on where it lies; nothing is shuffled.

Defined results: a null text counts as ""; a text without words has no runs
and collapses to ""; repeated rows are worked on each; an empty table gives no
rows; other columns than those asked for are dropped.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_memory
from .shingles import rolled, word_hashes

#: Words of a run at least, and how many full periods it holds.
LEAST = 12
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions by suffix, and ranks of every position by its first 1, 2, 4, ... words.

    ``codes`` ends with a code found nowhere else. Only positions whose rank is
    shared are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, h = [rank], 1
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            return order, ranks
        here = order[at]
        first, second = rank[here], rank[here + h]
        by = np.lexsort((second, first))
        here, first, second = here[by], first[by], second[by]
        order[at] = here
        new = np.ones(n, bool)
        new[at[1:]] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[here] = np.maximum.accumulate(np.where(new[at], at, 0))
        ranks.append(rank)
        h *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix with the next in ``order``."""
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][a[live] + lcp[live]] == ranks[k][b[live] + lcp[live]]
        lcp[live[same]] += 1 << k
    return lcp


def find_runs(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start and period; ``codes`` are words as numbers."""
    floor = (least + 1) // 2
    if len(codes) < least:
        return []
    closed = np.concatenate([codes.astype(np.int64), [int(codes.max()) + 1]])
    order, ranks = suffix_order(closed)
    lcp = common_prefixes(order, ranks)
    edges = np.flatnonzero(lcp >= floor)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    word, suffix = closed.tolist(), order
    root: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    runs = []

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root[x]
        return top

    for edge, weight in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = find(edge), find(edge + 1)
        mine = places.pop(a, None) or [int(suffix[a])]
        other = places.pop(b, None) or [int(suffix[b])]
        if len(mine) < len(other):
            a, b, mine, other = b, a, other, mine
        root[b] = a
        # New neighbours are pairs of one position of each side with none between them.
        last = -1
        for k, x in enumerate(other):
            at = bisect_left(mine, x)
            after = other[k + 1] if k + 1 < len(other) else len(word)
            pairs = []
            if at and mine[at - 1] > last:
                pairs.append((mine[at - 1], x))
            if at < len(mine) and mine[at] < after:
                pairs.append((x, mine[at]))
            for i, j in pairs:
                if j - i <= weight and j - i + weight >= least and (i == 0 or word[i - 1] != word[j - 1]):
                    runs.append((i, j - i + weight, j - i))
            last = x
        if len(other) == 1:
            mine.insert(bisect_left(mine, other[0]), other[0])
        else:
            mine += other
            mine.sort()  # two ordered stretches are merged in linear time
        places[a] = mine
    return sorted(runs, key=lambda r: (r[0], r[2]))


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words some run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def runs_of(words: list[bytes], hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs of a list of words; equal words are told by their bytes, hashes only tell texts that have none."""
    grams = np.sort(rolled(hashes, (least + 1) // 2))
    if not (grams[1:] == grams[:-1]).any():
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return find_runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least)


def detect_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period), collapsed text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("periodic runs")
        for batch in batches:
            counts, found, collapsed = [], [], []
            for body in batch.column(1).cast(pa.binary()).to_pylist():
                words = body.split() if body else []
                runs = runs_of(words, word_hashes(words, len(words)), least) if len(words) >= least else []
                if runs:
                    words_kept = [words[i] for i in np.flatnonzero(~dropped_words(len(words), runs)).tolist()]
                else:
                    words_kept = words
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                collapsed.append(b" ".join(words_kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(found, pa.list_(RUN)),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where about every tenth document repeats its last words, as its checksum says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("__words").cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - F.col("__a") - 1), lambda k: F.get("__words", (F.col("__a") + k % F.col("__p")).cast("int")))
    repeated = F.array_join(F.concat(F.slice("__words", 1, F.col("__a").cast("int")), again), " ")
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("__words", F.when(chosen, words)).withColumn("__n", n)
    rows = rows.withColumn("__a", F.when(F.col("__n") > 0, a)).withColumn("__p", F.when(F.col("__n") > 0, p))
    return rows.select("doc_id", F.when(F.col("__words").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """The digest of what ``detect_runs`` found: number of runs, the longest, and checksums of all and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("s"), r["period"].alias("p"))))

    def line(r: Column) -> Column:
        return F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))

    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.withColumn("__b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__b.s").alias("start"), F.col("__b.length").alias("length"),
        F.col("__b.p").alias("period"), F.expr("1000 * __b.length DIV __b.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
