"""Near-duplicate texts by an exact Jaccard join on word n-grams with adaptive multi-match prefixes.

Two documents whose sets reach the similarity share at least ``l`` of their
``l``-prefixes (the first |x| - a + l shingles in one global order, a being the
least overlap), for every l. Each document picks its own l by the estimated
cost of its prefix: short prefixes read few lists but let many candidates
through, long ones demand more common shingles. A pair is a candidate when it
shares min(l, l') prefix shingles.

Of two documents the smaller is looked up by a shorter prefix, since the pair
must then share more than its own size alone demands. Where a shingle stands in
both prefixes also bounds what the pair can share: up to there only shingles
that other prefixes hold too, behind it what is left of either set. Last, two
sets differ in at least as many shingles as their parity bits (``PARITY`` longs
per set) differ.

The global order is by estimated frequency, rare first. Estimates come from
counters over all shingles of all documents (a fixed table of ``COUNTERS``,
its size does not grow with the data); they steer cost only, any order gives
the same result.

Large groups do not become all pairs. Equal sets are one class. Each class is
compared with one other class, the centre of most of its lists, and if that
fails with a second one (linear in the rows); verified links are merged into
components. Only lists that then still hold several components yield pairs,
and only between different components. Links inside a component cannot change
it, so the components are those of all links.

Defined results: words end at blanks, tabs and line ends; fewer words than n
are one shingle; no words, null or "" give an empty set, linked with nothing;
repeated rows are returned as often as they come; a null doc_id gets no
links and a null component; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import BROADCAST_IDS, components, fresh_worker, stored, without
from .shingles import blank_words, shingle_set, word_hashes

#: Counters of the frequency estimate, as a power of two, and in how many rows they travel.
COUNTERS = 24
CHUNKS = 64
#: Longest extension of a prefix, what verifying a candidate costs in list entries, and
#: how many unrelated sets hold a shingle that the counters show as met once.
LONGEST = 8
VERIFY_COST = 50.0
BACKGROUND = 0.25
PARITY = 8


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def estimated_counts(docs: DataFrame, n: int, bits: int = COUNTERS) -> np.ndarray:
    """Rounded logarithm (halves of powers of two) of how often each counter was met, one byte each."""
    size = 1 << bits
    step = size // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        total, any_row = np.zeros(size, np.uint32), False
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                words = blank_words(text)
                found.append(shingle_set(word_hashes(words, len(words)), n))
                any_row = True
            if found:
                at, times = np.unique((np.concatenate(found) & np.uint64(size - 1)).astype(np.uint32), return_counts=True)
                total[at] += times.astype(np.uint32)
        if any_row:
            packed = [zlib.compress(np.minimum(total[i * step : (i + 1) * step], 0xFFFF).astype("<u2").tobytes(), 1) for i in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(packed), "<u2").astype(np.int64)
                sums[chunk] = sums[chunk] + got if chunk in sums else got
        for chunk, total in sums.items():
            level = np.minimum(255, np.rint(2 * np.log2(1 + total))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    got = docs.select("text").mapInArrow(count, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema).collect()
    out = np.zeros(size, np.uint8)
    for r in got:
        out[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return out


def least_overlap(n: int, similarity: Fraction) -> int:
    """Fewest common shingles with which a set of ``n`` can reach the similarity."""
    return math.ceil(similarity * n)


def prefix_of(shingles: np.ndarray, levels: np.ndarray, noise: float, similarity: Fraction) -> tuple[np.ndarray, int]:
    """The cheapest prefix of a set and its l; ``noise`` is the level that other shingles give a counter."""
    n = len(shingles)
    level = levels[(shingles & np.uint64(len(levels) - 1)).astype(np.int64)]
    base = n - least_overlap(n, similarity)
    longest = min(LONGEST, n - base)
    order = np.lexsort((shingles, level))[: base + longest]
    others = np.maximum(0.0, np.exp2(level[order] / 2) - np.exp2(noise / 2)) * (level[order] > noise + 1)
    upto = np.cumsum(others + BACKGROUND)
    cost = [upto[base + k - 1] + VERIFY_COST * upto[base + k - 1] / k + base + k for k in range(1, longest + 1)]
    best = int(np.argmin(cost)) + 1
    return shingles[order[: base + best]], best


def parity_of(shingles: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of the set's shingles fall on each."""
    width = 64 * PARITY
    odd = np.bincount(((shingles >> np.uint64(40)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketched(docs: DataFrame, levels: np.ndarray, n: int, similarity: Fraction) -> DataFrame:
    """doc_id, size, class digest, l, prefix and parity bits of every row."""
    spark = docs.sparkSession
    table, noise = spark.sparkContext.broadcast(levels), float(np.median(levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        levels = table.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = blank_words(text)
                s = shingle_set(word_hashes(words, len(words)), n)
                prefix, need = prefix_of(s, levels, noise, similarity) if len(s) and doc is not None else (s[:0], 0)
                digest = blake2b(s.tobytes(), digest_size=16).digest()
                rows.append((doc, len(s), digest, need, prefix.view(np.int64).tolist(), parity_of(s).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "size", "class", "need", "prefix", "parity"]
            )

    return docs.mapInArrow(run, "doc_id long, size long, class binary, need int, prefix array<bigint>, parity array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; texts are fetched for these pairs only."""
    num, den = similarity.numerator, similarity.denominator
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            keep, last = [], (None, None)
            for b, x, y in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if last[0] != b:
                    words = blank_words(y)
                    last = (b, shingle_set(word_hashes(words, len(words)), n))
                words = blank_words(x)
                s = shingle_set(word_hashes(words, len(words)), n)
                common = len(np.intersect1d(s, last[1], assume_unique=True))
                keep.append(den * common >= num * (len(s) + len(last[1]) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sizes_fit(x: str, y: str, similarity: Fraction) -> Column:
    num, den = similarity.numerator, similarity.denominator
    return (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)


def _bound(x: str, y: str, similarity: Fraction) -> Column:
    """Whether a pair that meets at this entry can still share enough.

    A shingle before it that stands in no other prefix is in neither set of
    the pair twice: the other set would hold it in its prefix too. So at most
    ``rank`` shingles are common up to here.
    """
    num, den = similarity.numerator, similarity.denominator
    c = lambda side, name: F.col(f"{side}_{name}")
    upto = F.least(c(x, "rank"), c(y, "rank"))
    behind = F.least(c(x, "size") - 1 - c(x, "at"), c(y, "size") - 1 - c(y, "at"))
    return (upto + behind) * (num + den) >= (c(x, "size") + c(y, "size")) * num


def _side(df: DataFrame, side: str, *more: str) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "size", "need", "at", "rank", "c", *more)]


def _placed(listed: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Adds ``c``, the component so far."""
    if groups is None:
        return listed.withColumn("c", F.col("doc_id"))
    return listed.join(groups, F.col("doc_id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "doc_id")).drop("node", "component")


def _star_pairs(placed: DataFrame, order: Column, similarity: Fraction) -> DataFrame:
    """For each class the centre, of another component, of most of its lists."""
    top = F.struct(order.alias("order"), *_side(placed, "y"))
    centres = placed.groupBy("token").agg(F.max(top).alias("top"))
    met = placed.select("token", *_side(placed, "x")).join(centres, "token").select("*", "top.*")
    return (
        met.where((F.col("x_c") != F.col("y_c")) & _sizes_fit("x_size", "y_size", similarity) & _bound("x", "y", similarity))
        .groupBy("x_doc_id", "y_doc_id")
        .agg(F.count(F.lit(1)).alias("k"), F.min(F.least("x_need", "y_need")).alias("need"))
        .where("k >= need")
        .groupBy(F.col("x_doc_id").alias("a"))
        .agg(F.max_by("y_doc_id", F.struct("k", "y_doc_id")).alias("b"))
    )


def _alike(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs whose parity bits leave room for the similarity."""
    num, den = similarity.numerator, similarity.denominator
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("size").alias(f"{c}_size"), F.col("parity").alias(f"{c}_bits"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    bit = lambda i: F.bit_count(F.get("a_bits", F.lit(i)).bitwiseXOR(F.get("b_bits", F.lit(i))))
    differ, sizes = sum((bit(i) for i in range(PARITY)), F.lit(0)), F.col("a_size") + F.col("b_size")
    return both.where((sizes - differ) * (num + den) >= sizes * (2 * num)).select("a", "b")


def _remaining_pairs(placed: DataFrame, parity: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs of different components that share enough of their prefixes; a is the larger set."""
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    bits = [f"p{i}" for i in range(PARITY)]
    named = parity.select(F.col("doc_id").alias("set_id"), *[F.get("parity", F.lit(i)).alias(b) for i, b in enumerate(bits)])
    lists = stored(placed.join(mixed, "token", "left_semi").join(named, F.col("doc_id") == F.col("set_id")).drop("set_id"))
    x, y = lists.select("token", *_side(lists, "x", *bits)), lists.where("indexed").select("token", *_side(lists, "y", *bits))
    smaller = (F.col("y_size") < F.col("x_size")) | ((F.col("y_size") == F.col("x_size")) & (F.col("y_doc_id") < F.col("x_doc_id")))
    num, den = similarity.numerator, similarity.denominator
    behind = F.least(F.col("x_size") - 1 - F.col("x_at"), F.col("y_size") - 1 - F.col("y_at"))
    sizes = F.col("x_size") + F.col("y_size")
    differ = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in bits), F.lit(0))
    alike = (sizes - differ) * (num + den) >= sizes * (2 * num)
    return (
        x.join(y, "token")
        .where(smaller & (F.col("x_c") != F.col("y_c")) & _sizes_fit("x_size", "y_size", similarity) & _bound("x", "y", similarity) & alike)
        .groupBy("x_doc_id", "y_doc_id")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.min(F.least("x_need", "y_need")).alias("need"),
            F.min(behind).alias("behind"),
            F.first(sizes).alias("sizes"),
        )
        .where((F.col("k") >= F.col("need")) & ((F.col("k") + F.col("behind")) * (num + den) >= F.col("sizes") * num))
        .select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b"))
    )


def jaccard_components(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id of every row."""
    docs = _slim(docs)
    rows = stored(sketched(docs, estimated_counts(docs, n), n, similarity))
    # Stored, as other small sides below, so that a join can split the rows of a hot class.
    classes = stored(rows.where("size > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id")))
    known = rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    # Of two sets the smaller, y, shares at least 2 s / (1 + s) of its own size.
    num, den = 2 * similarity.numerator, similarity.numerator + similarity.denominator
    index_length = F.col("size") - F.ceil(F.col("size") * num / den - F.lit(1e-9)) + F.col("need")
    kept = known.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    # All shingles of all prefixes are shuffled here, so they carry nothing but their set and place.
    entries = kept.select("doc_id", F.posexplode("prefix").alias("at", "token"))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    sets = known.select(F.col("doc_id").alias("set_id"), "size", "need", index_length.alias("ix"))
    own = Window.partitionBy("doc_id")
    listed = stored(
        entries.join(shared, "token")
        .join(sets, F.col("doc_id") == F.col("set_id"))
        .select("token", "doc_id", "size", "need", "at", "k", (F.col("at") < F.col("ix")).alias("indexed"))
        .withColumn("rank", F.row_number().over(own.orderBy("at")))
        .withColumn("degree", F.sum(F.col("k") - 1).over(own))
        .drop("k")
    )
    # First the class that shares most lists with others, then any other class of the lists.
    bits = known.select("doc_id", "size", "parity")
    pairs = stored(_alike(_star_pairs(_placed(listed, None), F.col("degree"), similarity), bits, similarity))
    first = stored(verified(pairs, docs, n, similarity))
    hung = first.select(F.col("a").alias("node"), F.col("b").alias("component"))
    pairs = stored(_alike(_star_pairs(_placed(listed, hung), F.xxhash64("doc_id"), similarity), bits, similarity))
    links = first.unionByName(stored(verified(pairs, docs, n, similarity)))
    groups = stored(components(links))
    pairs = stored(_remaining_pairs(_placed(listed, groups), known.select("doc_id", "parity"), similarity))
    more = stored(verified(pairs, docs, n, similarity))
    links = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    whole = stored(components(links))
    return (
        rows.join(classes, "class", "left")
        .withColumn("class_id", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
        .join(whole, F.col("class_id") == F.col("node"), "left")
        .select(
            "doc_id",
            F.col("size").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id")).alias("component_id"),
        )
    )


def one_per_component(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` without the documents that another of their component, with a smaller doc_id, stands for.

    Repeated rows of a document that stays are kept; rows without doc_id stay.
    """
    found = jaccard_components(docs, n, similarity)
    return without(docs, found.where("component_id <> doc_id").select("doc_id"))
