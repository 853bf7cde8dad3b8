"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison.

A text, with A-Z lower-cased, is a polynomial over its UTF-8 bytes, evaluated
modulo two primes. Chunks are hashed side by side and combined by arithmetic
shifted by the length of what follows: ``h(xy) = h(x) * B**len(y) + h(y)``.
Within a row the chunks are rows of one exact matrix product; a document above
``huge`` bytes is dealt out as parts, hashed by many tasks, each part already
shifted, so that a plain sum per document combines them.

Equal fingerprints are only candidates. Their texts are compared chunk by
chunk: first inside a task against the first text with that fingerprint (the
leader), then leaders against one representative per fingerprint, joined on
(representative, chunk number). Leaders that differ from it go through another
round. So copies cost the network one text per task and group, and no group
ever meets in one task.

Defined results: a null text counts as ""; of equal texts the row with the
largest doc_id stays (null is the smallest); rows that repeat a doc_id are
counted and share its verdict; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, worker_memory

#: Two primes just below 2**31 and a base for each; with the length about 2**62 different fingerprints.
PRIMES = (2147483647, 2147483629)
BASES = (1540483477, 1812433253)
#: Bytes of a hashed chunk: sums of 2**14 products below 2**39 are exact in a double.
CHUNK = 1 << 14
#: Chunks multiplied at once, bytes of a compared chunk, and bytes from which a document is dealt out in parts.
SLAB = 64
COMPARED = 1 << 16
HUGE = 1 << 24
#: Bytes of leading texts that a task remembers; beyond that it forgets them, and later copies lead anew.
HELD = 1 << 26
#: Fingerprints with copies that are broadcast (24 bytes each); for more, rows are joined by a shuffle.
BROADCAST_ROWS = 500_000

KEY = ("length", "f1", "f2")


def powers(bases: tuple[int, int] = BASES) -> np.ndarray:
    """Descending powers of each base, one column a prime: exact in a double."""
    out = np.ones((CHUNK, 2))
    for c, (p, b) in enumerate(zip(PRIMES, bases, strict=True)):
        x = 1
        for i in range(CHUNK - 2, -1, -1):
            x = x * b % p
            out[i, c] = x
    return out


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int, bases: tuple[int, int] = BASES) -> tuple[int, int]:
    """Fingerprint of two texts behind each other, from theirs and the length of the second."""
    a, b = ((x * pow(base, right_length, p) + y) % p for x, y, p, base in zip(left, right, PRIMES, bases, strict=True))
    return a, b


def fingerprint(body: bytes, table: np.ndarray, bases: tuple[int, int] = BASES) -> tuple[int, int]:
    """Values of the polynomial of ``body``; the first chunk may be shorter, all others are hashed together."""
    head = len(body) % CHUNK
    data = np.frombuffer(body, np.uint8)
    first = data[:head].astype(np.float64) @ table[CHUNK - head :]
    out = (int(first[0]) % PRIMES[0], int(first[1]) % PRIMES[1])
    for at in range(head, len(body), SLAB * CHUNK):
        for one, two in data[at : at + SLAB * CHUNK].reshape(-1, CHUNK).astype(np.float64) @ table:
            out = combine(out, (int(one), int(two)), CHUNK, bases)
    return out


def _table(bases: tuple[int, int]) -> np.ndarray:
    memory = worker_memory("powers")
    if bases not in memory:
        memory[bases] = powers(bases)
    return memory[bases]


def _bodies(column: pa.Array) -> list[bytes]:
    return [(b or b"").lower() for b in column.cast(pa.binary()).to_pylist()]


def _fingerprinted(docs: DataFrame, whole: bool, bases: tuple[int, int]) -> DataFrame:
    """doc_id, length, f1, f2 of each row; with the digest and the lower-cased bytes if ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(bases)
        for batch in batches:
            bodies = _bodies(batch.column(1))
            prints = [fingerprint(b, table, bases) for b in bodies]
            cols = [
                batch.column(0),
                pa.array([len(b) for b in bodies], pa.int64()),
                pa.array([f for f, _ in prints], pa.int64()),
                pa.array([f for _, f in prints], pa.int64()),
            ]
            names = ["doc_id", *KEY]
            if whole:
                cols += [pa.array([hashlib.sha256(b).hexdigest() for b in bodies]), pa.array(bodies, pa.binary())]
                names += ["text_sha256", "body"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, length long, f1 long, f2 long" + ", text_sha256 string, body binary" * whole
    )


def parts_of(docs: DataFrame, part: int) -> DataFrame:
    """leader, doc_id, text_sha256, length, no, chunk of every part of every row; ``leader`` numbers rows below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = _bodies(batch.column(1))
            digests = pa.array([hashlib.sha256(b).hexdigest() for b in bodies])
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array(bodies, pa.binary())], ["doc_id", "text_sha256", "body"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_sha256 string, body binary")
    rows = rows.withColumn("leader", -1 - F.monotonically_increasing_id()).withColumn("length", F.octet_length("body").cast("long"))
    cut = rows.withColumn("no", F.explode(F.expr(f"sequence(0, CAST(greatest(length - 1, 0) DIV {part} AS INT))")))
    chunk = F.expr(f"substring(body, no * {part} + 1, {part})")
    return cut.select("leader", "doc_id", "text_sha256", "length", "no", chunk.alias("chunk"))


def _part_prints(parts: DataFrame, part: int, bases: tuple[int, int]) -> DataFrame:
    """The parts, each with its fingerprint shifted by the bytes that follow it in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(bases)
        for batch in batches:
            prints = [
                combine(fingerprint(b, table, bases), (0, 0), n - k * part - len(b), bases)
                for n, k, b in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
            ]
            cols = [pa.array([f[c] for f in prints], pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "f1", "f2"])

    schema = "leader long, doc_id long, text_sha256 string, length long, no int, chunk binary, f1 long, f2 long"
    return parts.mapInArrow(run, schema)


def _sum_of(name: str, prime: int) -> Column:
    return (F.sum(F.col(name).cast("decimal(38,0)")) % F.lit(prime)).cast("long").alias(name)


def _large_rows(docs: DataFrame, part: int, bases: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """For documents dealt out in parts: their rows (as ``_led`` gives them) and their chunks, both stored."""
    parts = stored(_part_prints(parts_of(docs, part).repartition("leader", "no"), part, bases))
    same = [F.max(c).alias(c) for c in ("doc_id", "length", "text_sha256")]
    rows = parts.groupBy("leader").agg(*same, _sum_of("f1", PRIMES[0]), _sum_of("f2", PRIMES[1]))
    return rows, parts.select("leader", "no", "chunk")


def _equal(a: bytes, b: bytes) -> bool:
    x, y = memoryview(a), memoryview(b)
    return len(x) == len(y) and all(x[i : i + COMPARED] == y[i : i + COMPARED] for i in range(0, len(x), COMPARED))


def _led(rows: DataFrame) -> DataFrame:
    """Each candidate with the leader of its task, and the chunks of leaders; other rows without either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId() << 36, 0, {}, 0
        for batch in batches:
            leaders, chunks = [], []
            for *key, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5)), strict=True):
                leader = cut = None
                if body is not None:
                    same = held.setdefault(tuple(key), [])
                    leader = next((k for k, other in same if _equal(other, body)), None)
                    if leader is None:
                        leader, made = task + made, made + 1
                        cut = [body[i : i + COMPARED] for i in range(0, len(body) or 1, COMPARED)]
                        same.append((leader, body))
                        size += len(body)
                        if size > HELD:
                            held, size = {}, 0
                leaders.append(leader)
                chunks.append(cut)
            names = ["doc_id", *KEY, "text_sha256", "leader", "chunks"]
            cols = [pa.array(leaders, pa.int64()), pa.array(chunks, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *cols], names)

    schema = "doc_id long, length long, f1 long, f2 long, text_sha256 string, leader long, chunks array<binary>"
    return rows.select("doc_id", *KEY, "text_sha256", "body").mapInArrow(run, schema)


def _classes(leaders: DataFrame, chunks: DataFrame) -> DataFrame:
    """leader, class: leaders of equal texts share a class. ``leaders``: leader and key; ``chunks``: leader, no, chunk."""
    left, out = leaders, None
    while True:
        first = left.groupBy(*KEY).agg(F.min("leader").alias("class"))
        pairs = stored(left.join(first, list(KEY)).select("leader", "class", *KEY))
        others = pairs.where("leader <> class")
        mine = chunks.join(others.select("leader", "class"), "leader")
        wanted = others.select("class").distinct()
        theirs = chunks.select(F.col("leader").alias("class"), "no", F.col("chunk").alias("__chunk")).join(wanted, "class", "left_semi")
        same = mine.join(theirs, ["class", "no"], "left").groupBy("leader").agg(F.bool_and(F.col("chunk").eqNullSafe(F.col("__chunk"))).alias("same"))
        same = stored(same)
        unlike = same.where("NOT same").select("leader")
        found = pairs.join(unlike, "leader", "left_anti").select("leader", "class")
        out = found if out is None else out.unionByName(found)
        if unlike.isEmpty():
            return out
        left = pairs.join(unlike, "leader", "left_semi").select("leader", *KEY)


def deduplicate(docs: DataFrame, huge: int = HUGE, bases: tuple[int, int] = BASES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    large = F.coalesce(F.octet_length("text") > huge, F.lit(False))
    small, big = slim.where(~large), slim.where(large)
    copied = stored(_fingerprinted(small, False, bases).groupBy(*KEY).count().where("count > 1").select(*KEY, F.lit(True).alias("__copied")))
    if copied.count() <= BROADCAST_ROWS:
        copied = F.broadcast(copied)
    marked = _fingerprinted(small, True, bases).join(copied, list(KEY), "left").withColumn("body", F.when(F.col("__copied"), F.col("body")))
    rows = stored(_led(marked))
    chunks = rows.where("chunks IS NOT NULL").select("leader", F.posexplode("chunks").alias("no", "chunk"))
    slim_rows = rows.select("doc_id", *KEY, "text_sha256", "leader")
    if not big.isEmpty():
        large_rows, large_chunks = _large_rows(big, COMPARED, bases)
        slim_rows = slim_rows.unionByName(large_rows.select(*slim_rows.columns))
        chunks = chunks.unionByName(large_chunks)
    leaders = slim_rows.where("leader IS NOT NULL")
    classes = _classes(leaders.select("leader", *KEY).distinct(), chunks)
    counted = leaders.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("m")).join(classes, "leader")
    groups = counted.groupBy("class").agg(F.sum("n").alias("group_size"), F.max("m").alias("keep_id"))
    verdicts = counted.select("leader", "class").join(groups, "class").drop("class")
    joined = slim_rows.join(verdicts, "leader", "left")
    alone = F.col("leader").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""
