"""Finding short benchmark items inside long documents by size-partitioned MinHash containment search.

Items are partitioned by size (powers of two of their number of shingles). For
the partition with sizes up to U a document is read through windows of 1.5 * U
shingles that start every U / 2, so any run of U shingles lies inside one
window. An unbroken item resembles that window by 1/3 at least, one with a
fifth of its shingles changed by 1/4, however long the document is. A window
and an item are candidates if one of ``HASHES`` minima agrees, which by
calculation fails at most once in 400,000 at 1/3 and once in 10,000 at 1/4.
Candidates are verified by exact shingle containment in the whole document.

Windows would dilute items of few shingles, so items of up to ``EXACT`` shingles
are looked up exactly and never missed: so many of their shingles that one must
stand in every document that holds enough of them. Items with fewer than ``N``
words are looked up as runs of their own length.

Only minima that an item of the partition has leave a task, so what is
shuffled follows the hits, not the corpus.

Defined results: words are letters and digits, A-Z lower-cased; an item
without words matches nothing; repeated items or rows give each pair once; a
null id takes no part; empty tables give no pairs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_worker, stored, without
from .shingles import plain_words, rolled, shingle_set, word_hashes

N = 5
SIMILARITY = (4, 5)
HASHES = 32
#: Items of so many shingles are looked up by shingles instead of minima.
EXACT = 8
#: Items whose minima are looked up inside the tasks; with more, minima are joined. The result is the same.
INSIDE = 100_000
_SEEDS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(1, HASHES + 1)]


def partition_of(size: int) -> int:
    """Largest size of the partition of a set of ``size`` shingles."""
    return 1 << (size - 1).bit_length()


def _permuted(hashes: np.ndarray, seed: int) -> np.ndarray:
    return (hashes ^ np.uint64(seed >> 1)) * np.uint64(seed)


def _salt(upper: int, which: int) -> np.uint64:
    """Tells minima of different partitions and seeds apart."""
    return np.uint64((upper * 0x632BE59BD9B4E019 + which * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)


def item_keys(shingles: np.ndarray) -> tuple[int, list[int]]:
    """Partition of a set and its minima as keys."""
    upper = partition_of(len(shingles))
    return upper, [int(_permuted(shingles, s).min() ^ _salt(upper, i)) for i, s in enumerate(_SEEDS)]


def window_keys(rows: list[np.ndarray], uppers: list[int], sieve: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of the minima of all windows of all rows; ``sieve`` marks the highest bits of keys to keep."""
    lengths = np.array([len(r) for r in rows], np.int64)
    if not uppers or not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    every = np.concatenate(rows)
    begin = np.cumsum(lengths) - lengths
    shapes = []
    for upper in uppers:
        step = upper // 2
        blocks = -(-lengths // step)
        owner = np.repeat(np.arange(len(rows)), blocks)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        shapes.append((upper, owner, begin[owner] + inside * step))
    out_rows, out_keys = [], []
    for i, seed in enumerate(_SEEDS):
        h = _permuted(every, seed)
        for upper, owner, starts in shapes:
            m = np.minimum.reduceat(h, starts)
            w = m.copy()
            for k in (1, 2):  # windows of three blocks, fewer at the end of a row
                same = np.flatnonzero(owner[k:] == owner[:-k])
                w[same] = np.minimum(w[same], m[same + k])
            w ^= _salt(upper, i)
            if sieve is not None:
                hit = np.flatnonzero(sieve[w >> np.uint64(44)])
                w, owner_w = w[hit], owner[hit]
            else:
                owner_w = owner
            out_rows.append(owner_w)
            out_keys.append(w)
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _slim(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).where(F.col(key).isNotNull())


def exact_keys(shingles: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Shingles of a set, one of which every document holds that contains enough of the set."""
    num, den = similarity
    return shingles[: max(1, len(shingles) + num * len(shingles) // -den + 1)]


def signatures(items: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """item_id, kind (shingle length), upper (partition, 0 for items looked up exactly) and every key of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = plain_words(text)
                hashes = word_hashes(words, len(words))
                if 0 < len(words) < N:
                    rows.append((item, len(words), 0, int(rolled(hashes, len(words)).view(np.int64)[0])))
                elif words:
                    shingles = shingle_set(hashes, N)
                    upper, keys = (0, exact_keys(shingles, similarity)) if len(shingles) <= EXACT else item_keys(shingles)
                    rows += [(item, N, upper, k) for k in np.array(keys, np.uint64).view(np.int64).tolist()]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item_id", "kind", "upper", "key"])

    return _slim(items, "item_id").mapInArrow(run, "item_id long, kind int, upper long, key long")


def document_keys(docs: DataFrame, shapes: list[tuple[int, int]], wanted: np.ndarray | None) -> DataFrame:
    """doc_id, key of every minimum of every window and of every shingle looked up exactly; only keys in ``wanted`` (sorted) if given."""
    uppers = [u for _, u in shapes if u]
    exact = [k for k, u in shapes if not u]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        sieve = None
        if wanted is not None:
            sieve = np.zeros(1 << 20, bool)
            sieve[wanted.view(np.uint64) >> np.uint64(44)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                words = [plain_words(t) for t in part.column(1).to_pylist()]
                hashes = [word_hashes(w, len(w)) for w in words]
                owner, keys = window_keys([rolled(h, N) for h in hashes], uppers, sieve)
                owner, keys = [owner], [keys]
                for k in exact:
                    runs = [np.unique(rolled(h, k)) for h in hashes]
                    owner.append(np.repeat(np.arange(len(runs)), [len(r) for r in runs]))
                    keys.append(np.concatenate(runs))
                owner, keys = np.concatenate(owner), np.concatenate(keys).view(np.int64)
                if wanted is not None:
                    hit = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
                    owner, keys = owner[hit], keys[hit]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(keys)], ["doc_id", "key"])

    return docs.mapInArrow(run, "doc_id long, key long")


def contained_items(docs: DataFrame, items: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_item (shingles of the item), n_common: pairs whose containment reaches the similarity."""
    docs, items = _slim(docs, "doc_id"), _slim(items, "item_id").dropDuplicates(["item_id"])
    signed = stored(signatures(items, similarity))
    shapes = sorted(tuple(r) for r in signed.select("kind", "upper").distinct().collect())
    wanted = None
    if signed.select("item_id").distinct().count() <= INSIDE:
        keys = signed.select("key").distinct().collect()  # at most INSIDE * HASHES numbers
        wanted = np.sort(np.array([r[0] for r in keys] or [0], np.int64))
    hits = document_keys(docs, shapes, wanted).join(signed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    pairs = stored(hits)
    num, den = similarity
    texts = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = pairs.join(texts, "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            rows, last = [], (None, None)
            for doc, item, text, other in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last[0] != doc:
                    words = plain_words(text)
                    last = (doc, word_hashes(words, len(words)))
                words = plain_words(other)
                s = shingle_set(word_hashes(words, len(words)), N)
                whole = np.unique(rolled(last[1], min(N, len(words))))
                common = len(np.intersect1d(s, whole, assume_unique=True))
                if den * common >= num * len(s):
                    rows.append((doc, item, len(s), common))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_item", "n_common"])

    return both.select("doc_id", "item_id", "text", "item").mapInArrow(run, "doc_id long, item_id long, n_item long, n_common long")


def decontaminated(docs: DataFrame, items: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that contain an item; rows without doc_id stay."""
    return without(docs, contained_items(docs, items, similarity).select("doc_id"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bk AS (SELECT item_id, w, least({N}, len(w)) AS k FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
bn AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
ks AS (SELECT DISTINCT k FROM bk),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k))
SELECT doc_id, item_id, n_item, count(*) AS n_common FROM ds JOIN bs USING (k, s) JOIN bn USING (item_id)
GROUP BY ALL HAVING {SIMILARITY[1]} * count(*) >= {SIMILARITY[0]} * n_item
"""
