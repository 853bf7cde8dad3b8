"""Collocations: phrases of 2 to 4 words that are frequent and hold together, mined by SON partitioning.

Documents are dealt by hash into a few shards, however large the corpus; each
shard of a language is mined completely at the support that falls to it, the
whole one times its share of the language's words. A phrase that is frequent
in all is so frequent in one shard at least. A shard is no task: its phrases
are counted by many tasks and summed by key, those of two words first, longer
ones only where the pairs inside them are frequent in their shard. What is
frequent in any shard is united, less what cannot reach the support in all by
its local counts, and one more pass counts these phrases exactly over
everything.

In the mining passes a phrase is a 64-bit hash, and sets of phrases are bitmaps
sized by their counts up to ``MAX_BITS``. Two phrases that fall together can
only add candidates, never lose one; the last pass counts words themselves.

Scores: every cut of a phrase in two parts compares it with what the parts
have in common; the weakest cut counts. Numbers are exact (decimals of 38
digits). A phrase inside one longer by a word that has most of its count is
dropped. Of each language the best are kept by two rounds of ranking, so that
no task ranks a whole language.

Defined results: a null text counts as "", a null language as ``und``; repeated
rows count as often as they come; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, stored, worker_memory
from .shingles import mix

#: Shards of a corpus: the support of a shard is a share of the whole one, so few shards keep it telling.
SHARDS = 5
LONGEST = 4
SUPPORT = 30
UNKNOWN = "und"
#: Bits of a set of phrases: 16 for each up to the largest table (64 MB); beyond that tables fill and prune less.
MIN_BITS, MAX_BITS = 20, 29
SHIFTS = (0, 17, 35)
#: Bytes of text of one part taken at once and of all that wait for more, and entries a task sums before it passes them on.
SLICE = 2 << 20
WAITING = 24 << 20
PENDING = 1 << 22
#: Phrases of a bucket in the last count, and lists of a batch.
BUCKET = 20_000
LISTS = 64
#: Ends of pieces become a word of their own, A-Z fall.
_MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(_MARKS + bytes(range(65, 91)), b"." * len(_MARKS) + bytes(range(97, 123)))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = np.uint64(0xBF58476D1CE4E5B9)


class Words:
    """The words of some texts as numbers; 0 is the end of a piece. Known words are kept while a task runs.

    Words are parted, told apart and looked up as Arrow columns; Python meets a word once, when its bytes or hash are asked for.
    """

    def __init__(self) -> None:
        self.clear()

    def __len__(self) -> int:
        return len(self.known)

    def clear(self) -> None:
        self.known = pa.array(["."], pa.large_string())
        self.word: list[bytes] = [b"."]
        self.hashes = np.zeros(1, np.uint64)
        self.marked: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def read(self, texts: list[bytes]) -> np.ndarray:
        whole = b".".join([b"", *texts, b""]).translate(_FOLD).replace(b".", b" . ").strip()
        column = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(whole)], np.int64)), pa.py_buffer(whole)])
        words = pc.ascii_split_whitespace(column).flatten().dictionary_encode()
        found = pc.index_in(words.dictionary, value_set=self.known)
        number = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            number[number < 0] = np.arange(len(self), len(self) + found.null_count)
            self.known = pa.concat_arrays([self.known, words.dictionary.filter(found.is_null())])
        return number[words.indices.to_numpy(zero_copy_only=False)]

    def _complete(self) -> None:
        new = self.known[len(self.word) :].cast(pa.large_binary()).to_pylist()
        if new:
            self.word += new
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])

    def frequent(self, lang: str, good: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Per known word its hash in a language, and whether it is one of ``good``; worked out once per word."""
        self._complete()
        h, ok = self.marked.get(lang, (np.zeros(0, np.uint64), np.zeros(0, bool)))
        if len(h) < len(self):
            new = mix(self.hashes[len(h) :] ^ _lang_seed(lang))
            h, ok = np.concatenate([h, new]), np.concatenate([ok, good.has(new)])
            ok[0] = False
            self.marked[lang] = h, ok
        return h, ok


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two parts behind each other; the order counts."""
    return mix((left + _STEP) * _MULTIPLY ^ right)


class Bits:
    """A set of 64-bit hashes as a bitmap, in which each has three places: its bits from ``SHIFTS`` on."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.shift = np.uint64(64 - (len(table) * 64).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for left in SHIFTS:
            live = np.flatnonzero(out)
            at = (hashes[live] << np.uint64(left)) >> self.shift
            out[live] = (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of column ``hash``; the driver sees the table alone, whose size is bounded."""
    bits = min(MAX_BITS, max(MIN_BITS, (16 * hashes.count()).bit_length()))
    places = F.explode(F.array(*[F.shiftrightunsigned(F.shiftleft("hash", left), 64 - bits) for left in SHIFTS]))
    words = hashes.select(places.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("w")
    )
    got = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("i").to_numpy()] = got.column("w").to_numpy().view(np.uint64)
    return table


class Sums:
    """Counts by (part, hash), summed in a task before they are passed on."""

    def __init__(self) -> None:
        self.parts, self.hashes, self.size = [], [], 0

    def add(self, part: int, hashes: np.ndarray) -> None:
        if len(hashes):
            self.parts.append((part, len(hashes)))
            self.hashes.append(hashes)
            self.size += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[np.ndarray]] = {}
        for (part, _), h in zip(self.parts, self.hashes, strict=True):
            by_part.setdefault(part, []).append(h)
        self.parts, self.hashes, self.size = [], [], 0
        for part, h in by_part.items():
            h, n = np.unique(np.concatenate(h), return_counts=True)
            for at in range(0, len(h), 1 << 16):
                k = h[at : at + (1 << 16)]
                cols = [pa.array(np.full(len(k), part, np.int64)), pa.array(k.view(np.int64)), pa.array(n[at : at + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(cols, ["part", "hash", "n"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """lang, part and texts of one part at a time: about ``SLICE`` bytes of it, or the largest when all together exceed ``WAITING``."""
    held: dict[tuple[str, int], list] = {}
    waiting = 0
    for batch in batches:
        columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
        for lang, part, text in zip(*columns, strict=True):
            text = text or b""
            group = held.setdefault((lang, part), [0])
            group[0] += len(text) + 50
            waiting += len(text) + 50
            group.append(text)
            if group[0] > SLICE or waiting > WAITING:
                key = (lang, part) if group[0] > SLICE else max(held, key=lambda k: held[k][0])
                size, *texts = held.pop(key)
                waiting -= size
                yield *key, texts
    for key, (_, *texts) in held.items():
        yield *key, texts


def dealt(docs: DataFrame, shards: int) -> DataFrame:
    """lang, part (of a shard and a language), text."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    shard = bucket_of(shards, "__id")
    return docs.select(F.col("doc_id").alias("__id"), lang.alias("lang"), F.col("text").cast("string").alias("text")).select(
        "lang", F.xxhash64("lang", shard).alias("part"), "text"
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, part, phrase (one word), n per task; phrase null for all words of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("collocations")
        words, sums = Words(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, part), total in sums.items():
                at = np.flatnonzero(total)
                n = total[at]
                for i in range(0, len(at), 1 << 15):
                    some = at[i : i + (1 << 15)]
                    m = len(some)
                    text = words.known.take(pa.array(some, mask=some == 0)).cast(pa.string())
                    cols = [pa.array([lang] * m), pa.array([part] * m, pa.int64()), text, pa.array(n[i : i + m])]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "part", "phrase", "n"])
            sums.clear()
            words.clear()

        for lang, part, texts in _groups(batches):
            ids = words.read(texts)
            c = np.bincount(ids, minlength=len(words))
            c[0] = len(ids) - c[0]  # all words, in place of the ends of pieces
            old = sums.get((lang, part))
            if old is not None:
                c[: len(old)] += old
            sums[lang, part] = c
            if len(words) * len(sums) > PENDING:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, part long, phrase string, n long")


def _lang_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _part_seed(part: int) -> np.uint64:
    return mix(np.array([part], np.int64).view(np.uint64) + _STEP)[0]


def _word_hashes(frequent: DataFrame) -> DataFrame:
    """Column ``hash`` of the words of each language, as the workers compute it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seeds = {x: _lang_seed(x) for x in set(langs)}
            h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in texts), np.uint64, len(texts))
            h = mix(h ^ np.array([seeds[x] for x in langs], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["hash"])

    return frequent.select("lang", "phrase").mapInArrow(run, "hash long")


def _starts(ok: np.ndarray, n: int) -> np.ndarray:
    """Places from which ``n`` entries of ``ok`` in a row hold."""
    out = ok[: len(ok) - n + 1].copy() if len(ok) >= n else ok[:0]
    for k in range(1, n):
        out &= ok[k : k + len(out)]
    return np.flatnonzero(out)


def local_counts(rows: DataFrame, words: np.ndarray, pairs: np.ndarray | None, longest: int) -> DataFrame:
    """part, hash, n of the phrases in each shard: pairs of frequent words, or longer ones of locally frequent pairs."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("collocations")
        known, sums = Words(), Sums()
        good, two = (t if t is None else Bits(t) for t in shared.value)
        for lang, part, texts in _groups(batches):
            ids = known.read(texts)
            h, ok = known.frequent(lang, good)
            h, ok = h[ids], ok[ids]
            at = _starts(ok, 2)
            pair = joined(h[at], h[at + 1])
            if two is None:
                sums.add(part, pair)
            else:
                first = np.zeros(len(h), bool)
                first[at[two.has(pair ^ _part_seed(part))]] = True
                whole = np.zeros(len(h), np.uint64)
                whole[at] = pair
                for n in range(3, longest + 1):
                    at = _starts(first, n - 1)
                    whole[at] = joined(whole[at], h[at + n - 1])
                    sums.add(part, whole[at])
            if sums.size > PENDING:
                yield from sums.flush()
            if len(known) > PENDING // 8:
                known.clear()
        yield from sums.flush()

    return rows.mapInArrow(run, "part long, hash long, n long")


def locally_frequent(counts: DataFrame, supports: DataFrame) -> DataFrame:
    """part, hash, n, need, room of what is frequent in its part."""
    sums = counts.groupBy("part", "hash").agg(F.sum("n").alias("n"))
    return sums.join(supports, "part").where("n >= need")


def candidates(local: DataFrame, support: int) -> DataFrame:
    """Column ``hash`` of the phrases that can have the support in all.

    Where a phrase is not frequent in a part, it has less than the part's
    support there; so its count is at most what the parts in which it is
    frequent have, and one less than the support of each other part.
    """
    most = F.sum((F.col("n") - F.col("need") + 1).cast("decimal(20,0)")) + F.max("room")
    return local.groupBy("hash").agg(most.alias("most")).where(F.col("most") >= support).select("hash")


def _part_hashes(found: DataFrame) -> DataFrame:
    """Column ``hash``: phrase and part in one, as the workers compute it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, h = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array((h ^ mix(part + _STEP)).view(np.int64))], ["hash"])

    return found.mapInArrow(run, "hash long")


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of pairs of numbers: equal if and only if the pairs are."""
    width = int(second.max()) + 1 if len(second) else 1
    return np.unique(first * width + second, return_inverse=True)[1]


def candidate_counts(rows: DataFrame, words: np.ndarray, wanted: np.ndarray, longest: int, support: int, buckets: int) -> DataFrame:
    """lang, phrase, f of all candidates that have the support, told apart by their words.

    A task passes its counts on in lists, one for each bucket of phrases; a
    bucket is summed as its lists come in, and holds no more than its phrases.
    """
    shared = rows.sparkSession.sparkContext.broadcast((words, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("collocations")
        known = Words()
        good, likely = map(Bits, shared.value)
        sums: dict[str, dict[bytes, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                dealt: dict[int, tuple[list[bytes], list[int]]] = {}
                for phrase, n in total.items():
                    phrases, counts = dealt.setdefault(xxhash.xxh3_64_intdigest(phrase) % buckets, ([], []))
                    phrases.append(phrase)
                    counts.append(n)
                lists = list(dealt.values())
                cols = [pa.array([lang] * len(lists)), pa.array(list(dealt), pa.int32())]
                cols += [pa.array([p for p, _ in lists], pa.list_(pa.binary())), pa.array([n for _, n in lists], pa.list_(pa.int64()))]
                batch = pa.RecordBatch.from_arrays(cols, ["lang", "bucket", "phrases", "counts"])
                for at in range(0, len(lists), LISTS):
                    yield batch.slice(at, LISTS)
            sums.clear()

        for lang, _, texts in _groups(batches):
            ids = known.read(texts)
            h, ok = known.frequent(lang, good)
            h, ok = h[ids], ok[ids]
            total = sums.setdefault(lang, {})
            live, whole, exact = ok, h, ids
            for n in range(2, longest + 1):
                at = np.flatnonzero(live[: max(len(ids) - n + 1, 0)])
                at = at[ok[at + n - 1]]
                whole_at = joined(whole[at], h[at + n - 1])
                hit = likely.has(whole_at)
                at, whole_at = at[hit], whole_at[hit]
                number = _ranks(exact[at], ids[at + n - 1])
                _, where, times = np.unique(number, return_index=True, return_counts=True)
                for i, k in zip(at[where].tolist(), times.tolist(), strict=True):
                    phrase = b" ".join([known.word[w] for w in ids[i : i + n].tolist()])
                    total[phrase] = total.get(phrase, 0) + k
                # A longer candidate starts with a shorter one.
                live, whole, exact = np.zeros(len(ids), bool), np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.int64)
                live[at], whole[at], exact[at] = True, whole_at, number
            if sum(map(len, sums.values())) > PENDING // 16:
                yield from flush()
            if len(known) > PENDING // 8:
                known.clear()
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("collocations")
        sums: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for lang, phrases, counts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                total = sums.setdefault(lang, {})
                for phrase, n in zip(phrases, counts, strict=True):
                    total[phrase] = total.get(phrase, 0) + n
        for lang, total in sums.items():
            found = [(p.decode(), n) for p, n in total.items() if n >= support]
            cols = [pa.array([lang] * len(found), pa.string()), pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "f"])

    lists = rows.mapInArrow(run, "lang string, bucket int, phrases array<binary>, counts array<bigint>")
    return lists.repartition(buckets, "lang", "bucket").mapInArrow(add, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to ``longest`` words with ``support``, and (lang, n) with the words of each language."""
    rows = dealt(docs, shards)
    counted = stored(word_counts(rows).groupBy("lang", "part", "phrase").agg(F.sum("n").alias("n")))
    parts = stored(counted.where("phrase IS NULL").select("lang", "part", "n"))
    totals = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    # need: support * words of the part / words of the language, rounded up; room: one less, summed over the language's parts.
    wide = "decimal(20,0)"
    shares = parts.join(totals.select("lang", F.col("n").cast(wide).alias("total")), "lang")
    needs = shares.select("lang", "part", F.greatest(F.expr("CAST((CAST(n AS DECIMAL(20,0)) * %d + total - 1) DIV total AS BIGINT)" % support), F.lit(1)).alias("need"))
    rooms = needs.groupBy("lang").agg(F.sum(F.col("need") - 1).alias("room"))
    supports = stored(needs.join(rooms, "lang").groupBy("part").agg(F.min("need").alias("need"), F.max("room").alias("room")))
    words = stored(counted.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support))
    good = bitmap(_word_hashes(words))
    pairs = stored(locally_frequent(local_counts(rows, good, None, 2), supports))
    likely = stored(candidates(pairs, support))
    inside = pairs.join(likely, "hash", "left_semi").select("part", "hash")
    longer = stored(locally_frequent(local_counts(rows, good, bitmap(_part_hashes(inside)), longest), supports))
    wanted = stored(likely.unionByName(candidates(longer, support)).distinct())
    exact = candidate_counts(rows, good, bitmap(wanted), longest, support, wanted.count() // BUCKET + 32)
    every = words.unionByName(exact).withColumn("size", F.size(F.split("phrase", " ", -1)))
    return stored(every.select("lang", "phrase", "size", "f")), totals


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of all phrases of two words or more, by their weakest cut."""
    words = F.split("phrase", " ", -1)
    cuts = phrases.where("size > 1").withColumn("__w", words).withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    head, tail = F.expr("array_join(slice(__w, 1, k), ' ')"), F.expr("array_join(slice(__w, k + 1, size - k), ' ')")
    cuts = cuts.select("lang", "phrase", "size", F.col("f").alias("a"), "k", head.alias("__head"), tail.alias("__tail"))
    left = phrases.select("lang", F.col("phrase").alias("__head"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("__tail"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "__head"]).join(right, ["lang", "__tail"])
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    best = both.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")


def outside_longer(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """Phrases without those inside a longer one that has ``percent`` of their count.

    One word more is enough: what is inside a longer phrase is inside one of
    these, which has the longer one's count at least.
    """
    words = F.split("phrase", " ", -1)
    longer = phrases.where("size > 2").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))).alias("phrase"),
    )
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = "decimal(20,0)"
    keep = F.col("longer").isNull() | (F.lit(100) * F.col("longer").cast(wide) < F.lit(percent) * F.col("a").cast(wide))
    return phrases.join(most, ["lang", "phrase"], "left").where(keep).drop("longer")


def best_of_each(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each language with their rank; a language is ranked in blocks before the blocks' best are."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    blocks = rows.withColumn("__b", bucket_of(64, "phrase"))
    first = blocks.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__b").orderBy(*order))).where(F.col("rank") <= limit)
    every = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return every.where(F.col("rank") <= limit).drop("__b")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, limit: int = 2000, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    phrases, totals = frequent_phrases(docs, support, longest, shards)
    best = best_of_each(outside_longer(scored(phrases)), limit)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (SELECT lang, size, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
scores AS (SELECT c.*, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT) // (x.f + y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:size - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase
  FROM weakest WHERE size > 2),
kept AS (SELECT * FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = w.lang AND x.phrase = w.phrase AND 100 * x.a >= 80 * w.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
