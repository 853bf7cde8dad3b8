"""Periodic runs, exact deduplication and collocations against plain versions."""

import hashlib
import random

import numpy as np
import plain
import pytest
from conftest_rows import rows_of_documents

from textwarden.llm import collocations, exact_dedup, periodic_runs, queries

QUERIES = queries.queries()


# -- periodic runs


def _random_words(seed):
    r = random.Random(seed)
    words = [str(r.randrange(1 + seed % 4)) for _ in range(r.randrange(90))]
    for _ in range(r.randrange(4)):
        p, k = r.randrange(1, 9), r.randrange(2, 40)
        unit = [str(r.randrange(5)) for _ in range(p)]
        at = r.randrange(len(words) + 1)
        words[at:at] = (unit * k)[: r.randrange(p, p * k + 1)]
    return words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_words(least):
    for seed in range(250):
        words = _random_words(seed)
        codes = np.array([int(w) for w in words], np.int64)
        found = periodic_runs.find_runs(codes, least)
        assert found == plain.runs(words, least), words
        assert " ".join(w for w, d in zip(words, periodic_runs.dropped_words(len(words), found)) if not d) == plain.collapsed(words, found)


def test_suffix_order_and_common_prefixes():
    for seed in range(60):
        codes = np.array([int(w) for w in _random_words(seed)] + [99], np.int64)
        order, ranks = periodic_runs.suffix_order(codes)
        suffixes = [codes[i:].tolist() for i in range(len(codes))]
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: suffixes[i])
        want = [next(k for k in range(len(codes)) if a[k : k + 1] != b[k : k + 1]) for a, b in zip([suffixes[i] for i in order], [suffixes[i] for i in order[1:]])]
        assert periodic_runs.common_prefixes(order, ranks).tolist() == want


def test_run_of_a_very_long_text():
    codes = np.concatenate([np.arange(1000), np.tile(np.arange(7), 30_000), np.arange(1000)])
    assert (1000, 210_000 + 7, 7) in periodic_runs.find_runs(codes) or (1000, 210_007, 7) in periodic_runs.find_runs(codes)
    assert periodic_runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def _run_row(doc_id, text):
    words = plain.planted(doc_id, plain.re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = plain.runs(words)
    s, length, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (
        doc_id, len(found), s, length, q, None if q is None else 1000 * length // q,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain.collapsed(words, found).encode()).hexdigest(),
    )


def test_runs_on_hard_rows(spark, hard, nothing):
    rows = hard.where("doc_id IS NULL OR doc_id <> 40")
    more = [(d, " ".join(f"w{i}" for i in range(n)), None) for d, n in zip(range(1000, 1120), range(120))]
    more += [(2000, "a b c " * 20 + "x " * 30 + "a b c " * 3, None), (2001, "la " * 11, None), (2002, "la " * 12, None)]
    rows = rows.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
    found = periodic_runs.run_digest(periodic_runs.detect_runs(periodic_runs.planted(rows)))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted((_run_row(d, t) for d, t in rows_of_documents(rows)), key=key)
    assert periodic_runs.run_digest(periodic_runs.detect_runs(periodic_runs.planted(nothing))).count() == 0


def test_run_spans_and_text(spark):
    docs = spark.createDataFrame([(1, "x y a b a b a b a b a b a b z"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.detect_runs(docs).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(2, 12, 2)] and got[1]["collapsed"] == "x y a b z"
    assert got[2]["n_words"] == 0 and got[2]["runs"] == [] and got[2]["collapsed"] == ""


def test_runs_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, small).collect()}
    texts = dict(rows_of_documents(docs))
    assert set(got) == set(texts) and sum(r[1] > 0 for r in got.values()) > 5
    for d, t in texts.items():
        if len(t or "") < 4000:
            assert got[d] == _run_row(d, t)


# -- exact deduplication


def _groups(rows):
    norm = [(d, plain.lower(t)) for d, t in rows]
    out = []
    for d, t in norm:
        same = [e for e, u in norm if u == t]
        keep = max((e for e in same if e is not None), default=None)
        out.append((d, keep, len(same), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[4]))


@pytest.mark.parametrize("huge", [exact_dedup.HUGE, 200])
def test_dedup_on_hard_rows(spark, hard, nothing, huge, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COMPARED", 4096)
    rows = rows_of_documents(hard)
    assert _sorted(exact_dedup.deduplicate(hard, huge)) == _groups(rows)
    more = hard.select("doc_id", "text").unionByName(spark.createDataFrame([(60, "É" * 90_000), (61, "é" * 90_000), (62, "É" * 90_000), (63, "x" * 300_000), (64, "X" * 300_000)], "doc_id long, text string"))
    assert _sorted(exact_dedup.deduplicate(more, huge)) == _groups(rows_of_documents(more))
    assert exact_dedup.deduplicate(nothing, huge).count() == 0


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COMPARED", 2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abcd", "dcba", "abdc", "ABCD", "dcba", "x", "abcd", "abdc", "bacd"] * 3)], "doc_id long, text string").repartition(5)
    for huge in (exact_dedup.HUGE, 2):
        for bases in (exact_dedup.BASES, (1, 1)):  # with the latter, anagrams fall together
            assert _sorted(exact_dedup.deduplicate(docs, huge, bases)) == _groups(rows_of_documents(docs)), (huge, bases)


def test_shuffle_join_of_fingerprints(spark, hard, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert _sorted(exact_dedup.deduplicate(hard)) == _groups(rows_of_documents(hard))


def test_fingerprints_compose():
    table, r = exact_dedup.powers(), random.Random(1)
    for n in (0, 1, 5, exact_dedup.CHUNK - 1, exact_dedup.CHUNK, 3 * exact_dedup.CHUNK + 17, 70 * exact_dedup.CHUNK + 1):
        body = r.randbytes(n)
        value = exact_dedup.fingerprint(body, table)
        for k in (0, n // 3, n):
            assert exact_dedup.combine(exact_dedup.fingerprint(body[:k], table), exact_dedup.fingerprint(body[k:], table), n - k) == value
        if n < 100:
            want = tuple(sum(b * pow(base, n - 1 - i, p) for i, b in enumerate(body)) % p for base, p in zip(exact_dedup.BASES, exact_dedup.PRIMES))
            assert value == want


# -- collocations


def _phrases(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def _language(seed):
    r = random.Random(seed)
    fixed = ["strong tea", "New York city", "as a matter of fact", "new york"]
    rows = []
    for i in range(120):
        words = [r.choice(fixed) if r.random() < 0.2 else f"w{int(r.expovariate(0.2))}" + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(60)]
        rows.append((i if i % 7 else None, " ".join(words), [None, "en", "de", "und"][i % 4]))
    return rows


@pytest.mark.parametrize("support,longest,limit,shards", [(30, 4, 2000, 5), (7, 4, 50, 3), (3, 3, 2000, 8), (2, 5, 100, 1)])
def test_collocations(spark, support, longest, limit, shards):
    rows = _language(support)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, phrase int").repartition(6)
    got = _phrases(collocations.collocations(docs, support, longest, limit, shards))
    assert got == plain.collocations([(lang, t) for _, t, lang in rows], support, longest, limit) and len(got) > 20


def test_collocations_on_hard_rows(spark, hard, nothing, monkeypatch):
    from pyspark.sql import functions as F

    docs = hard.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en"))
    want = plain.collocations([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()])
    assert _phrases(collocations.collocations(docs)) == want and want
    for name in ("SLICE", "WAITING", "PENDING", "MAX_BITS"):
        monkeypatch.setattr(collocations, name, 20)  # full tables and small portions change no result
    assert _phrases(collocations.collocations(docs)) == want
    assert collocations.collocations(nothing.withColumn("lang", F.lit("en"))).count() == 0


# -- filters by ids


def test_rows_without_ids_by_broadcast_and_by_shuffle(spark, hard, monkeypatch):
    from textwarden.llm import common, ngram_join

    ids = spark.createDataFrame([(20,), (20,), (31,), (None,), (999,)], "gone long")
    want = sorted(str(r) for r in hard.where("doc_id IS NULL OR doc_id NOT IN (20, 31)").collect())
    kept = sorted(str(r) for r in ngram_join.one_per_component(hard).collect())
    for limit in (common.BROADCAST_IDS, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", limit)
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", limit)
        assert sorted(str(r) for r in common.without(hard, ids).collect()) == want
    assert sorted(str(r) for r in ngram_join.one_per_component(hard).collect()) == kept


def test_worker_memory_is_given_back():
    from textwarden.llm import common

    first = common.worker_memory("one")
    first["x"] = 1
    assert common.worker_memory("one") is first
    common.fresh_worker()
    assert first == {} and common.worker_memory("one") == {}


def test_words_are_looked_up_once():
    asked = []

    class All:
        def has(self, hashes):
            asked.append(len(hashes))
            return np.ones(len(hashes), bool)

    words = collocations.Words()
    texts = [["One two\tthree. two", "", "é日本 one!"], ["one FOUR\vtwo  ", "  "], ["..", "é日本"]]
    for group in texts:
        ids = words.read([t.encode() for t in group])
        hashes, ok = words.frequent("en", All())
        plain = b".".join([b"", *[t.encode() for t in group], b""]).translate(collocations._FOLD).replace(b".", b" . ").split()
        assert [words.word[i] for i in ids.tolist()] == plain and len(words) == len(set(words.word)) == len(hashes)
        assert not ok[0] and ok[1:].all()
    assert asked == [5, 1] and words.word == [b".", b"one", b"two", b"three", "é日本".encode(), b"four"]
    words.clear()
    assert len(words) == 1 and words.read([b"two"]).tolist() == [0, 1, 0]
