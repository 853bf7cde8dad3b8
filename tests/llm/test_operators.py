"""Corpus operators against plain versions, on hard rows, empty tables and the smallest given tables."""

import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import oracle
import plain
import pytest
from conftest_rows import rows_of_documents
from pyspark.sql import functions as F

from textwarden.llm import decontaminate, host_quality, licenses, ngram_join, packing, queries, rans, shards, tokenids, tokens, toxicity, url_rules, warc

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, name):
    assert oracle.compare(QUERIES[name](spark, small), oracle.connect(small), ORACLES[name]) is None


# -- shards


def _check_shards(rows, texts, n):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(n)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, (len(t.encode()) if t is not None else 0) + 8, zlib.crc32((t or "").encode())) for d, t in texts
    )


def test_shards(spark, hard, nothing, small):
    _check_shards(shards.shard_documents(hard, 4).collect(), rows_of_documents(hard), 4)
    assert shards.shard_documents(nothing).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = shards.shard_documents(docs).collect()
    texts = dict(rows_of_documents(docs))
    _check_shards(got, texts.items(), 24)
    where = {}
    for r in got:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    copies = Counter(texts.values())
    assert all(len(where[t]) == 1 for t, n in copies.items() if 1 < n <= 4)


def test_shards_split_a_hot_group(spark):
    docs = spark.createDataFrame([(i, "copy" if i % 3 == 0 else f"text {i // 2 if i % 5 == 0 else i}") for i in range(600)], "doc_id long, text string")
    got = shards.shard_documents(docs, 12).collect()
    _check_shards(got, rows_of_documents(docs), 12)
    assert len({r["shard"] for r in got if r["doc_id"] % 3 == 0}) <= 8


def test_shards_of_copies_only(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(200)], "doc_id long, text string")
    _check_shards(shards.shard_documents(docs, 8).collect(), rows_of_documents(docs), 8)


# -- licences


def test_licenses(hard, nothing, spark):
    def base(text):
        words, out = plain.plain_words(text), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        return len(words), len(out), min((i for i, _ in out), default=None), max((i for i, _ in out), default=None), ",".join(sorted({x for _, x in out}))

    more = spark.createDataFrame(
        [
            (1, "x Licensed under the Apache License, Version 2.0. y under the MIT license cc-by-nc under under the mit license"),
            (2, "This work is licensed under the GNU General Public License, version 3."),
            (3, "the gnu is a public animal; version 3 of the text has no license"),
            (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files"),
            (5, "under the mit" + " filler" * 5000 + " license"),
        ],
        "doc_id long, text string",
    )
    for docs in (hard, more):
        texts = Counter()
        for d, t in rows_of_documents(docs):
            texts[(d, *base(t))] += 1
        got = licenses.scan_licenses(docs).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == texts
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels == {1: "apache-2,cc-by-nc,mit", 2: "gpl-3", 3: "", 4: "mit", 5: ""}
    assert licenses.scan_licenses(nothing).count() == 0


def test_licenses_all_in_one_text():
    index = licenses.build_index()
    filler = " ".join(f"filler{i}" for i in range(30))
    texts = [f" {filler} ".join(wording for label, wording, _ in licenses.TEMPLATES if label in labels) for labels in (
        {"bsd", "gpl-3"}, {"mit", "gpl-3", "cc-by-sa"}, {"bsd", "mpl-2", "gpl-2"}, {label for label, _, _ in licenses.TEMPLATES})]
    words = [licenses.words_of(t) for t in texts]
    idf = {w: -float(sum(w in licenses.words_of(t[1]) for t in licenses.TEMPLATES)) for w in index.postings}
    found = [licenses.scan(w, index, idf) for w in words]
    assert found[0].keys() >= {"bsd", "gpl-3"} and found[1].keys() >= {"mit", "gpl-3", "cc-by-sa"} and found[2].keys() >= {"bsd", "mpl-2", "gpl-2"}
    assert found[3] == {label: 1.0 for label, _, _ in licenses.TEMPLATES}
    # A long text that holds every incidental word of the index.
    incidental = sorted(w.decode() for w in index.postings) * 20
    assert licenses.scan(licenses.words_of(" ".join(incidental) + filler + " licensed under cc by sa 4 0"), index, idf).get("cc-by-sa") == 1.0


def test_licenses_as_votes_of_all_words():
    import random

    rnd, index = random.Random(6), licenses.build_index()
    idf = {w: rnd.random() for w in index.postings}
    for _ in range(300):
        words = []
        for _ in range(rnd.randrange(1, 8)):
            some = licenses.words_of(rnd.choice(licenses.TEMPLATES)[1])
            for _ in range(rnd.randrange(4)):  # words left out, put in or exchanged
                k = rnd.randrange(len(some))
                some[k : k + rnd.randrange(2)] = rnd.choice([[], [b"x"], [rnd.choice(list(index.postings))]])
            words += some + [b"y"] * rnd.randrange(5)
        votes = {}
        for place, w in enumerate(words):
            for t, q in index.postings.get(w, ()):
                votes.setdefault((t, place - q), set()).add(w)
        want = {}
        for (t, start), agreed in votes.items():
            template = index.templates[t]
            if len(agreed) >= 2 and all(
                any(words[k : k + len(key)] == key for k in range(max(0, start + at - licenses.SLACK), start + at + licenses.SLACK + 1))
                for at, key in template.phrases
            ):
                want[template.label] = max(want.get(template.label, 0.0), licenses._in_order(words, start, template))
        assert licenses.scan(words, index, idf) == want


def test_licenses_that_do_not_match_cost_nothing():
    import time

    words = licenses.words_of(" ".join(f"filler{i % 900} the license of this software" for i in range(2000)) + " licensed under cc by sa 4 0")
    more = [(f"x{i}", " ".join(f"own{i}word{k} the license of this software" for k in range(200)), (f"own{i}word7 the license", f"own{i}word9 the")) for i in range(500)]

    def seconds(templates):
        index = licenses.build_index(templates)
        anchors = licenses.anchored(index, {})
        begun = time.perf_counter()
        for _ in range(20):
            assert licenses.scan(words, index, {}, anchors) == {"cc-by-sa": 1.0}
        return time.perf_counter() - begun

    few, many = (min(seconds(t) for _ in range(3)) for t in (licenses.TEMPLATES, (*licenses.TEMPLATES, *more)))
    assert many < 2 * few + 0.02


# -- token files


def test_range_coder_round_trip():
    rng = np.random.default_rng(5)
    for n in (1, 2, 1023, 1024, 1025, 300_000):
        ids = (rng.zipf(1.4, n) % 50_257).astype(np.uint32)
        model = rans.Model(rans.quantise(np.bincount(ids)))
        assert int(model.freq.sum()) == 1 << rans.SCALE
        block = rans.encode(ids, model, [(None, 1), (7, n - 1)])
        assert np.array_equal(rans.decode(block, model), ids)
        k = rans.checkpoints(block)
        assert np.array_equal(np.concatenate([rans.decode(block, model, i, i + 1) for i in range(k)]), ids)
        assert rans.documents(block) == [(None, 1), (7, n - 1)]
    broken = bytearray(block)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(broken), model)


def test_token_files(hard, nothing, spark, small):
    for docs in (hard, spark.read.parquet(f"{small}/documents.parquet")):
        texts = [(d, plain.ids_of(t)) for d, t in rows_of_documents(docs)]
        texts.sort(key=lambda x: (x[0] is not None, x[0] or 0, plain.crc(x[1]), len(x[1])))
        want, at = [], 0
        for d, ids in texts:
            want.append((d, at, len(ids), plain.crc(ids)))
            at += len(ids)
        got = sorted((tuple(r) for r in tokenids.token_digest(docs).collect()), key=lambda r: r[1])
        assert got == want
    assert tokenids.token_digest(nothing).count() == 0


SHREDS = ["alpha", "Beta", "é", "ß", "ɏ", "ɐ", "×", "÷", "日本", " ", " ", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", "\xa0", "\u2003"]
SHREDS += ["\u3000", "\x85", "\x1c", "\0", ".", ",", "%%%", "'s", "'", "’", "—", "²", "12", "_", "a1b2", "<|endoftext|>", "e\u0301", "\u200d", "😀"]


def test_parts_give_the_ids_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(5)
    for size in (10, 300, 4_000_000):
        monkeypatch.setattr(tokens, "SLICE", size)
        texts = [None, "", *("".join(rng.choice(SHREDS, rng.integers(1, 12))) for _ in range(1000))]
        want = [np.array(plain.ids_of(t), "<u4").tobytes() for t in texts]
        for remembered in (40, tokens.REMEMBERED):
            assert tokens.encode(texts, tokens.default_vocabulary(), remembered) == want


def test_known_words_with_other_marks_are_not_encoded_again(monkeypatch):
    path, asked, encode = tokens.default_vocabulary(), [], tokens._encode
    tokens.encode(["alpha beta. gamma\ndelta %%% gamma%%%", "beta delta"], path)
    monkeypatch.setattr(tokens, "_encode", lambda tok, texts: asked.extend(texts) or encode(tok, texts))
    got = tokens.encode(["alpha beta%%% gamma.\ndelta", "alpha delta%%%\ndelta."], path)
    assert got == [np.array(plain.ids_of(t), "<u4").tobytes() for t in ("alpha beta%%% gamma.\ndelta", "alpha delta%%%\ndelta.")]
    assert not asked


# -- packing


def _check_pieces(got, texts, size):
    want = Counter()
    for d, t in texts:
        ids = plain.ids_of(t)
        first = len(ids) % size or min(len(ids), size)
        at = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            want[d, k, a, b - a, plain.crc(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return bins


def test_packing(hard, nothing, spark, small):
    _check_pieces(packing.pack(hard, size=64, group=50).collect(), rows_of_documents(hard), 64)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bins = _check_pieces(packing.pack(docs).collect(), rows_of_documents(docs), 2048)
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= -(-total // 2048) + 2
    assert packing.pack(nothing).count() == 0


def test_local_search_empties_bins():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(300, 1100, 3000))[::-1]
    first = packing.best_fit(lengths, 2048)
    better = packing.local_search(lengths, first, 2048)
    assert sorted(i for b in better for i in b) == list(range(3000))
    assert max(int(lengths[b].sum()) for b in better) <= 2048
    assert len(better) < len(first)


# -- n-gram Jaccard join


def test_ngram_join(hard, nothing, spark, small):
    for docs, n, s in ((hard, 4, Fraction(85, 100)), (hard, 5, Fraction(4, 5)), (spark.read.parquet(f"{small}/documents.parquet"), 4, Fraction(85, 100))):
        rows = rows_of_documents(docs)
        want = plain.components([r for r in rows if r[0] is not None], n, s.numerator, s.denominator)
        got = ngram_join.jaccard_components(docs, n, s).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
        assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_ngram_join_chains_and_common_passages(spark):
    import random

    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows, at = [], 0
    for _ in range(30):  # chains: each text differs a little from the one before
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 80, 200]))]
        for _ in range(6):
            rows.append((at, " ".join(words)))
            at += 1
            words = list(words)
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    for k in range(40):  # a passage that many texts share, with short and long rests
        rest = [rnd.choice(vocabulary) for _ in range(k // 2)]
        rows.append((at, " ".join(passage + rest)))
        at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = plain.components(rows, 4, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, 4, Fraction(85, 100)).collect()}
    assert got == want


def test_prefixes_hold_enough_common_shingles():
    rng = np.random.default_rng(2)
    levels = rng.integers(0, 30, 1 << 22).astype(np.uint8)
    s = Fraction(4, 5)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[: n - n // 12], rng.integers(0, 2**63, n // 12).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        common = len(np.intersect1d(x, y))
        if common * 5 < 4 * (len(x) + len(y) - common):
            continue
        (p, k), (q, m) = (ngram_join.prefix_of(v, levels, 8.0, s) for v in (x, y))
        assert len(np.intersect1d(p, q)) >= min(k, m)


# -- toxicity


def test_toxicity_on_held_out_rows(spark):
    from textwarden.llm.common import read

    sf = "/root/testdata/sf0.1"
    got = toxicity.judge(read(spark, sf, "documents"), read(spark, sf, "labels")).where("held_out").join(read(spark, sf, "labels"), "doc_id")
    table = {(r["toxic"], r["predicted"]): r["n"] for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    found, missed, wrong, right = (table.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert found / (found + missed) > 0.7 and right / (wrong + right) > 0.97


def test_toxicity_hard_rows(spark, hard, nothing):
    labels = spark.createDataFrame([(20, 1), (1, 0), (2, 0), (20, None), (None, 1), (21, 1)], "doc_id long, toxic int")
    got = toxicity.judge(hard, labels).collect()
    assert len(got) == hard.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["score"] == 0 for r in toxicity.judge(hard, labels.where("false")).collect())
    assert toxicity.judge(nothing, labels).count() == 0
    assert toxicity.keep_clean(hard, labels).columns == hard.columns


def test_rare_and_short_insults_are_learned():
    import random

    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvw") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]
    rows = []
    for i in range(6000):
        words = rnd.sample(vocabulary, 30)
        if i < 3000:
            words.append("zymurgoid" if i < 40 else "zyx" if i < 80 else "zebrazoid")
        rows.append((int(i < 3000), words))
    machine = toxicity.fit(rows)
    scores = machine.scores(machine.values(["zymurgoid", "zyx", "zebrazoid", *vocabulary]))
    assert scores[:3].min() >= 0.5 and (scores[3:] >= 0.5).mean() < 0.01


def test_gapped_insults_stay_close():
    near = toxicity.kernel(["stuupid", "stuxpid", "stupid", "harmless"], ["stupid"])[:, 0]
    assert near[2] == pytest.approx(1) and near[0] > 0.4 and near[1] > 0.3 and near[3] < 0.05
    assert toxicity.letters("St-u*pid!") == "stupid" and "s t u p i d" in toxicity.tokens_of("you s t u p i d one")
    kernel = toxicity.kernel(["banana", "inininin"], ["banana", "inininin"])
    codes = [next(iter(toxicity._by_length([w])))[1:] for w in ("banana", "inininin")]
    assert kernel[0, 0] == pytest.approx(1) and all(toxicity.self_kernel(c, w)[0] > w @ w for c, w in codes)


# -- benchmark decontamination


def test_decontamination(spark, hard, nothing, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    got = {tuple(r) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == plain.leaks(rows_of_documents(docs), [tuple(r) for r in items.select("item_id", "text").collect()])
    texts = dict(rows_of_documents(hard))
    words = texts[40].split()
    passage = words[20_000:20_060]
    rows = [(1, " ".join(passage)), (2, " ".join([*passage[:30], "new", *passage[30:]]).upper()), (3, "one two"), (4, None), (5, "!"), (6, "nowhere to be found at all in any text"), (1, " ".join(passage)), (None, "one"), (7, " ".join(words[100:2000]))]
    items = spark.createDataFrame(rows, "item_id long, text string")
    want = plain.leaks([r for r in rows_of_documents(hard) if r[0] is not None], [r for r in dict(rows).items() if r[0] is not None])
    assert {(40, 1), (40, 2), (35, 3), (40, 7)} <= {(d, i) for d, i, _, _ in want}
    assert sorted(tuple(r) for r in decontaminate.contained_items(hard, items).collect()) == sorted(want)
    assert decontaminate.contained_items(nothing, items).count() == 0 and decontaminate.contained_items(hard, items.where("false")).count() == 0
    assert decontaminate.decontaminated(hard, items).columns == hard.columns


def test_decontamination_joins_when_items_are_many(spark, hard, monkeypatch):
    words = dict(rows_of_documents(hard))[40].split()
    items = spark.createDataFrame([(i, " ".join(words[300 * i : 300 * i + 10 + 3 * i])) for i in range(20)], "item_id long, text string")
    inside = {tuple(r) for r in decontaminate.contained_items(hard, items).collect()}
    monkeypatch.setattr(decontaminate, "INSIDE", 0)
    assert {tuple(r) for r in decontaminate.contained_items(hard, items).collect()} == inside and len(inside) >= 20


def test_decontamination_finds_every_small_item(spark):
    words = [f"w{i}" for i in range(12_000)]
    items, want = [], set()
    for i in range(1200):  # unbroken items of 1 to 8 shingles
        n = 1 + i % 3 if i < 1000 else 1 + i % 8
        items.append((i, " ".join(words[9 * i : 9 * i + n + 4])))
        want.add((1, i, n, n))
    for i in range(1200, 1300):  # 4 of 5 and 7 of 8 shingles stand in the text, far from one another
        n = 5 if i % 2 else 8
        own = [f"x{i}y{k}" for k in range(n + 4)]
        items.append((i, " ".join(own)))
        words += [w for k in range(n - 1) for w in [*own[k + i % 2 : k + i % 2 + 5], *(f"far{i}k{k}j{j}" for j in range(40))]]
        want.add((1, i, n, n - 1))
    items.append((1300, " ".join([*words[:8], "new"])))  # 4 of 5
    items.append((1301, " ".join([*words[:7], "new", "end"])))  # 3 of 5
    want.add((1, 1300, 5, 4))
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2 w3 w4")], "doc_id long, text string")
    got = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


# -- url rules


def test_url_rules(spark):
    link = '<head><link href="{}" rel="canonical"></head>'.format
    turn = '<META http-equiv=refresh content="0; URL={}">'.format
    rows = [
        (1, "HTTP://A.Net/x?y#z", None, "a.net", "/x", "net/", "block"),
        (2, "http://b.com/1", link("http://a.net/x?y"), "b.com", "/1", None, "block"),
        (3, "http://c.com/1", turn("https://b.com/1#frag"), "c.com", "/1", None, "block"),
        (4, "http://www.example.net/en/a", link("http://a.net/x?y"), "www.example.net", "/en/a", "example.net/en/", "allow"),
        (5, "http://d.com/q?utm_source=1&k=2", "", "d.com", "/q", None, "allow"),
        (6, "http://e.com/", link("http://net/"), "e.com", "/", None, "block"),
        (7, "http://x.net?q", "", "x.net", "", None, "allow"),
        (8, None, "", "", "", None, "allow"),
        (9, "no scheme", link("http://net/"), "", "", None, "allow"),
        (10, "http://net/", "", "net", "/", "net/", "block"),
        (11, "ftp://fr.org/fr/\nx", "", "fr.org", "/fr/\nx", "org/fr/", "allow"),
        (12, "http://f.com/rel", link("/other"), "f.com", "/rel", None, "block"),
        (13, "http://g.com/", link("http://f.com/other"), "g.com", "/", None, "block"),
        (14, "http://net/2", link("http://f.com/other"), "net", "/2", "net/", "block"),
        (10, "http://net/", "", "net", "/", "net/", "block"),
    ]
    want = []
    for r in rows:  # rows 2 and 3 are aliases of 1 and of 4, which is explicitly allowed
        want.append((r[0], *r[3:6], "allow" if r[0] in (2, 3) else r[6]))
    pages = spark.createDataFrame([(*r[:3], "clash", "clash") for r in rows], "page_id long, url string, html string, component string, self string")
    got = url_rules.judge(pages).drop("component").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert url_rules.judge(pages.where("false")).count() == 0


def test_url_links(spark):
    link, turn = '<link rel="canonical" href="{}">'.format, '<meta http-equiv="refresh" content="0; url={}">'.format
    blocked = "http://a.net/dir/page?page=2&ref=x"
    rows = [  # url, html, whether the page is an alias of one of a.net's pages
        ("http://b.com/1", link("http://a.net/dir/page?page=2&amp;ref=x"), True),
        ("http://b.com/2", turn("http://a.net/dir/page?page=2&#38;ref=x"), True),
        ("http://b.com/3", link("http://c.com/") + link("http://a.net/dir/page?page=2&#x26;ref=x"), True),
        ("http://b.com/4", turn("http://c.com/2") + turn("'http://a.net/dir/page?page=2&ref=x'"), True),
        ("http://b.com/5", '<base href="http://a.net/dir/sub/">' + link("../page?page=2&amp;ref=x"), True),
        ("http://d.com/x/y/z?q", link("other") , True),
        ("http://d.com/x/y2/z", link("./../y/./other"), True),
        ("http://d.com/x/y/other?k=1", link("?page=2"), True),
        ("http://d.com/x/y/other?page=2", link(blocked), True),
        ("http://d.com/x/y/other", link("?page=2"), True),
        ("http://e.com", link("p?next=http://a.net/dir/page"), False),
        ("http://e.com/m", link("mailto:x@a.net"), False),
        ("http://e.com/f", link("#part"), False),
        ("http://e.com/c", link("http://a.net/dir/page?page=2&ref=x&copy=1"), False),
        ("http://h.com/1", f'<link rel="shortlink CANONICAL" href="{blocked}">', True),
        ("http://h.com/2", f"<link data-href='http://c.com/9' rel=canonical title=it's href='{blocked}'>", True),
        ("http://h.com/3", f'<link title="a > b" rel="canonical" href="{blocked}">', True),
        ("http://h.com/4", f'<!-- <link rel="canonical" href="{blocked}"> -->', False),
        ("http://h.com/5", f'<script>x = \'<link rel="canonical" href="{blocked}">\'</script><!--' + link(blocked), False),
        ("http://h.com/6", f'<link rel="canonical-x" href="{blocked}"><link rel="next" href="{blocked}"><a rel="canonical" href="{blocked}">', False),
        ("http://h.com/7", f'<a title="<!-- no comment" x=1>' + link("http://c.com/7") + "-->" + link(blocked) + "<meta " + "x='y' " * 9000, True),
        (blocked, None, True),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["component"]) for r in url_rules.judge(pages).collect()}
    assert {i: v for i, (v, _) in got.items()} == {i: "block" if to else "allow" for i, (_, _, to) in enumerate(rows)}
    assert len({got[i][1] for i, (_, _, to) in enumerate(rows) if to}) == 1
    assert [url_rules.decoded(x) for x in ("a?x=1&region=2&amp;copy=3", "&lt&eacute;&#0;&nosuch;", None)] == ["a?x=1&region=2&copy=3", "<é\ufffd&nosuch;", None]
    paths = spark.createDataFrame([("/a/b/../c",), ("/../a/.",), ("/..",), ("/a//b/./",), ("/a/..",)], "p string")
    assert [r[0] for r in paths.select(url_rules._without_dots(F.col("p"))).collect()] == ["/a/c", "/a/", "/", "/a//b/", "/"]


# -- host quality


def test_quality_counts(hard, nothing):
    want = Counter((d, *plain.quality(t)) for d, t in rows_of_documents(hard))
    got = host_quality.judge(hard).collect()
    assert Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert host_quality.judge(nothing).count() == 0 and host_quality.keep_good(hard).columns == hard.columns


def test_host_verdicts(spark):
    noisy, fine = " ".join(f"word{i}## *" for i in range(80)), " ".join(f"word{i}" for i in range(80))
    rows = [(i, noisy if i % 10 else fine, "bad") for i in range(100)] + [(100 + i, fine if i % 10 else noisy, "good") for i in range(100)]
    rows += [(200 + 3 * h + i, fine, f"h{h}") for h in range(20) for i in range(3)] + [(900, noisy, None), (901, fine, None)]
    got = {r["doc_id"]: r["kept"] for r in host_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (i % 10 == 0) for i in range(100))  # clean documents of a bad host stay
    assert all(got[i] for i in range(100, 260)) and got[901]


# -- WARC


def test_warc(spark):
    rows = [(i, f"http://h/{i}\r\nx" if i % 2 else None, ["", None, "same\r\n\r\nWARC/1.1\r\n", f"own {i} é"][i % 4]) for i in range(40)] + [(38, None, "same\r\n\r\nWARC/1.1\r\n"), (None, None, "lonely")]
    pages = spark.createDataFrame([(*r, "z", 5) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", -1))
    for least in (0, 5):
        want = Counter()
        for i, _, h in rows:
            n = len((h or "").encode())
            refers = top[h or ""] if i is not None and n >= least and i != top[h or ""] else None
            want[i, n, "response" if refers is None else "revisit", refers] += 1
        got = warc.archive_digest(pages, least).collect()
        assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == want
        assert {r["payload_digest"] for r in got if r["payload_bytes"] == 0} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}
    from textwarden.llm.common import shared_path

    path = shared_path(spark)
    warc.write_archives(pages, path)
    stored = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, path, True).where("record_type = 'response'").collect()}
    assert stored[38] == "same\r\n\r\nWARC/1.1\r\n" and stored[39] == "own 39 é" and len(stored) == 13
    assert warc.archive_digest(pages.where("false")).count() == 0
