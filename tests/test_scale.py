"""Forms for large inputs give what plain models give, and touch no more than they must."""

import glob
import hashlib
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_activity import EVENT, _events, at, budget_model
from test_streaming import _drain, _stream
from textwarden.operators import budget, documents, keywords, ledger, nearest, policy, risk, shadow, splitter, trees
from textwarden.sources import buckets, commits
from textwarden.streaming import jobs, snapshots, state


# ---- nearest neighbours ---------------------------------------------------


def _vectors(n, groups, seed, dim=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim)) * 3
    x = middle[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.05
    return np.round(x, 3)


def _model(queries, items, k):
    out = {}
    for qid, q in queries:
        scored = sorted((-float((np.array(q) * np.array(v)).sum()), i) for i, v in items if v is not None)
        out[qid] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("cells,block", [(None, 20_000), (5, 40), (1, 7)])
def test_nearest_equals_model(spark, cells, block):
    items = [(i, v.tolist()) for i, v in enumerate(_vectors(600, 12, 1))]
    items += [(1000 + i, items[i % 5][1]) for i in range(40)] + [(2000, None)]  # many equal vectors: ties go to smaller ids
    queries = [(i, v.tolist()) for i, v in enumerate(_vectors(30, 12, 2))] + [(100, items[3][1]), (101, [0.0] * 8)]
    x = spark.createDataFrame(items, "item_id bigint, embedding array<double>").repartition(4)
    q = spark.createDataFrame(queries, "query_id bigint, embedding array<double>")
    got = nearest.nearest(q, x, 7, "query_id", "item_id", "embedding", "embedding", cells, block).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["item_id"])
    assert found == _model(queries, items, 7)
    assert nearest.nearest(q, x.where("false"), 7, "query_id", "item_id", "embedding", "embedding").count() == 0
    few = nearest.nearest(q, x.where("item_id < 3"), 7, "query_id", "item_id", "embedding", "embedding")
    assert few.groupBy("query_id").count().where("count <> 3").count() == 0


def test_cells_are_skipped(spark):
    items = [(i, v.tolist()) for i, v in enumerate(_vectors(2000, 20, 3))]
    queries = [(i, v) for i, v in items[::20]]
    x = spark.createDataFrame(items, "item_id bigint, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id bigint, vec array<double>")
    placed = nearest.place(x, "item_id", "embedding", 30)
    _, rest = nearest.visits(q, placed, 4)
    held = int((placed.count > 0).sum())
    assert held >= 15 and rest.count() + len(queries) < 2 / 3 * held * len(queries)
    large = documents.similarity_topk(q, x, 4, query_vec="vec", max_vectors=50)
    small = documents.similarity_topk(q, x, 4, query_vec="vec")
    assert large.select("query_id", "rank", "item_id").exceptAll(small.select("query_id", "rank", "item_id")).count() == 0


# ---- state with an end ----------------------------------------------------


def _values(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def test_risk_state_ends_and_late_rows_count(spark, tmp_path):
    jobs.use_rocksdb(spark)
    minute = 60_000_000
    first = [(i, "idle", at(i * minute), i * minute, 5.0, True, False, False) for i in range(5)]
    first += [(10 + i, "busy", at(i * minute), i * minute, 5.0, True, False, False) for i in range(5)]
    late = [(30, "busy", at(298 * minute), 298 * minute, 5.0, True, False, False), (31, "busy", at(295 * minute), 295 * minute, 5.0, True, False, False)]
    batches = [first, [(20, "busy", at(300 * minute), 300 * minute, 5.0, True, False, False)], late, [(40, "busy", at(301 * minute), 301 * minute, 5.0, True, False, False)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    rows = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.start_available(jobs.stream_risk(stream), lambda df, _: rows.extend(df.collect()), str(tmp_path / "ck"))
        q.awaitTermination(180)
        if k == 0:
            assert {r["key"]["actor_hash"] for r in _values(spark, str(tmp_path / "ck"), "totals").collect()} == {"idle", "busy"}
    got = {r["event_id"]: r["pii_attempts_last_hour"] for r in rows}
    assert got == {**{i: i + 1 for i in range(5)}, **{10 + i: i + 1 for i in range(5)}, 20: 1, 30: 2, 31: 1, 40: 4}
    assert {r["key"]["actor_hash"] for r in _values(spark, str(tmp_path / "ck"), "totals").collect()} == {"busy"}


class _Map:
    def __init__(self):
        self.d, self.most = {}, 0

    containsKey = lambda self, k: k in self.d
    getValue = lambda self, k: self.d[k]
    removeKey = lambda self, k: self.d.pop(k, None)

    def updateValue(self, k, v):
        self.d[k] = v


class _Value:
    value = None
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers = set()

    getMapState = lambda self, *a: _Map()
    getValueState = lambda self, *a: _Value()
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)


def _trailing(rows, hour):
    return {e: tuple(sum(o[k] for o in rows if us - hour <= o[1] <= us) for k in (2, 3, 4, 5)) for e, us, *_ in rows}


@pytest.mark.parametrize("held", [10, 100_000])
@pytest.mark.parametrize("hour,bucket", [(3_600_000_000, 60_000_000), (100_000_000, 60_000_000), (7_000_000, 60_000_000)])
def test_trailing_sums_in_bounded_memory(held, hour, bucket, monkeypatch):
    rng = random.Random(held + hour)
    rows = [(i, rng.randrange(6000) * 1_000_000 + rng.randrange(3), rng.randrange(100), *(rng.randrange(2) for _ in range(3))) for i in range(700)]
    p = state.TrailingHour(hour, 7_000_000_000, bucket, held)
    handle = _Handle()
    p.init(handle)
    names = ["event_id", "us", "sev", "pii", "inj", "sem"]
    early, got = sorted(rows, key=lambda r: r[1])[:350], {}
    for part in (early, [r for r in rows if r not in early]):
        rng.shuffle(part)
        frames = (pd.DataFrame(part[i : i + 37], columns=names) for i in range(0, len(part), 37))
        for pdf in p.handleInputRows(("a",), frames, None):
            got.update({r.event_id: (r.sev, r.pii, r.inj, r.sem) for r in pdf.itertuples()})
    want = _trailing(early, hour) | {k: v for k, v in _trailing(rows, hour).items() if k not in {r[0] for r in early}}
    assert got == want and len(handle.timers) == 1 and not p.waiting.state.d
    list(p.handleExpiredTimer(("a",), None, None))
    assert not p.events.state.d and not p.totals.exists()


def test_burst_waits_in_state():
    waiting = state.Buckets(_Handle(), "w", {"request_id": "bigint", "us": "bigint", "cost": "double"})
    n, sizes = 300_000, []
    us = np.random.default_rng(1).permutation(n)

    def chunks():
        for i in range(0, n, 5000):
            yield pd.DataFrame({"request_id": np.arange(i, i + 5000), "us": us[i : i + 5000], "cost": 0.5})

    last = -1
    for bucket, columns in state.in_order(chunks(), waiting, 1000, 20_000):
        sizes.append(len(columns["us"]))
        assert bucket > last and (np.diff(columns["us"]) >= 0).all()
        last = bucket
    assert sum(sizes) == n and max(sizes) == 1000 and not waiting.state.d


@pytest.mark.parametrize("held", [7, 100_000])
def test_budget_state_equals_model(held):
    rng = random.Random(held)
    rows = [(i, "a", rng.randrange(400_000_000), rng.randrange(0, 9000)) for i in range(900)]
    p = state.Budget(20, 60_000_000, 0.9, held)
    p.init(_Handle())
    data = pd.DataFrame([(i, us, max(0, t) / 1000 * 0.01) for i, _, us, t in rows], columns=["request_id", "us", "cost"])
    got = {}
    for pdf in p.handleInputRows(("a",), (data.iloc[i : i + 53] for i in range(0, len(data), 53)), None):
        got.update(dict(zip(pdf["request_id"], pdf["decision"])))
    assert got == budget_model(rows, 20, 60_000_000, 0.9)


# ---- budgets by runs ------------------------------------------------------


def test_decisions_in_parts_equal_one_by_one():
    names = [budget.OK, budget.RATE, budget.COST]
    for seed in range(60):
        rng = random.Random(seed)
        costs = np.array([rng.choice([0, 0.001, 0.01, rng.random()]) for _ in range(rng.randrange(400))])
        cap, most = rng.choice([0.0, 0.5, 3.0, 100.0]), rng.choice([0, 1, 7, 1000])
        want, used, spent = [], 0, 0.0
        for c in costs:
            if used + 1 > most:
                want.append(budget.RATE)
            elif spent + c > cap:
                want.append(budget.COST)
            else:
                used, spent = used + 1, spent + c
                want.append(budget.OK)
        got, u, s, i = [], 0, 0.0, 0
        while i < len(costs):
            k = rng.randrange(1, 90)
            codes, u, s = budget.decide_part(costs[i : i + k], u, s, most, cap)
            got += [names[c] for c in codes]
            i += k
        assert got == want and (u, s) == (used, spent)


def test_a_window_of_ten_million_requests():
    costs = np.random.default_rng(3).random(10_000_000) * 1e-3
    begun, used, spent, accepted = time.time(), 0, 0.0, 0
    for i in range(0, len(costs), 100_000):
        codes, used, spent = budget.decide_part(costs[i : i + 100_000], used, spent, 3_000_000, 900.0)
        accepted += int((codes == 0).sum())
    assert accepted == used and spent <= 900.0 and time.time() - begun < 20


# ---- control room by batches ----------------------------------------------


def test_control_room_batches(spark, tmp_path):
    base, minute = str(tmp_path / "room"), 60_000_000
    rows = [(i, f"a{i % 3}", at(i * minute), i * minute, 5.0, i % 2 == 0, i % 50 == 0, False) for i in range(300)]
    df = spark.createDataFrame(rows, EVENT)
    as_of = str(at(299 * minute))
    write = snapshots.control_room_batches(base, lambda: as_of, keep=2)
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, base)
    parts = [df.where(f"event_id % 3 = {k}") for k in range(3)]
    write(parts[0], 0)
    write(parts[1], 1)
    before = snapshots.read_snapshot(spark, base).first()
    write(parts[1], 1)  # a committed batch that is run again changes nothing
    assert snapshots.read_snapshot(spark, base).first() == before and before["events"] == 200
    # A batch that broke off before its commit leaves the snapshot as it was, and counts once when it is run again.
    broken = snapshots.control_room_batches(base, lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken(parts[2], 2)
    assert snapshots.read_snapshot(spark, base).first() == before
    write(parts[2], 2)
    last = snapshots.read_snapshot(spark, base).first()
    profiles = risk.risk_profile(df, as_of)
    assert (last["events"], last["pii"], last["injections"], last["active_hours"]) == (300, 150, 6, 5)
    assert last["open_alerts"] == risk.alerts(profiles).count() and last["quarantined_users"] == profiles.where("quarantined").count()
    assert commits.versions(spark, base) == [1, 2] and len(os.listdir(f"{base}/versions")) == 2
    hours = snapshots.read_snapshot(spark, base, "hours")
    live = snapshots._live(spark, base, hours, as_of, EVENT)
    assert {p.split("hour=")[1].split("/")[0] for p in live.inputFiles()} == {str(r["hour"]) for r in hours.orderBy(F.desc("hour")).limit(2).collect()}


# ---- keywords -------------------------------------------------------------


def _rule(i, words=(), dept=None, types=(), threshold=0.0):
    return {"rule_ord": i, "dept": dept, "name": f"r{i}", "description": "", "entity_types": list(types), "keywords": list(words), "enforcement": "WARN", "risk_threshold": threshold, "allowed_models": []}


@pytest.mark.parametrize(
    "pattern,piece",
    [("Claim Number", "claim number"), (r"\bfoo\b", "foo"), (r"ab?c+d", "a"), (r"colou?rs", "colo"), (r"a|b", ""), (r"x{2,3}yz", "yz"), (r"[abc]def.g", "def"), (r"\d{3}-\d", "-"), (r"a\.b", "a.b"), ("straße", "stra"), ("", ""), (r"\p{L}x", ""), (r"q*", "")],
)
def test_anchor(pattern, piece):
    assert keywords.anchor(pattern) == piece


def test_many_keywords_match_as_the_join_does(spark, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "Beta", r"gam+a", r"\bdelta\b", "e.silon", r"colou?r", "claim number", "K2", r"z(e|i)ta", r"\d{3}-\d{2}", "straße", "", "%_'\""]
    rules = [_rule(i, rng.sample(words, rng.randrange(0, 3)), rng.choice([None, "hr", "LEGAL"]), rng.sample(["PAN", "SSN"], rng.randrange(0, 2)), rng.choice([0.0, 3.0, 7.5])) for i in range(60)]
    texts = ["ALPHA beta", "gammma DELTA", "deltas epsilon", "color COLOUR", "claim  number", "Claim Number k2", "K2 zeta zita", "123-45 STRASSE straße", None, "", "%_'\" all", "nothing"]
    rows = [(i, texts[i % len(texts)], rng.choice([None, [], ["PAN"], ["SSN", "PAN"]]), rng.choice([None, 0.0, 3.0, 9.0]), rng.choice([None, "HR", "legal", "x"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, text string, labels array<string>, risk_score double, department string")
    frame = policy.rules_frame(spark, rules)
    one = policy.match_table(df, frame, "id")
    monkeypatch.setattr(policy, "AUTOMATON_CHARS", 0)
    other = policy.match_table(df, frame, "id")
    ords = lambda d: {r["id"]: [x["rule_ord"] for x in r["matched"]] for r in d.select("id", "matched").collect()}
    assert ords(one) == ords(other) and sum(map(len, ords(one).values())) > 100


def test_cost_of_keywords_does_not_grow_with_their_number():
    text = " ".join(f"word{i}" for i in range(3000))

    def seconds(n):
        m = keywords.Matcher([_rule(i, [f"keyword{i}x"]) for i in range(n)] + [_rule(n, ["word77 "])])
        assert [r["rule"]["rule_ord"] for r in m.found(text, None, None, ["", "*"])] == [n]
        begun = time.perf_counter()
        for _ in range(30):
            m.found(text, None, None, ["", "*"])
        return time.perf_counter() - begun

    assert min(seconds(20_000) for _ in range(3)) < 5 * min(seconds(20) for _ in range(3)) + 0.05


# ---- hash trees -----------------------------------------------------------


def _root(hashes):
    while len(hashes) > 1:
        pairs = [hashes[i : i + 2] for i in range(0, len(hashes), 2)]
        hashes = [p[0] if len(p) == 1 else hashlib.sha256("".join(p).encode()).hexdigest() for p in pairs]
    return hashes[0]


@pytest.mark.parametrize("step", [1, 3, 10])
def test_trees_and_paths(spark, step):
    sizes = {"a": 1, "b": 2, "c": 13, "d": 64, None: 5}
    leaf = lambda g, i: hashlib.sha256(f"{g}{i}".encode()).hexdigest()
    rows = [(g, f"{i:03}", leaf(g, i)) for g, n in sizes.items() for i in range(n)]
    df = trees.numbered(spark.createDataFrame(rows, "g string, name string, leaf string").repartition(4), ["g"], "name")
    roots, paths = trees.merkle_tree(df, ["g"], step=step)
    assert {r["g"]: (r["root"], r["n_leaves"]) for r in roots.collect()} == {g: (_root([leaf(g, i) for i in range(n)]), n) for g, n in sizes.items()}
    same = df["g"].eqNullSafe(F.col("h")) & (df["idx"] == F.col("k"))
    all_ = df.join(paths.select(F.col("g").alias("h"), F.col("idx").alias("k"), "path"), same).withColumn("top", trees.proven(F.col("leaf"), F.col("path")))
    got = all_.select("g", "name", "top").collect()
    assert len(got) == len(rows) and all(r["top"] == _root([leaf(r["g"], i) for i in range(sizes[r["g"]])]) for r in got)


def test_first_of_each(spark):
    rows = [(g, i, (i * 7) % 50) for g in "ab" for i in range(200)] + [("c", 1, 1)]
    got = ledger.first_of_each(spark.createDataFrame(rows, "g string, i int, v int"), "g", [F.col("v").desc(), F.col("i")], 6, "i").collect()
    for g in "abc":
        want = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:6]
        assert [(r["i"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["g"] == g] == [(r[1], k + 1) for k, r in enumerate(want)]


# ---- splitter -------------------------------------------------------------


def _split_plain(text, size, overlap, separators=("\n\n", "\n", " ")):
    """The same in words: split at the first separator, split long pieces again, merge the others."""

    def merged(pieces):
        out, cur, total = [], [], 0
        for p in pieces:
            if cur and total + len(p) > size:
                out.append("".join(cur).strip())
                while total > overlap or (total > 0 and total + len(p) > size):
                    total -= len(cur.pop(0))
            cur.append(p)
            total += len(p)
        if cur:
            out.append("".join(cur).strip())
        return [c for c in out if c]

    if not separators:
        return merged(list(text))
    sep, rest = separators[0], separators[1:]
    if sep not in text:
        return merged([text]) if len(text) < size else _split_plain(text, size, overlap, rest)
    parts = text.split(sep)
    out, good = [], []
    for p in [q for q in [parts[0], *[sep + x for x in parts[1:]]] if q]:
        if len(p) < size:
            good.append(p)
        else:
            out += merged(good) + _split_plain(p, size, overlap, rest)
            good = []
    return out + merged(good)


@pytest.mark.parametrize("size,overlap", [(20, 5), (20, 0), (7, 6), (1000, 150)])
def test_splitter_equals_plain_form(spark, size, overlap):
    rng = random.Random(size)
    alphabet = ["a", "bb", "wordy", " ", " ", "\n", "\n\n", "\n\n\n", "  ", "é", "x" * 9, "y" * 31, "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["", " ", "\n\n", "z" * 95, "word " * 1000, "line of words\n" * 400, "p" * 20, "p" * 19, ("para " * 30 + "\n\n") * 8, "😀" * 70 + " é" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string").repartition(6)
    got = {}
    for r in splitter.split_text(df, "id", size=size, overlap=overlap).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    for i, t in enumerate(texts):
        assert got.get(i, []) == _split_plain(t, size, overlap), (i, t[:80])


def test_golden_chunks(spark):
    text = "First paragraph here.\n\nSecond one is a little longer than that.\nIt has two lines.\n\nEnd"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = splitter.split_text(df, "id", size=40, overlap=10).orderBy("chunk_no").collect()
    assert [r["chunk"] for r in rows] == ["First paragraph here.", "Second one is a little longer than", "than that.", "It has two lines.", "End"]


def test_chunks_are_found_without_a_step_per_word(spark):
    df = spark.createDataFrame([(1, "a line of words\n" * 3)], "id int, text string")
    plan = splitter.split_text(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "lambdafunction" not in plan
    places = []

    class Counted(str):
        def __getitem__(self, key):
            places.append(key)
            return super().__getitem__(key)

    text = Counted("word " * 200_000 + "x" * 5000)
    bounds = list(splitter.chunk_bounds(text, 1000, 150))
    assert bounds[0] == (0, 999) and bounds[-1][1] == len(text) and len(places) <= 3
    assert all(a < c <= b and b - a <= 1000 for (a, b), (c, _) in zip(bounds, bounds[1:]))


# ---- upserts by bucket ----------------------------------------------------


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    base = str(tmp_path / "t")
    old = spark.createDataFrame([(f"k{i}", i, 1) for i in range(200)] + [("k0", -1, 0)], "k string, v int, version int")
    buckets.create_buckets(old, base, "k", "version", 8)
    files = lambda: set(glob.glob(f"{base}/data/*/*/*.parquet"))
    first = files()
    n = buckets.upsert_buckets(spark.createDataFrame([("k1", 11, 2), ("k1", 9, 1), ("new", 5, 1)], "k string, v int, version int"), base, "k", "version")
    assert 1 <= n <= 2 and first < files() and len(files() - first) <= n
    want = {f"k{i}": i for i in range(200)} | {"k1": 11, "new": 5}
    now = buckets.read_buckets(spark, base)
    assert {r["k"]: r["v"] for r in now.collect()} == want
    assert sum(f"version=1/" in p for p in now.inputFiles()) >= 6
    one = buckets.read_buckets(spark, base, "k", ["k1"])
    assert [r["v"] for r in one.collect()] == [11] and len(one.inputFiles()) == 1
    assert not commits.commit(spark, base, 2)  # of two writers only one commits
    assert buckets.upsert_buckets(old.limit(0), base, "k", "version") == 0


# ---- long watch lists -----------------------------------------------------


def test_longest_match_of_reversed_names(spark):
    rng = random.Random(8)
    label = lambda: rng.choice(["a", "b", "ab", "x-y", "com", "org", "0"])
    names = sorted({".".join(label() for _ in range(rng.randrange(1, 5))) for _ in range(500)})
    domains = rng.sample(names, 120)
    hosts = [*names, *[f"deep.er.{n}" for n in names], "", "."]
    best = lambda h: max((d for d in domains if h == d or h.endswith("." + d)), key=len, default=None)
    want = {h: best(h) for h in hosts if best(h) is not None}
    for parts in (1, 23):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = shadow.longest_match(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame([(d,) for d in domains], "domain string"))
        assert {r["host"]: r["domain"] for r in got.collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    log = spark.createDataFrame([(i, "hot.com" if i % 3 == 0 else rng.choice(names)) for i in range(900)], "seq int, host string")
    watch = spark.createDataFrame([(d, d, "v", "LOW") for d in [*domains, "hot.com"]], shadow.WATCHLIST)
    large = shadow.detect_in_large_list(log, watch, "seq").select("seq", "domain")
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, shadow.detect_shadow_ai(log, watch, "seq").select("seq", "domain").collect()))
