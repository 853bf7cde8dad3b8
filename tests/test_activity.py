"""Policy, risk, budgets, ledgers, compliance: brute-force models on small fixtures."""

import datetime as dt
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from textwarden.functions.hashing import sign_payload, verify_signature
from textwarden.functions.presets import bundled_rules
from textwarden.operators import budget, compliance, ledger, metrics, policy, risk
from textwarden.plans import bindings, gateway
from textwarden.sources import readers, sinks


def at(us):
    return dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)


# ---- rules ----------------------------------------------------------------

RULES = [
    dict(rule_ord=1, dept=None, name="all", description="g", entity_types=[], keywords=["alpha.?beta"], enforcement="warn", risk_threshold=0.0, allowed_models=["m1"], departments=[]),
    dict(rule_ord=2, dept="HR", name="r", description="", entity_types=["PAN Card"], keywords=[], enforcement="redact", risk_threshold=9.0, allowed_models=[], departments=[]),
    dict(rule_ord=3, dept="HR", name="b1", description="", entity_types=[], keywords=["Stop"], enforcement="block", risk_threshold=9.0, allowed_models=[], departments=[]),
    dict(rule_ord=4, dept="HR", name="r2", description="late", entity_types=[], keywords=["stop"], enforcement="redact", risk_threshold=9.0, allowed_models=[], departments=[]),
    dict(rule_ord=5, dept="HR", name="b2", description="why", entity_types=[], keywords=[], enforcement="block", risk_threshold=5.0, allowed_models=[], departments=[]),
]


@pytest.fixture(scope="module")
def prompts(spark):
    rows = [
        (1, "ALPHA beta", [], 0.0, "hr", "m2"),
        (2, "stop now", ["PAN Card"], 6.0, "HR", None),
        (3, "stop now", [], 1.0, "LAW", "m1"),
        (4, "nothing", ["PAN Card"], 0.0, "HR", "m1"),
        (5, "nothing", None, 0.0, None, None),
    ]
    return spark.createDataFrame(rows, "id int, text string, labels array<string>, risk_score double, department string, preferred_model string")


def test_decisions(spark, prompts):
    rows = policy.decide(policy.match_rules(prompts, RULES)).orderBy("id").collect()
    d = [r.decision for r in rows]
    assert [x.action for x in d] == ["warn", "block", "warn", "redact", "warn"]
    assert d[0].triggered_rules == ["all"] and not d[0].model_allowed and len(d[0].warnings) == 2
    assert d[1].triggered_rules == ["r", "b1", "r2", "b2"]
    assert d[1].block_reason == "Policy 'b2' blocked: why" and d[1].warnings == ["Policy 'r2' warned: late"]
    assert d[3].block_reason is None and d[4].policy_name == "GLOBAL_policy"


@pytest.mark.parametrize("limit", [20_000, 1])
def test_join_form_agrees(spark, prompts, monkeypatch, limit):
    monkeypatch.setattr(policy, "BROADCAST_RULES", limit)
    a = policy.decide(policy.match_rules(prompts, RULES)).select("id", "decision")
    b = policy.decide(policy.match_table(prompts, policy.rules_frame(spark, RULES), "id")).select("id", "decision")
    assert [r.asDict(True) for r in a.orderBy("id").collect()] == [r.asDict(True) for r in b.orderBy("id").collect()]


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(
        "department: hr\nrules:\n  - name: x\n    enforcement: explode\n    risk_threshold: 99\n  - keywords: [k]\n    enforcement: block\n"
    )
    (tmp_path / "b.yml").write_text("rules:\n  - name: everywhere\n")
    rows = readers.load_rules(spark, str(tmp_path)).orderBy("rule_ord").collect()
    assert [(r.dept, r.name, r.enforcement, r.risk_threshold, len(r.errors)) for r in rows] == [
        ("HR", "x", "redact", 5.0, 2),
        ("HR", "unnamed", "block", 5.0, 0),
        (None, "everywhere", "redact", 5.0, 0),
    ]
    counts = {r.dept: r.n_rules for r in policy.policy_summary(policy.rules_frame(spark)).collect()}
    assert sum(counts.values()) == len(bundled_rules()) == 29 and len(counts) == 7


# ---- risk and budgets -----------------------------------------------------


def _events(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        actor = "hot" if rng.random() < 0.5 else f"a{rng.randrange(4)}"
        us = rng.randrange(6 * 3600) * 1_000_000 if rng.random() < 0.9 else 3_600_000_000 * rng.randrange(6)
        rows.append((i, actor, at(us), us, round(rng.uniform(0, 12), 2), rng.random() < 0.2, rng.random() < 0.2, rng.random() < 0.2))
    return rows


EVENT = "event_id bigint, actor_hash string, ts timestamp, us bigint, severity double, is_pii boolean, is_injection boolean, is_semantic boolean"


def test_trailing_hour_equals_brute_force(spark):
    rows = _events(400)
    for cell in (1_000_000, 60_000_000, 10**12):
        got = risk.risk_as_of_event(spark.createDataFrame(rows, EVENT), "event_id", cell_us=cell).collect()
        assert len(got) == len(rows)
        for r in got:
            me = rows[r.event_id]
            win = [e for e in rows if e[1] == me[1] and me[3] - 3_600_000_000 <= e[3] <= me[3]]
            pii, inj, sem = (sum(e[k] for e in win) for k in (5, 6, 7))
            score = sum(min(10, e[4]) for e in win) + 8 * pii + 12 * inj + 10 * sem + (25 if pii > 3 else 0)
            assert (r.pii_attempts_last_hour, r.injection_attempts_last_hour, r.semantic_hits_last_hour) == (pii, inj, sem)
            assert r.risk_score == pytest.approx(min(100, score), abs=0.006) and r.quarantined == (pii > 3)


def test_fourth_attempt_quarantines(spark):
    rows = [(i, "a", at(i * 60_000_000), i * 60_000_000, 1.0, True, False, False) for i in range(4)]
    got = risk.risk_as_of_event(spark.createDataFrame(rows, EVENT), "event_id").orderBy("event_id").collect()
    assert [r.quarantined for r in got] == [False, False, False, True]
    assert got[3].quarantine_reason == risk.QUARANTINE_REASON


def budget_model(rows, n, window, cap):
    state, out = {}, {}
    for rid, actor, us, tokens in sorted(rows, key=lambda r: (r[2], r[0])):
        cost = max(0, tokens) / 1000 * 0.01
        s = state.get(actor)
        if s is None or us - s[0] > window:
            s = state[actor] = [us, 0, 0.0]
        if s[1] + 1 > n:
            out[rid] = budget.RATE
        elif s[2] + cost > cap:
            out[rid] = budget.COST
        else:
            s[1] += 1
            s[2] += cost
            out[rid] = budget.OK
    return out


@pytest.mark.parametrize("block", [30_000_000, 3_600_000_000])
def test_budget_equals_model(spark, block):
    rng = random.Random(5)
    us, rows = 0, []
    for i in range(1500):
        us += int(rng.expovariate(1 / 700_000)) + (90_000_000 if rng.random() < 0.004 else 0)
        rows.append((i, "hot" if rng.random() < 0.8 else "cold", us, rng.randrange(-50, 9000)))
    df = spark.createDataFrame([(a, b, at(c), d) for a, b, c, d in rows], "request_id bigint, actor string, ts timestamp, tokens bigint")
    got = budget.rate_cost_decisions(df, max_requests=20, max_cost=0.9, block_us=block).collect()
    want = budget_model(rows, 20, 60_000_000, 0.9)
    assert {r.request_id: r.decision for r in got} == want and len(set(want.values())) == 3


# Joins planned as sorts turn into broadcasts once their small side is known, and small shuffles are read in parts, as with large tables.
BROADCAST_LATE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def broadcast_late(spark):
    before = {key: spark.conf.get(key, None) for key in BROADCAST_LATE}
    for key, value in BROADCAST_LATE.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_budget_when_the_join_turns_broadcast(spark, broadcast_late):
    rng = random.Random(7)
    rows = [(i, rng.choice("abcdefghijklmnopqrst"), 1000 * i + 1_700_000_000_000_000, rng.randrange(9000)) for i in range(6000)]
    df = spark.createDataFrame([(a, b, at(c), d) for a, b, c, d in rows], "request_id bigint, actor string, ts timestamp, tokens bigint")
    got = budget.rate_cost_decisions(df, max_requests=20, window_us=500_000, max_cost=0.9, block_us=2_000_000).collect()
    assert {r.request_id: r.decision for r in got} == budget_model(rows, 20, 500_000, 0.9)


# ---- ledger ---------------------------------------------------------------


def test_chain_of_joined_rows_when_the_join_turns_broadcast(spark, broadcast_late):
    rows = [(f"c{i % 40}", i) for i in range(4000)]
    entries = spark.createDataFrame(rows, "chain_id string, seq bigint")
    bodies = spark.createDataFrame([(f"c{k}", f"{k}" + ledger.PREV_MARK) for k in range(40)], "chain_id string, body string")
    got = ledger.build_chain(entries.join(bodies, "chain_id")).collect()
    assert sum(r.prev_hash == ledger.GENESIS for r in got) == 40 and len({r.entry_hash for r in got}) == 4000



def _sealed(spark, n=25, salt="s"):
    rows = [("c", i, f"2024-01-01T00:00:{i:02d}+00:00", "default", "uñ", "STAFF", "HR", "AI_QUERY", ["PAN Card"], 1.5, '{"b": 1, "a": "é"}') for i in range(1, n + 1)]
    df = spark.createDataFrame(
        rows,
        "chain_id string, seq bigint, timestamp string, tenant_id string, user_id string, user_role string, department string, action string, redactions_applied array<string>, risk_score double, metadata string",
    ).repartition(3)
    return ledger.build_chain(ledger.ledger_body(df), salt=salt)


def test_chain_equals_python(spark):
    rows = sorted(_sealed(spark).collect(), key=lambda r: r.seq)
    prev = "GENESIS"
    for r in rows:
        entry = {
            "timestamp": r.timestamp, "actor_hash": None, "tenant_id": "default", "user_id": "uñ", "user_role": "STAFF", "department": "HR",
            "action": "AI_QUERY", "document": None, "prompt_hash": None, "redactions_applied": ["PAN Card"], "policy_triggered": None,
            "model_queried": None, "risk_score": 1.5, "prev_hash": prev, "metadata": {"b": 1, "a": "é"},
        }
        want = hashlib.sha256(("s:" + json.dumps(entry, sort_keys=True, ensure_ascii=True)).encode()).hexdigest()
        assert (r.prev_hash, r.entry_hash) == (prev, want)
        prev = want


@pytest.mark.parametrize("block", [4, 1000])
def test_verify_finds_first_break(spark, block):
    good = _sealed(spark).cache()
    ok = ledger.verify_chain(good, "chain_id", "s", block=block).first()
    assert ok.valid and ok.total_entries == 25
    for seq in (1, 4, 5, 8, 25):
        text = good.withColumn("canonical", F.when(F.col("seq") == seq, F.lit("x")).otherwise(F.col("canonical")))
        r = ledger.verify_chain(text, "chain_id", "s", block=block).first()
        assert (r.valid, r.corrupted_seq, r.corrupted_reason) == (False, seq, "content tampered")
        link = text.withColumn("prev_hash", F.when(F.col("seq") == seq, F.lit("x")).otherwise(F.col("prev_hash")))
        r = ledger.verify_chain(link, "chain_id", "s", block=block).first()
        assert (r.corrupted_seq, r.corrupted_reason) == (seq, "prev_hash mismatch")
        gone = good.where(F.col("seq") != seq)
        r = ledger.verify_chain(gone, "chain_id", "s", block=block).first()
        assert r.valid is (seq == 25)
    empty = ledger.verify_chain(good.limit(0), None, "s").first()
    assert (empty.valid, empty.total_entries, empty.corrupted_seq) == (True, 0, None)
    assert ledger.verify_chain(good.limit(0), "chain_id", "s").count() == 0


def test_chain_of_chains(spark):
    rows = _sealed(spark).drop("prev_hash", "canonical", "entry_hash").withColumn("chain_id", F.concat(F.lit("day-"), F.expr("seq div 10")))
    sealed = ledger.build_chain(rows, salt="s")
    assert ledger.verify_chain(sealed, "chain_id", "s").where("valid").count() == 3
    root = ledger.build_chain(ledger.chain_heads(sealed), salt="s").orderBy("seq").collect()
    assert [(r.name, r.entries) for r in root] == [("day-0", 9), ("day-1", 10), ("day-2", 6)] and root[1].prev_hash == root[0].entry_hash
    shorter = ledger.build_chain(ledger.chain_heads(sealed.where("seq < 25")), salt="s").agg(F.max_by("entry_hash", "seq")).first()[0]
    assert shorter != root[2].entry_hash


def test_root_tree_of_sparse_keys(spark):
    keys = [0, 1, 7, 9_999, 10_000, 10**12, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(k, f"h{k}") for k in keys], "seq bigint, entry_hash string").repartition(3)
    level = [(k, f"h{k}") for k in keys]
    for _ in range(ledger.tree_levels(10_000)):
        groups = {}
        for k, h in level:
            groups.setdefault(k // 10_000, []).append(h)
        level = [(k, hashlib.sha256("".join(v).encode()).hexdigest()) for k, v in sorted(groups.items())]
    want = hashlib.sha256("".join(h for _, h in level).encode()).hexdigest()
    assert tuple(ledger.merkle_root(df).first()) == (want, len(keys)) and len(level) == 1
    assert ledger.merkle_root(df.limit(0)).first().entry_count == 0


def test_all_alerts_are_counted(spark):
    rows = [(f"a{i}", "2024-01-15 11:30:00", 9.0, True, i % 2 == 0, False) for i in range(1000) for _ in range(4)]
    events = spark.createDataFrame(rows, "actor_hash string, t string, severity double, is_pii boolean, is_injection boolean, is_semantic boolean")
    profiles = risk.risk_profile(events.withColumn("ts", F.to_timestamp("t")), "2024-01-15 12:00:00")
    assert risk.alerts(profiles).count() == 1000 and risk.heatmap(profiles).count() == 100


def test_equal_timestamps_are_judged_one_by_one(spark):
    rows = [(i, "a", "2024-01-15 11:30:00", 9.0, True, False, False) for i in range(1, 5)]
    events = spark.createDataFrame(rows, "k bigint, actor_hash string, t string, severity double, is_pii boolean, is_injection boolean, is_semantic boolean")
    events = events.withColumn("ts", F.to_timestamp("t"))
    got = risk.risk_as_of_event(events, "k", one_by_one=True).orderBy("k").collect()
    assert [r.quarantined for r in got] == [False, False, False, True]
    assert all(r.quarantined for r in risk.risk_as_of_event(events, "k").collect())


def test_reseal(spark, tmp_path):
    good = _sealed(spark, salt="").withColumn("signature", F.col("entry_hash"))
    assert ledger.reseal(good, str(tmp_path / "a0"), str(tmp_path / "n0"), "t").count() == 0
    bad = good.withColumn("canonical", F.when(F.col("seq") == 3, F.lit("x")).otherwise(F.col("canonical")))
    inc = ledger.reseal(bad, str(tmp_path / "a"), str(tmp_path / "n"), "2024-01-01T00:00:00+00:00").first()
    assert (inc.corrupted_seq_before, inc.entries_before) == (3, 25)
    fresh = spark.read.parquet(str(tmp_path / "n"))
    assert fresh.first().prev_hash == "GENESIS" and ledger.verify_chain(fresh, salt="").first().valid
    assert spark.read.parquet(str(tmp_path / "a")).count() == 25


def test_foreign_ledger_lines(spark, tmp_path):
    prev, lines = "GENESIS", []
    for i in range(300):
        e = {"timestamp": f"t{i}", "action": "A", "user_id": "é", "risk_score": 1.0, "redactions_applied": [], "metadata": {"k": i}, "prev_hash": prev}
        prev = hashlib.sha256(("salt:" + json.dumps(e, sort_keys=True)).encode()).hexdigest()
        lines.append(json.dumps({**e, "signature": prev, "entry_hash": prev}))
        lines.append("")
    (tmp_path / "l-1.jsonl").write_text("\n".join(lines[:350]))
    (tmp_path / "l-2.jsonl").write_text("\n".join(lines[350:]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000b")
    try:
        df = readers.read_ledger(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        rows = df.withColumn("h", ledger.foreign_entry_hash(F.col("line"), "salt")).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.timestamp for r in rows] == [f"t{i}" for i in range(300)] and [r.seq for r in rows] == list(range(1, 301))
    assert all(r.h == r.entry_hash for r in rows)


def test_hmac(spark):
    import hmac

    df = spark.createDataFrame([("body é", "k"), ("", "long" * 40)], "b string, s string").withColumn("sig", sign_payload(F.col("b"), F.col("s")))
    for r in df.withColumn("ok", verify_signature(F.col("b"), F.col("sig"), F.col("s"))).collect():
        assert r.sig == "sha256=" + hmac.new(r.s.encode(), r.b.encode(), hashlib.sha256).hexdigest() and r.ok


# ---- compliance, sources, gateway -----------------------------------------


def test_consent_order(spark):
    past, future = dt.datetime(2020, 1, 1), dt.datetime(2030, 1, 1)
    rows = [
        (1, "a", "p", True, False, future), (2, "a", "p", False, False, future),
        (1, "b", "p", True, False, future), (2, "b", "p", False, False, past),
        (1, "c", "p", True, True, past), (1, "d", "p", False, False, future),
    ]
    cons = spark.createDataFrame([(s, f"{h}{s}", h, p, g, r, e) for s, h, p, g, r, e in rows], "seq bigint, consent_id string, principal_hash string, purpose string, granted boolean, revoked boolean, expires_at timestamp")
    asked = spark.createDataFrame([(x, "p") for x in "abcde"], "principal_hash string, purpose string")
    got = {r.principal_hash: (r.reason, r.consent_id) for r in compliance.consent_check(asked, cons, "2024-01-01 00:00:00").collect()}
    assert got == {"a": ("VALID", "a1"), "b": ("EXPIRED", "b2"), "c": ("REVOKED", "c1"), "d": ("NOT_FOUND", None), "e": ("NOT_FOUND", None)}


def test_export_and_manifest(spark, tmp_path):
    df = _sealed(spark, 3)
    sinks.write_audit_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert tuple(back.columns) == sinks.EXPORT_COLUMNS and back.first().redactions_applied == '["PAN Card"]'
    (tmp_path / "docs").mkdir()
    for name in ("a.txt", "b.md", "c.txt.tmp", ".hidden"):
        (tmp_path / "docs" / name).write_text(f"text {name}\nline")
    done = spark.createDataFrame([("b.md",)], "file string")
    assert [r.file for r in readers.read_documents(spark, str(tmp_path / "docs"), processed=done).collect()] == ["a.txt"]
    m = readers.file_manifest(spark, str(tmp_path / "docs"), 2, "*.*").collect()
    assert [r["name"] for r in m] == ["c.txt.tmp", "b.md"] and m[1].certificate == hashlib.sha256(b"text b.md\nline").hexdigest()
    sinks.append_ledger(df, str(tmp_path / "led"))
    sinks.append_ledger(df, str(tmp_path / "led"))
    assert spark.read.parquet(str(tmp_path / "led")).count() == 6


def test_gateway_cascade(spark, small):
    p = bindings.view(spark, small, "prompts")
    rows = gateway.gateway_decide(p, key="prompt_id").collect()
    assert len(rows) == p.count()
    kinds = {r.action for r in rows}
    assert {gateway.INJECTION, gateway.ALLOWED, gateway.BLOCKED} <= kinds
    by = {r.prompt_id: r for r in rows}
    assert all(by[i].action in (gateway.INJECTION, gateway.QUARANTINED) for i in by if i % 16 in (5, 6))
    assert all(r.policy_triggered == gateway.INJECTION_POLICY for r in rows if r.action == gateway.INJECTION)


def test_history_can_quarantine(spark):
    one = spark.createDataFrame([(1, at(0), "u", "t", "HR", None, "hello UHID-AB12CD34")], "prompt_id bigint, ts timestamp, actor string, tenant_id string, department string, preferred_model string, text string")
    past = spark.createDataFrame([(hashlib.sha256(b":t:u").hexdigest(), at(-60_000_000 * k), 1.0, True, False, False) for k in (1, 2, 3)], "actor_hash string, ts timestamp, severity double, is_pii boolean, is_injection boolean, is_semantic boolean")
    assert gateway.gateway_decide(one).first().action == gateway.ALLOWED
    assert gateway.gateway_decide(one, history=past).first().action == gateway.QUARANTINED


def test_deliveries_are_signed_once_per_secret(spark, monkeypatch):
    """Many hooks with one secret, some without; lists cut short or not, the deliveries are those of a plain loop."""
    hooks = [(f"h{i}", f"https://{i}.example/", True, "t1", ["A", "A", "B"], "s3cret") for i in range(40)]
    hooks += [("own", "u", True, "t1", ["A"], "other"), ("none", "u", True, "t1", ["A"], None), ("empty", "u", True, "t1", ["B"], "")]
    hooks += [("off", "u", False, "t1", ["A"], "s3cret"), ("home", "u", True, None, ["A"], "s3cret"), ("still", "u", True, "t1", [], "s3cret")]
    hooks += [("twice", "u", True, "t1", ["B"], "s3cret")] * 2
    events = [(1, "t1", "A", 5, "x"), (2, "t1", "B", 6, "ü\""), (3, "default", "A", 7, None), (4, None, "A", 8, "y"), (5, "t1", "C", 9, "z"), (6, "t1", "A", 5, "x")]
    want = []
    for seq, tenant, kind, ts, payload in events:
        said = {"event_type": kind, "tenant_id": tenant, "timestamp": str(ts), "payload": payload}
        body = json.dumps({k: v for k, v in said.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))
        for name, url, active, owner, kinds, secret in hooks:
            if active and (owner or "default") == tenant and kind in kinds:
                sealed = secret and "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
                want.append((seq, name, url, body, hashlib.sha256(body.encode()).hexdigest(), sealed or None))
    e = spark.createDataFrame(events, "seq long, tenant_id string, event_type string, ts long, payload string")
    h = spark.createDataFrame(hooks, "hook_id string, target_url string, active boolean, tenant_id string, event_types array<string>, secret string")
    for most in (1000, 7):
        monkeypatch.setattr(metrics, "HOOKS", most)
        got = [tuple(r) for r in metrics.route_webhooks(e, h, "seq").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(body):
        calls.add(1)
        return body

    monkeypatch.setattr(metrics, "HOOKS", 1000)
    monkeypatch.setattr(metrics, "hmac_sha256", lambda body, pads: F.when(pads.isNotNull(), counted(body)))
    assert len(metrics.route_webhooks(e, h, "seq").select("signature").collect()) == len(want)
    assert calls.value <= 10  # events times secrets, not times hooks
