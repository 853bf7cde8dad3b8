"""Every registered query against its SQL, on the smallest tables; queries without SQL against what must hold for their rows."""

import re

import oracle
import pytest

from textwarden.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, con, name):
    assert oracle.compare(QUERIES[name](spark, small), con, ORACLES[name]) is None


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) - set(ORACLES) == set(CHECKS)


def _ids(con, view):
    table, key = {"prompts": ("documents", "doc_id"), "turns": ("conversations", "conv_id * 100 + turn")}[view]
    return sorted(r[0] for r in con.execute(f"SELECT {key} FROM {table}").fetchall())


def pseudonym_vault(rows, spark, small, con):
    governed = {r.prompt_id: set(r.pseudonyms.split()) for r in QUERIES["governed_prompts"](spark, small).collect()}
    tokens = {}
    for r in rows:
        tokens.setdefault(r.prompt_id, set()).add(r.token)
        assert re.fullmatch(r"[0-9a-f]{64}", r.sha256) and r.label and r.type
    assert tokens and all(governed[k] >= v for k, v in tokens.items()) and sum(map(len, tokens.values())) == len(rows)


def governed_prompts(rows, spark, small, con):
    assert sorted(r.prompt_id for r in rows) == _ids(con, "prompts")
    for r in rows:
        assert 0 <= r.sensitivity_score <= 10 and r.route == ("airgap" if r.sensitivity_score > 7 else "cloud_or_hybrid")
        assert (r.policy_triggered is None) == (r.pseudonyms == "")
    assert {bool(r.pseudonyms) for r in rows} == {True, False}


def semantic_dlp(rows, spark, small, con):
    overlay = {k for k in _ids(con, "turns") if k % 16 == 8}  # a sentence about a synthesis and a proprietary formula
    secret = {r.prompt_id for r in rows if r.label == "Trade Secret"}
    assert overlay & secret and all(0 < r.score <= 1 and 0 < r.semantic_sensitivity <= 10 and r.concept for r in rows)


def hash_embeddings(rows, spark, small, con):
    assert sorted(r.prompt_id for r in rows) == _ids(con, "turns")
    assert all(r.norm == (1.0 if r.n_buckets else 0.0) for r in rows) and any(r.n_buckets > 20 for r in rows)


def gateway_decisions(rows, spark, small, con):
    assert sorted(r.prompt_id for r in rows) == _ids(con, "prompts")
    assert len({r.action for r in rows}) >= 3
    for r in rows:
        assert (r.route is not None) == (r.action == "AI_QUERY") and re.fullmatch(r"[0-9a-f]{64}", r.prompt_hash)
        assert r.action not in ("PROMPT_BLOCKED", "PROMPT_INJECTION_BLOCKED") or r.policy_triggered


def gateway_simulation(rows, spark, small, con):
    assert sorted(r.prompt_id for r in rows) == _ids(con, "prompts")
    assert {r.action for r in rows} == {"block", "redact", "warn"}
    assert all(r.recommended_route == ("local_airgap" if r.risk_score > 7 else "policy_default") for r in rows)


def redaction_proofs(rows, spark, small, con):
    assert sorted(r.prompt_id for r in rows) == _ids(con, "turns")
    assert all(r.route == ("ollama/local-airgapped" if r.proof_score >= 7 else "cloud_or_hybrid_allowed") for r in rows)


def _numbered(rows, key):
    chunks = {}
    for r in rows:
        chunks.setdefault(r[key], []).append(r.chunk_no)
    return {k: sorted(v) == list(range(len(v))) for k, v in chunks.items()}


def chunk_separators(rows, spark, small, con):
    numbered, length = _numbered(rows, "doc_id"), {}
    for r in rows:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.n_chars
        assert 0 < r.n_chars <= 1000
    texts = dict(con.execute("SELECT doc_id, length(text) FROM documents WHERE trim(text) <> ''").fetchall())
    assert all(numbered.values()) and set(numbered) == set(texts)
    assert all(length[d] >= 0.9 * n for d, n in texts.items())


def ingest_index(rows, spark, small, con):
    assert all(_numbered(rows, "doc_id").values()) and {r.dims for r in rows} == {384}
    assert all(r.alert == (r.risk > 7) for r in rows)


def rag_context(rows, spark, small, con):
    assert sorted(r.prompt_id for r in rows) == _ids(con, "turns") and all(r.context_chars > 0 for r in rows)


def evidence_report(rows, spark, small, con):
    again = QUERIES["evidence_report"](spark, small).collect()
    assert [r.certificate for r in rows] == [r.certificate for r in again] and re.fullmatch(r"[0-9a-f]{64}", rows[0].certificate)


CHECKS = {
    f.__name__: f
    for f in (
        pseudonym_vault, governed_prompts, semantic_dlp, hash_embeddings, gateway_decisions, gateway_simulation, redaction_proofs,
        chunk_separators, ingest_index, rag_context, evidence_report,
    )
}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_without_sql(spark, small, con, name):
    CHECKS[name](QUERIES[name](spark, small).collect(), spark, small, con)
