"""What the gateway decides for every prompt of a table.

``assess`` works row by row on the texts and leaves only slim facts; the one
order-dependent step, the trailing hour of the actor, runs on those facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import actor_hash, hash_text
from ..functions.patterns import ALL_PATTERNS
from ..operators.adversarial import guardian_scan, injection_risk, scan_injection
from ..operators.detect import order_findings, scan, with_probes, without_probes
from ..operators.mask import (
    govern_policy_name,
    model_route,
    proof_score,
    pseudonymize,
    request_risk,
    route,
    scanner_risk,
    sensitivity_score,
)
from ..operators.policy import decide, match_rules
from ..operators.risk import PII_TYPES, risk_as_of_event
from ..operators.semantic import semantic_scan, semantic_sensitivity
from ..schemas import FINDINGS
from ..session import cut

INJECTION_POLICY = "LLM_FINGERPRINT_PROMPT_INJECTION"
# Outcomes in the order in which they are checked.
QUARANTINED, INJECTION, BLOCKED, MODEL_REFUSED, ALLOWED = (
    "USER_AUTO_QUARANTINED",
    "PROMPT_INJECTION_BLOCKED",
    "PROMPT_BLOCKED",
    "MODEL_NOT_ALLOWED",
    "AI_QUERY",
)


def detect_all(df: DataFrame, text: str = "text", semantic: bool = True, guardian: bool = True) -> DataFrame:
    """All detectors on one text column, as separate columns."""
    found = scan(with_probes(df, text), text, ALL_PATTERNS, "findings")
    found = scan_injection(found, text)
    if guardian:
        found = guardian_scan(found, text)
    found = without_probes(found)
    if semantic:
        return semantic_scan(found, text)
    return found.withColumn("semantic_findings", F.array().cast(FINDINGS))


def _labels(guardian: bool) -> Column:
    parts = [F.transform(c, lambda f: f["label"]) for c in ("findings", "semantic_findings", "injection_findings")]
    if guardian:
        parts.append(F.when(F.col("guardian.blocked"), F.col("guardian.labels")).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def assess(
    prompts: DataFrame,
    rules: Sequence[dict] | None = None,
    text: str = "text",
    semantic: bool = True,
    guardian: bool = True,
    protected: bool = False,
    drop_text: bool = True,
) -> DataFrame:
    """Scores, flags, rule decision and pseudonym tokens of every prompt."""
    found = detect_all(prompts, text, semantic, guardian)
    risk = request_risk(
        scanner_risk("findings"),
        semantic_sensitivity(),
        injection_risk(),
        F.col("guardian.score") if guardian else None,
    )
    blocked = F.col("guardian.blocked") if guardian else F.lit(False)
    scored = found.withColumns(
        {
            "risk_score": risk,
            "sensitivity_score": sensitivity_score("findings"),
            "labels": _labels(guardian),
            "is_pii": F.exists("findings", lambda f: f["type"].isin(*PII_TYPES)),
            "is_injection": (F.size("injection_findings") > 0) | blocked,
            "is_semantic": F.size("semantic_findings") > 0,
            "n_findings": F.size("findings") + F.size("semantic_findings") + F.size("injection_findings"),
            "prompt_hash": hash_text(F.col(text)),
        }
    )
    decided = decide(match_rules(scored, rules, text))
    ordered = decided.withColumn("findings", order_findings("findings"))
    masked = pseudonymize(ordered, text, "findings", "protected_text", "pseudonyms", None)
    named = masked.withColumn(
        "governance", govern_policy_name(F.size("findings"), F.col("sensitivity_score"), F.col("department"))
    )
    gone = ["findings", "semantic_findings", "injection_findings", "guardian", "matched"]
    if not protected:
        gone.append("protected_text")
    if drop_text:
        gone.append(text)
    return named.drop(*gone)


def gateway_decide(
    prompts: DataFrame,
    rules: Sequence[dict] | None = None,
    history: DataFrame | None = None,
    key: str = "prompt_id",
    salt: str = "",
    semantic: bool = True,
    local_model: str = "llama3.1",
) -> DataFrame:
    """One ledger row per prompt: quarantine, injection, policy, model, or passed on.

    Prompts of an actor with one timestamp are judged one by one in the order of ``key``.
    ``history`` may add earlier events of the same actors. Facts are cut to the
    checkpoint folder, because the trailing hour reads them more than once and
    the scan is the expensive part.
    """
    facts = assess(prompts, rules, semantic=semantic)
    facts = facts.withColumn("actor_hash", actor_hash(F.col("actor"), F.col("tenant_id"), salt))
    facts = cut(facts)
    flags = ["is_pii", "is_injection", "is_semantic"]
    events = facts.select(key, "actor_hash", "ts", F.col("risk_score").alias("severity"), *flags)
    if history is not None:
        past = history.select(F.lit(None).cast(facts.schema[key].dataType).alias(key), "actor_hash", "ts", "severity", *flags)
        events = events.unionByName(past)
    profile = risk_as_of_event(events, key, one_by_one=True).where(F.col(key).isNotNull())
    held = profile.select(key, F.col("risk_score").alias("user_risk_score"), "quarantined", "quarantine_reason")
    rows = facts.join(held, key)
    d = F.col("decision")
    outcome = (
        F.when(F.col("quarantined"), QUARANTINED)
        .when(F.col("is_injection"), INJECTION)
        .when(d["action"] == "block", BLOCKED)
        .when(~d["model_allowed"], MODEL_REFUSED)
        .otherwise(ALLOWED)
    )
    final = F.greatest("risk_score", "sensitivity_score")
    rows = rows.withColumns({"action": outcome, "__final": final})
    rows = model_route(rows, score="__final", local_model=local_model)
    a = F.col("action")
    triggered = F.when(F.size(d["triggered_rules"]) > 0, F.array_join(d["triggered_rules"], ", "))
    return rows.select(
        key,
        "ts",
        "tenant_id",
        "actor",
        "actor_hash",
        F.coalesce("department", F.lit("UNKNOWN")).alias("department"),
        "action",
        F.when(a == QUARANTINED, F.col("quarantine_reason"))
        .when(a == INJECTION, INJECTION_POLICY)
        .when(a == BLOCKED, d["block_reason"])
        .when(a == ALLOWED, triggered)
        .alias("policy_triggered"),
        F.when(a == BLOCKED, F.col("preferred_model")).when(a == ALLOWED, F.col("model_used")).alias("model_queried"),
        F.when(a.isin(ALLOWED, MODEL_REFUSED), F.col("__final")).otherwise(F.col("risk_score")).alias("risk_score"),
        "user_risk_score",
        F.when(a == BLOCKED, d["triggered_rules"])
        .when(a == ALLOWED, F.col("pseudonyms"))
        .otherwise(F.array().cast("array<string>"))
        .alias("redactions_applied"),
        F.when(a == ALLOWED, route("__final")).alias("route"),
        d["warnings"].alias("policy_warnings"),
        "prompt_hash",
        "sensitivity_score",
    )


def simulate(prompts: DataFrame, rules: Sequence[dict] | None = None, key: str = "prompt_id", semantic: bool = True) -> DataFrame:
    """Dry run without guardian and history: what would the rules do?"""
    facts = assess(prompts, rules, semantic=semantic, guardian=False, protected=True)
    total = F.greatest("risk_score", "sensitivity_score")
    d = F.col("decision")
    return facts.select(
        key,
        d["action"].alias("action"),
        total.alias("risk_score"),
        d["triggered_rules"].alias("triggered_rules"),
        d["warnings"].alias("warnings"),
        d["model_allowed"].alias("model_allowed"),
        route(total, "simulate").alias("recommended_route"),
        F.col("protected_text").alias("redacted_preview"),
        F.col("n_findings").alias("findings_count"),
    )


def redaction_proof(df: DataFrame, *keep: str, text: str = "text", with_guardian: bool = False) -> DataFrame:
    """Highest of the separate scores and the route that the proof surface reports."""
    found = detect_all(df, text, guardian=with_guardian)
    scores = [sensitivity_score("findings"), semantic_sensitivity(), injection_risk()]
    if with_guardian:
        scores.append(F.col("guardian.score"))
    scored = found.withColumn("proof_score", proof_score(*scores))
    return scored.select(*keep, "proof_score", route("proof_score", "proof").alias("route"))
