"""Retention, consent, incidents, scorecards and licenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from .running import running_sums

# Fixed values.
RETENTION_DAYS = {"SENSITIVE": 90, "PERSONAL": 365, "HEALTH": 730, "FINANCIAL": 2555}
DEFAULT_RETENTION = 365
REQUEST_SLA_DAYS, NOTIFICATION_HOURS, CONSENT_DAYS = 30, 72, 365
INCIDENT_PENALTY = 15
DPDP_SECTION = "Section 8 — Notice of personal data breach"
PURPOSES = {
    "HR_PROCESSING": "Processing employee personal data for HR operations",
    "PATIENT_CARE": "Processing patient health data for medical care",
    "LEGAL_REPRESENTATION": "Processing client data for legal services",
    "MARKETING": "Sending promotional communications",
    "ANALYTICS": "Aggregated analytics and reporting",
    "THIRD_PARTY_SHARE": "Sharing data with authorized third parties",
    "BACKGROUND_CHECK": "Employee background verification",
}


def _at(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def _lookup(table: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def retention_check(records: DataFrame, as_of: str, category: str = "category", stored_at: str = "stored_at") -> DataFrame:
    """Age in whole days elapsed (not midnights) against the limit of the category."""
    limit = _lookup(RETENTION_DAYS, F.col(category), F.lit(DEFAULT_RETENTION))
    age = F.floor((F.unix_micros(_at(as_of)) - F.unix_micros(stored_at)) / F.lit(86_400_000_000)).cast("int")
    return records.withColumns(
        {
            "age_days": age,
            "max_days": limit,
            "must_delete": age > limit,
            "days_remaining": F.greatest(F.lit(0), limit - age),
        }
    )


def _id(parts: Column, length: int) -> Column:
    return F.substring(sha256(parts), 1, length)


def principal_requests(
    df: DataFrame, as_of: str, principal: str = "principal_id", request_type: str = "request_type", filed_at: str = "filed_at"
) -> DataFrame:
    """Requests of data principals with hashed identity, deadline and overdue flag."""
    who = F.substring(sha256(F.col(principal).cast("string")), 1, 16)
    deadline = F.col(filed_at) + F.expr(f"INTERVAL {REQUEST_SLA_DAYS} DAYS")
    kind = F.upper(request_type)
    return df.withColumns(
        {
            "principal_id_hash": who,
            "request_type": kind,
            "status": F.lit("PENDING"),
            "sla_deadline": deadline,
            "request_id": _id(F.concat_ws("|", who, kind, F.unix_micros(filed_at).cast("string")), 12),
            "overdue": _at(as_of) > deadline,
        }
    )


def incident_reports(df: DataFrame, description: str = "description", at: str = "ts", is_test: str = "is_test") -> DataFrame:
    return df.withColumns(
        {
            "report_id": F.upper(_id(F.concat(F.unix_micros(at).cast("string"), F.col(description)), 12)),
            "notification_due_by": F.col(at) + F.expr(f"INTERVAL {NOTIFICATION_HOURS} HOURS"),
            "status": F.when(F.coalesce(F.col(is_test), F.lit(False)), "TEST_MODE").otherwise("PENDING_SUBMISSION"),
            "dpdp_section": F.lit(DPDP_SECTION),
        }
    )


def grade(score: Column, with_d: bool = False) -> Column:
    g = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C")
    return (g.when(score >= 40, "D") if with_d else g).otherwise("F")


def dpdp_score(incidents: DataFrame, *by: str, status: str = "status") -> DataFrame:
    open_ = F.count_if(F.contains(F.coalesce(F.col(status), F.lit("")), F.lit("PENDING")))
    base = F.lit(100) - F.col("open_incidents") * INCIDENT_PENALTY
    return (
        incidents.groupBy(*by)
        .agg(open_.alias("open_incidents"), F.count("*").alias("total_incidents"))
        .withColumns({"dpdp_score": F.greatest(F.lit(0), base), "grade": grade(base)})
    )


# ---- consent --------------------------------------------------------------


def principal_hash(principal: Column) -> Column:
    return F.substring(sha256(principal.cast("string")), 1, 20)


def record_consents(df: DataFrame, principal: str = "principal_id", purpose: str = "purpose", at: str = "ts", days: int = CONSENT_DAYS) -> DataFrame:
    return df.withColumns(
        {
            "consent_id": _id(F.concat(F.col(principal).cast("string"), F.col(purpose), F.unix_micros(at).cast("string")), 16),
            "principal_hash": principal_hash(F.col(principal)),
            "purpose_description": _lookup(PURPOSES, F.col(purpose), F.col(purpose)),
            "expires_at": F.col(at) + F.make_dt_interval(F.lit(days)),
            "revoked": F.lit(False),
        }
    ).drop(principal)


def consent_check(requests: DataFrame, consents: DataFrame, as_of: str, keys: tuple[str, ...] = ("principal_hash", "purpose"), seq: str = "seq") -> DataFrame:
    """The newest consent that decides each request.

    A refusal that is neither revoked nor expired decides nothing: older
    records are looked at. What decides a key is a maximum, so a busy
    principal is reduced before the shuffle.
    """
    now = _at(as_of)
    state = (
        F.when(F.coalesce("revoked", F.lit(False)), "REVOKED")
        .when(now > F.col("expires_at"), "EXPIRED")
        .when(F.col("granted"), "VALID")
    )
    newest = (
        consents.withColumn("__state", state)
        .where("__state IS NOT NULL")
        .groupBy(*keys)
        .agg(F.max_by(F.struct("consent_id", "__state", "expires_at"), seq).alias("__c"))
    )
    joined = requests.join(newest, list(keys), "left")
    reason = F.coalesce("__c.__state", F.lit("NOT_FOUND"))
    return joined.withColumns(
        {
            "has_consent": reason == "VALID",
            "reason": reason,
            "consent_id": F.col("__c.consent_id"),
            "expires_at": F.when(reason == "VALID", F.col("__c.expires_at")),
        }
    ).drop("__c")


def revoke_consents(consents: DataFrame, revocations: DataFrame, at: str = "revoked_at", why: str = "revoke_reason") -> DataFrame:
    """Mark consents by id. With several revocations of one id the latest stays."""
    once = revocations.groupBy("consent_id").agg(
        F.max(at).alias("__at"), F.max_by(F.coalesce(F.col(why), F.lit("DATA_PRINCIPAL_REQUEST")), at).alias("__why")
    )
    out = consents.join(once, "consent_id", "left").withColumns(
        {
            "revoked": F.coalesce("revoked", F.lit(False)) | F.col("__at").isNotNull(),
            at: F.coalesce("__at", F.col(at)) if at in consents.columns else F.col("__at"),
            why: F.coalesce("__why", F.col(why)) if why in consents.columns else F.col("__why"),
        }
    )
    return out.drop("__at", "__why")


def consents_for(consents: DataFrame, principals: DataFrame, principal: str = "principal_id") -> DataFrame:
    """All records of the given principals (right of access)."""
    wanted = principals.select(principal_hash(F.col(principal)).alias("principal_hash"))
    return consents.join(wanted, "principal_hash", "left_semi")


# ---- scorecard ------------------------------------------------------------


def compliance_scorecard(stats: DataFrame, is_global: bool = False) -> DataFrame:
    """Framework scores, composite and grades from one row of inputs per scope.

    Inputs: total_events, total_redactions, high_risk_events, chain_integrity,
    dpdp_score, active_policies, open_incidents, mfa_enabled_pct.
    """
    c = F.col
    minus = lambda cond, n: F.when(cond, n).otherwise(0)
    broken = ~c("chain_integrity")
    hipaa = (
        F.lit(100)
        - minus(broken, 40)
        - minus((c("total_redactions") == 0) & (c("total_events") > 5), 15)
        - c("open_incidents") * 10
        - minus(c("mfa_enabled_pct") < 80, 10)
    )
    gdpr = F.lit(100) - minus(broken, 35) - minus(c("active_policies") < 1, 20) - c("open_incidents") * 8
    iso = (
        F.lit(100)
        - minus(broken, 30)
        - minus(c("active_policies") < 3, 15)
        - minus(c("mfa_enabled_pct") < 50, 20)
        - minus(c("open_incidents") > 2, 25)
    )
    floor = lambda x: F.greatest(F.lit(0), x).cast("bigint")
    scored = stats.withColumns(
        {"hipaa": floor(hipaa), "dpdp_2026": F.coalesce(c("dpdp_score"), F.lit(100)).cast("bigint"), "gdpr_lite": floor(gdpr), "iso_27001_lite": floor(iso)}
    )
    if is_global:
        # Hundredths, so that a half is exact before it is rounded to even.
        mean = (c("hipaa") * 35 + c("gdpr_lite") * 35 + c("iso_27001_lite") * 20 + c("dpdp_2026") * 10) / F.lit(100.0)
    else:
        mean = (c("hipaa") + c("dpdp_2026") + c("gdpr_lite") + c("iso_27001_lite")) / F.lit(4.0)
    scored = scored.withColumn("composite_score", F.bround(mean, 0).cast("bigint"))
    grades = {f"{f}_grade": grade(c(f)) for f in ("hipaa", "dpdp_2026", "gdpr_lite", "iso_27001_lite")}
    return scored.withColumns(
        {
            "grade": grade(c("composite_score"), with_d=True),
            **grades,
            "zero_incident_badge": (c("open_incidents") == 0) & c("chain_integrity"),
            "high_risk_blocked": c("high_risk_events"),
        }
    )


# ---- licenses and keys ----------------------------------------------------


def license_status(requests: DataFrame, licenses: DataFrame, as_of: str, key: str = "license_key") -> DataFrame:
    """Reason of each validation request, checks in order; the license side has one row per key."""
    lic = licenses.select(
        key, "is_active", "expires_at", F.col("hardware_id").alias("__hw"), "seats_total", "seats_used", F.lit(True).alias("__found")
    )
    asked, locked = F.nullif("hardware_id", F.lit("")), F.nullif("__hw", F.lit(""))
    reason = (
        F.when(F.col("__found").isNull(), "KEY_NOT_FOUND")
        .when(~F.coalesce("is_active", F.lit(False)), "DEACTIVATED")
        .when(_at(as_of) > F.col("expires_at"), "EXPIRED")
        .when(asked.isNotNull() & locked.isNotNull() & (asked != locked), "HARDWARE_MISMATCH")
        .otherwise("VALID")
    )
    return requests.join(lic, key, "left").withColumns({"reason": reason, "valid": reason == "VALID"}).drop("__hw", "__found")


def license_activate(requests: DataFrame, licenses: DataFrame, as_of: str, key: str = "license_key", seq: str = "seq", width: int = 100_000) -> DataFrame:
    """Seat by seat outcome of activation requests, in ``seq`` order per key.

    Checks in order: found, active, expired, seats, hardware. A mismatch uses
    no seat, so the seats taken before a request are a running count of the
    requests with the right hardware.
    """
    lic = licenses.select(
        key, "is_active", "expires_at", F.col("hardware_id").alias("__hw"), "seats_total", "seats_used", F.lit(True).alias("__found")
    )
    early = (
        F.when(F.col("__found").isNull(), "KEY_NOT_FOUND")
        .when(~F.coalesce("is_active", F.lit(False)), "DEACTIVATED")
        .when(_at(as_of) > F.col("expires_at"), "EXPIRED")
    )
    locked = F.nullif("__hw", F.lit(""))
    fits = locked.isNull() | F.coalesce(locked == F.col("hardware_id"), F.lit(False))
    rows = requests.join(lic, key, "left").withColumn("__early", early).withColumn(
        "__take", (F.col("__early").isNull() & fits).cast("bigint")
    )
    counted = running_sums(rows, [key], seq, {"__upto": "__take"}, width)
    taken = F.col("seats_used") + F.col("__upto") - F.col("__take")
    outcome = F.coalesce(
        "__early",
        F.when(taken >= F.col("seats_total"), "SEATS_FULL").when(F.col("__take") == 0, "HARDWARE_MISMATCH").otherwise("ACTIVATED"),
    )
    return counted.withColumns(
        {
            "outcome": outcome,
            "seats_remaining": F.when(outcome == "ACTIVATED", F.col("seats_total") - taken - 1),
        }
    ).drop("__hw", "__found", "__early", "__take", "__upto")


def api_key_status(keys: DataFrame, as_of: str, scope: str = "proxy:inspect") -> DataFrame:
    granted = F.array_contains("scopes", scope) | F.array_contains("scopes", "*")
    status = (
        F.when(~F.coalesce("is_active", F.lit(False)), "API_KEY_INVALID")
        .when(F.col("expires_at") < _at(as_of), "API_KEY_EXPIRED")
        .when(~F.coalesce(granted, F.lit(False)), "API_KEY_SCOPE_DENIED")
        .otherwise("OK")
    )
    return keys.withColumn("status", status)
