"""Actor risk over trailing hours, quarantine, heatmap and alerts.

Event frames carry ``actor_hash, ts TIMESTAMP, severity DOUBLE`` and the three
flags ``is_pii, is_injection, is_semantic``; ``labels`` is optional.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import actor_hash
from ..functions.patterns import INDIA_PII, PII, PROMPT_INJECTION, SECRET, SEMANTIC_DLP
from .running import running_sums

# Fixed values of the score and the alerts.
HOUR_US = 3_600_000_000
RETENTION_US = 7 * 24 * HOUR_US
SEVERITY_CAP, SCORE_CAP = 10.0, 100.0
PII_WEIGHT, INJECTION_WEIGHT, SEMANTIC_WEIGHT, QUARANTINE_BONUS = 8, 12, 10, 25
PII_LIMIT = 3
QUARANTINE_REASON = "PII_ATTEMPTS_EXCEEDED_3_PER_HOUR"
ALERT_SCORE = 50.0
PII_TYPES = (PII, INDIA_PII, SECRET)

# Sums of severities are exact decimals, so that their order does not matter.
_MONEY = "decimal(28,8)"
SEVERITY_UNITS = 100_000_000
_FLAGS = {"pii": "is_pii", "inj": "is_injection", "sem": "is_semantic"}


def event_flags(types: Column, event_type: Column | None = None) -> dict[str, Column]:
    """Flags of an event from its set of finding types (and its main type)."""

    def has(*names: str) -> Column:
        hit = F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(n) for n in names])), F.lit(False))
        return hit if event_type is None else hit | F.coalesce(event_type.isin(*names), F.lit(False))

    return {"is_pii": has(*PII_TYPES), "is_injection": has(PROMPT_INJECTION), "is_semantic": has(SEMANTIC_DLP)}


def event_type(types: Column) -> Column:
    f = event_flags(types)
    return (
        F.when(f["is_injection"], PROMPT_INJECTION)
        .when(f["is_semantic"], SEMANTIC_DLP)
        .when(f["is_pii"], "PII_ATTEMPT")
        .otherwise("POLICY_EVENT")
    )


def to_risk_events(
    df: DataFrame, *keep: str, findings: str = "findings", actor: str = "actor", tenant: str = "tenant_id", salt: str = "", score: str = "risk_score",
    ts: str = "ts",
) -> DataFrame:
    """One event per request, from the findings in its row."""
    types = F.array_sort(F.array_distinct(F.transform(findings, lambda f: F.upper(F.coalesce(f["type"], F.lit(""))))))
    labels = F.array_sort(
        F.array_distinct(F.transform(findings, lambda f: F.coalesce(f["label"], f["type"], F.lit("UNKNOWN"))))
    )
    return df.select(
        *keep,
        F.col(ts).alias("ts"),
        actor_hash(F.col(actor), F.col(tenant), salt).alias("actor_hash"),
        event_type(types).alias("event_type"),
        types.alias("event_types"),
        F.col(score).cast("double").alias("severity"),
        labels.alias("labels"),
        *[c.alias(n) for n, c in event_flags(types).items()],
    )


def risk_score(severity_sum: Column, pii: Column, inj: Column, sem: Column) -> Column:
    """Score from an exact severity sum and three counts."""
    total = (
        severity_sum
        + pii * PII_WEIGHT
        + inj * INJECTION_WEIGHT
        + sem * SEMANTIC_WEIGHT
        + F.when(pii > PII_LIMIT, QUARANTINE_BONUS).otherwise(0)
    )
    return F.least(F.lit(SCORE_CAP), F.round(total.cast("decimal(36,8)"), 2).cast("double"))


def _capped(severity: Column) -> Column:
    return F.least(F.lit(SEVERITY_CAP), severity).cast(_MONEY)


def severity_units(severity: Column) -> Column:
    """The capped severity as a whole number of ``1 / SEVERITY_UNITS``, for sums in state."""
    return (_capped(severity) * SEVERITY_UNITS).cast("bigint")


def _profile_columns(sev: Column, pii: Column, inj: Column, sem: Column) -> dict[str, Column]:
    return {
        "risk_score": risk_score(sev, pii, inj, sem),
        "pii_attempts_last_hour": pii,
        "injection_attempts_last_hour": inj,
        "semantic_hits_last_hour": sem,
        "quarantined": pii > PII_LIMIT,
        "quarantine_reason": F.when(pii > PII_LIMIT, QUARANTINE_REASON),
    }


def risk_as_of_event(
    events: DataFrame, *keep: str, cell_us: int = 60_000_000, window_us: int = HOUR_US, one_by_one: bool = False
) -> DataFrame:
    """Profile of the actor at each event, over the hour that ends with it.

    Each event adds its values at its time and takes them back just after an
    hour: the trailing sum is then a running sum, which splits an actor into
    cells of time however busy the actor is. Events of one instant see each
    other; with ``one_by_one`` they are judged in the order of ``keep``.
    """
    us = F.unix_micros("ts")
    one = lambda c, sign: (F.coalesce(F.col(c), F.lit(False)).cast("bigint") * sign).alias(c)

    def delta(time: Column, sign: int) -> Column:
        return F.struct(
            time.alias("us"),
            F.lit(sign > 0).alias("real"),
            (_capped(F.col("severity")) * sign).cast(_MONEY).alias("sev"),
            *[one(c, sign) for c in _FLAGS.values()],
        )

    carried = [F.when(F.col("d.real"), F.col(k)).alias(k) for k in keep]
    both = events.withColumn("d", F.explode(F.array(delta(us, 1), delta(us + window_us + 1, -1)))).select(
        "actor_hash", *carried, "d.*"
    )
    sums = running_sums(both, ["actor_hash"], "us", {"_sev": "sev", "_pii": "is_pii", "_inj": "is_injection", "_sem": "is_semantic"}, cell_us, ties=("real", *keep) if one_by_one else ())
    cols = _profile_columns(*[F.col(c) for c in ("_sev", "_pii", "_inj", "_sem")])
    return sums.where("real").select(
        *keep, "actor_hash", F.timestamp_micros("us").alias("ts"), *[c.alias(n) for n, c in cols.items()]
    )


def risk_profile(events: DataFrame, as_of: str, *by: str) -> DataFrame:
    """Profile per actor for the hour that ends at ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    recent = events.where((F.col("ts") >= end - F.expr("INTERVAL 1 HOUR")) & (F.col("ts") <= end))
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint"))
    aggs = [F.sum(_capped(F.col("severity"))).alias("_sev")]
    aggs += [count(c).alias(f"_{n}") for n, c in _FLAGS.items()]
    aggs.append(F.max("ts").alias("last_seen"))
    if "labels" in events.columns:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"))
    cols = _profile_columns(*[F.col(c) for c in ("_sev", "_pii", "_inj", "_sem")])
    return recent.groupBy(*by, "actor_hash").agg(*aggs).withColumns(cols).drop("_sev", "_pii", "_inj", "_sem")


def quarantine(profiles: DataFrame) -> DataFrame:
    return profiles.where("quarantined")


def heatmap(profiles: DataFrame, limit: int = 100) -> DataFrame:
    """Actors by score; ties by hash. ``limit`` is the size of the report."""
    return profiles.orderBy(F.col("risk_score").desc(), "actor_hash").limit(limit)


def quarantined_count(profiles: DataFrame) -> DataFrame:
    """Over all actors, whatever the size of the heatmap."""
    return profiles.agg(F.count_if("quarantined").alias("quarantined_users"))


def quarantined_actors(heat: DataFrame) -> DataFrame:
    return heat.where("quarantined")


def is_loud() -> Column:
    """Whether a profile raises an alert."""
    return F.col("quarantined") | (F.col("risk_score") >= ALERT_SCORE) | (F.col("injection_attempts_last_hour") > 0)


def alerts(heat: DataFrame) -> DataFrame:
    q = F.col("quarantined")
    return heat.where(is_loud()).select(
        F.col("actor_hash").alias("id"),
        F.when(q, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.when(q, "AUTO_QUARANTINE").otherwise("RISK_SPIKE").alias("type"),
        "actor_hash",
        "risk_score",
        F.coalesce("quarantine_reason", F.lit("High-risk activity detected")).alias("reason"),
        F.col("last_seen").alias("created_at"),
        F.lit("OPEN").alias("status"),
    )


def retain_events(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def throttle_daily(alert_rows: DataFrame, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The first alert of each day: a minimum, so no day is ever sorted."""
    row = F.struct(*alert_rows.columns)
    return (
        alert_rows.groupBy(F.to_date(ts).alias("__day"))
        .agg(F.min_by(row, F.struct(ts, tie)).alias("r"))
        .select("r.*")
    )


def actor_rollup(
    events: DataFrame,
    actor: str = "actor",
    ts: str = "ts",
    risk: str = "risk_score",
    detection: str = "detection_type",
    kind: str = "event",
    policy: str = "policy",
    pii_count: str = "pii_count",
    limit: int = 10,
) -> DataFrame:
    """Totals per actor without a window; labels in the order they first occur."""
    risk5 = (F.coalesce(F.col(risk), F.lit(0.0)) * 5).cast(_MONEY)
    per_label = events.groupBy(actor, detection).agg(
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        F.sum(risk5).alias("risk"),
        F.sum(F.coalesce(F.col(pii_count), F.lit(0)).cast("bigint")).alias("pii"),
        F.count("*").alias("n"),
        F.max_by(policy, F.when(F.col(kind) == "AUTO_QUARANTINE", F.col(ts))).alias("policy"),
        F.count_if(F.col(kind) == "AUTO_QUARANTINE").alias("nq"),
        F.max(F.when(F.col(kind) == "AUTO_QUARANTINE", F.col(ts))).alias("last_q"),
    )
    typed = lambda name: F.coalesce(F.sum(F.when(F.col(detection) == name, F.col("n"))), F.lit(0))
    return (
        per_label.groupBy(actor)
        .agg(
            F.least(F.lit(SCORE_CAP), F.round(F.sum("risk"), 2).cast("double")).alias("risk_score"),
            F.sum("pii").alias("pii_attempts_last_hour"),
            typed("Prompt Injection").alias("injection_attempts_last_hour"),
            typed("Trade Secret Context").alias("semantic_hits_last_hour"),
            (F.sum("nq") > 0).alias("quarantined"),
            F.max_by("policy", "last_q").alias("quarantine_reason"),
            F.max("last").alias("last_seen"),
            F.transform(F.array_sort(F.collect_list(F.struct("first", detection))), lambda s: s[detection]).alias("labels"),
        )
        .withColumn("actor_hash", F.sha2(F.col(actor), 256))
        .orderBy(F.col("risk_score").desc(), "actor_hash")
        .limit(limit)
    )
