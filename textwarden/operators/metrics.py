"""Dashboard figures, event fixtures and routing of events to hooks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..functions.hashing import hmac_pads, hmac_sha256

# Fixed values.
BLOCKING_EVENTS = ("PROMPT_INJECTION_BLOCKED", "SEMANTIC_DLP_BLOCKED", "HIGH_SENSITIVITY_LOCAL_ROUTE", "AUTO_QUARANTINE")
MASKED_EVENT = "PII_MASKED_BEFORE_LLM"
HIGH_RISK = 7.0
# Hooks of one list, about.
HOOKS = 1000
DETECTIONS = (
    ("Aadhaar", "pseudonymized", "[Aadhaar_1]"),
    ("PAN", "pseudonymized", "[PAN_1]"),
    ("GST", "pseudonymized", "[GST_1]"),
    ("Bank Account", "pseudonymized", "[BankAccount_1]"),
    ("Prompt Injection", "blocked", "LLM_FINGERPRINT_PROMPT_INJECTION"),
    ("Trade Secret Context", "local_only", "SEMANTIC_DLP_HIGH"),
)


def hourly_series(events: DataFrame, last: int = 12) -> DataFrame:
    """Blocked events, personal-data counts and mean risk of the last hours with events."""
    return (
        events.groupBy(F.date_trunc("hour", "ts").alias("hour"))
        .agg(
            F.count_if(F.col("event").isin(*BLOCKING_EVENTS)).alias("blocked"),
            F.sum(F.col("pii_count").cast("bigint")).alias("pii"),
            F.round(F.avg(F.col("risk_score").cast("decimal(28,8)")), 2).cast("double").alias("risk"),
        )
        .orderBy(F.col("hour").desc())
        .limit(last)
    )


def detection_counts(events: DataFrame) -> DataFrame:
    dim = events.sparkSession.createDataFrame(list(DETECTIONS), "type string, action string, sample_token string")
    counts = events.groupBy(F.col("detection_type").alias("type")).agg(F.count("*").alias("n"))
    return dim.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("count"), "action", "sample_token")


def event_summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event") != MASKED_EVENT).alias("blocked"),
        F.coalesce(F.sum(F.col("pii_count").cast("bigint")), F.lit(0)).alias("pii_detections"),
        F.count_if(F.col("risk_score") >= HIGH_RISK).alias("high_sensitivity_routes"),
    )


def recent_events(events: DataFrame, limit: int = 25, tie: str = "event_id") -> DataFrame:
    return events.orderBy(F.col("ts").desc(), F.col(tie).desc()).limit(limit)


def snapshot(**figures: DataFrame) -> DataFrame:
    """One row from several one-row frames, without joining them.

    Each frame becomes ``(name, JSON)`` rows; one aggregation puts them side by side.
    """
    rows = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("k"), F.to_json(F.struct("*")).alias("v")) for name, df in figures.items()],
    )
    return rows.agg(*[F.max(F.when(F.col("k") == name, F.col("v"))).alias(name) for name in figures])


# ---- hooks ----------------------------------------------------------------


def route_webhooks(events: DataFrame, hooks: DataFrame, *keep: str, event_type: str = "event_type") -> DataFrame:
    """Deliveries: active hooks of the tenant that list the event's type.

    The lists of the hooks are exploded, so this is an equality join. An event
    says the same to all hooks that share a secret: its body is written and
    digested before the join and signed once per ``HOOKS`` of them, and only
    then come the rows of the single hooks, which may be very many.
    """
    h = hooks.where("active").select(
        F.struct("hook_id", "target_url").alias("__hook"),
        F.coalesce("tenant_id", F.lit("default")).alias("__tenant"),
        F.array_distinct("event_types").alias("__types"),
        F.coalesce("secret", F.lit("")).alias("__secret"),
    )
    h = explode_rows(h, ("__hook", "__tenant", "__secret"), "__types", "__type")
    same = ["__tenant", "__type", "__secret"]
    shares = h.groupBy(*same).agg((F.floor(F.count(F.lit(1)) / HOOKS) + 1).alias("__shares"))
    dealt = h.join(shares, same).withColumn("__share", F.pmod(F.xxhash64("__hook"), F.col("__shares")))
    # Key blocks are worked out per group of hooks, before the join multiplies the rows.
    groups = dealt.groupBy(*same, "__share").agg(F.collect_list("__hook").alias("__hooks"))
    groups = groups.select("__tenant", "__type", "__hooks", F.when(F.col("__secret") != "", hmac_pads(F.col("__secret"))).alias("__pads"))
    body = F.to_json(
        F.struct(
            F.col(event_type).alias("event_type"), "tenant_id", F.col("ts").cast("string").alias("timestamp"), "payload"
        )
    )
    said = events.select(*keep, F.col("tenant_id").alias("__tenant"), F.col(event_type).alias("__type"), body.alias("body"))
    said = said.withColumn("body_sha", F.sha2("body", 256))
    signature = F.concat(F.lit("sha256="), hmac_sha256(F.col("body"), F.col("__pads")))
    signed = said.join(groups, ["__tenant", "__type"]).select(*keep, "body", "body_sha", signature.alias("signature"), "__hooks")
    rows = signed.select(*keep, "body", "body_sha", "signature", F.explode("__hooks").alias("__hook"))
    return rows.select(*keep, "__hook.hook_id", "__hook.target_url", "body", "body_sha", "signature")


def hook_id(target_url: Column, tenant: Column) -> Column:
    return F.substring(F.sha2(F.concat(target_url, tenant), 256), 1, 12)


def retry_outbox(queue: DataFrame, results: DataFrame, key: str = "delivery_id") -> DataFrame:
    """What is left after a round of deliveries; ``results`` has ``delivered, reason`` per key."""
    r = results.select(key, "delivered", F.col("reason").alias("__reason"), F.lit(True).alias("__tried"))
    rows = queue.join(r, key, "left").where(~F.coalesce("delivered", F.lit(False)))
    tried = F.coalesce("__tried", F.lit(False))
    return rows.withColumns(
        {
            "attempts": F.coalesce("attempts", F.lit(0)) + tried.cast("int"),
            "reason": F.when(tried, F.col("__reason")).otherwise(F.col("reason")),
        }
    ).drop("delivered", "__reason", "__tried")
