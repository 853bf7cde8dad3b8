"""Registered queries over activity tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.presets import bundled_rules
from ..operators import budget, compliance as comp, ledger as led, metrics, risk, shadow
from ..operators.adversarial import BLOCKED_FRAGMENTS, suspicious_paths as path_checks
from ..operators.mask import mask_columns
from ..operators.policy import normalize_rules, policy_versions, verify_manifests
from ..session import checkpoint_dir
from ..sources.sinks import audit_export as export_rows, upsert_by_key
from ..sources import buckets
from ..streaming import snapshots
from ..streaming.jobs import start_available, stream_budget, stream_risk, use_rocksdb
from . import control_room as rooms
from ..operators.trees import proven
from .bindings import (
    AS_OF,
    AS_OF_HOUR,
    LEDGER_CTE,
    ORDERS_AS_OF,
    REDACTION_LABELS,
    duck,
    ledger,
    load,
    view,
    view_sql,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


#: Mean risk in hundredths, a half rounded up, from whole numbers.
_MEAN = "(2 * sum(CAST(round(risk_score * 100) AS BIGINT)) + count(risk_score)) // (2 * count(risk_score)) / CAST(100 AS DOUBLE)"


def us(ts: str) -> str:
    return f"epoch_us(TIMESTAMP '{ts}')"


def _micros(col: str):
    return F.unix_micros(col).alias(col + "_us")


# ---- actor risk -----------------------------------------------------------

_SEV = "CAST(least(CAST(10 AS DOUBLE), severity) AS DECIMAL(28,8))"
_WINDOW = """flags AS (SELECT *, CAST(is_pii AS BIGINT) AS p, CAST(is_injection AS BIGINT) AS i, CAST(is_semantic AS BIGINT) AS s,
  {sev} AS sev FROM risk_events),
win AS (SELECT event_id, actor_hash, us, sum(p) OVER w AS pii, sum(i) OVER w AS inj, sum(s) OVER w AS sem, sum(sev) OVER w AS sev
  FROM flags WINDOW w AS (PARTITION BY actor_hash ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))""".format(sev=_SEV)
_SCORE = "least(CAST(100 AS DOUBLE), CAST(round(sev + pii * 8 + inj * 12 + sem * 10 + CASE WHEN pii > 3 THEN 25 ELSE 0 END, 2) AS DOUBLE))"
_PROFILE = f"""prof AS (SELECT *, {_SCORE} AS score FROM (SELECT actor_hash, sum(CAST(is_pii AS BIGINT)) AS pii, sum(CAST(is_injection AS BIGINT)) AS inj,
  sum(CAST(is_semantic AS BIGINT)) AS sem, sum({_SEV}) AS sev, max(us) AS last_us, array_to_string(list_sort(list_distinct(list(label))), ';') AS labels
  FROM risk_events WHERE us BETWEEN {us(AS_OF_HOUR)} - 3600000000 AND {us(AS_OF_HOUR)} GROUP BY actor_hash))"""
_DENSE = _PROFILE.replace("FROM risk_events", "FROM dense_events")


@query(
    "risk_as_of_event",
    duck("risk_events", ctes=_WINDOW)
    + f"SELECT event_id, CAST(pii AS BIGINT) AS pii, CAST(inj AS BIGINT) AS inj, CAST(sem AS BIGINT) AS sem, {_SCORE} AS risk_score, pii > 3 AS quarantined FROM win",
)
def risk_as_of_event(spark, sf):
    r = risk.risk_as_of_event(view(spark, sf, "risk_events"), "event_id")
    return r.select(
        "event_id",
        F.col("pii_attempts_last_hour").alias("pii"),
        F.col("injection_attempts_last_hour").alias("inj"),
        F.col("semantic_hits_last_hour").alias("sem"),
        "risk_score",
        "quarantined",
    )


@query(
    "stream_risk_replay",
    duck("risk_events", ctes=_WINDOW)
    + f"SELECT event_id, CAST(pii AS BIGINT) AS pii, CAST(inj AS BIGINT) AS inj, CAST(sem AS BIGINT) AS sem, {_SCORE} AS risk_score, pii > 3 AS quarantined FROM win",
)
def stream_risk_replay(spark, sf):
    """The event table read as a stream; state per actor gives the same profiles."""
    table = load(spark, sf, "events")
    use_rocksdb(spark)
    spark.readStream.schema(table.schema).parquet(f"{sf}/events.parquet*").createOrReplaceTempView("streamed_events")
    rows = spark.sql(view_sql("risk_events", "spark").replace("FROM events", "FROM streamed_events"))
    profiles = stream_risk(rows.withColumn("ts", F.timestamp_micros("us")))
    base = f"{checkpoint_dir(spark)}/stream-risk-{uuid.uuid4().hex}"
    sink = profiles.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append")
    sink.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(profiles.schema).parquet(f"{base}/out").select(
        "event_id",
        F.col("pii_attempts_last_hour").alias("pii"),
        F.col("injection_attempts_last_hour").alias("inj"),
        F.col("semantic_hits_last_hour").alias("sem"),
        "risk_score",
        "quarantined",
    )


@query(
    "control_room_stream",
    duck("risk_events", ctes=_PROFILE)
    + """SELECT CAST((SELECT count(*) FROM prof WHERE pii > 3 OR score >= 50 OR inj > 0) AS BIGINT) AS open_alerts, (SELECT count(*) FROM prof WHERE pii > 3) AS quarantined_users,
  count(*) AS events, count_if(is_pii) AS pii, count_if(is_injection) AS injections, count_if(is_semantic) AS semantic, count(DISTINCT us // 3600000000) AS active_hours FROM risk_events""",
)
def control_room_stream(spark, sf):
    """The events in several batches; each adds its hours to the version before and reads the live hour alone."""
    base = f"{checkpoint_dir(spark)}/control-room-{uuid.uuid4().hex}"
    events = view(spark, sf, "risk_events").withColumn("ts", F.timestamp_micros("us")).select("event_id", "actor_hash", "ts", "severity", "is_pii", "is_injection", "is_semantic")
    events.repartitionByRange(4, "ts").write.parquet(f"{base}/arriving")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arriving")
    start_available(stream, snapshots.control_room_batches(f"{base}/room", lambda: AS_OF_HOUR), f"{base}/checkpoint").awaitTermination()
    return snapshots.read_snapshot(spark, f"{base}/room").drop("as_of", "severity_units")


@query(
    "quarantine_events",
    duck("risk_events", ctes=_WINDOW)
    + f"SELECT event_id, actor_hash, {_SCORE} AS risk_score, 'PII_ATTEMPTS_EXCEEDED_3_PER_HOUR' AS quarantine_reason FROM win WHERE pii > 3",
)
def quarantine_events(spark, sf):
    r = risk.quarantine(risk.risk_as_of_event(view(spark, sf, "risk_events"), "event_id"))
    return r.select("event_id", "actor_hash", "risk_score", "quarantine_reason")


def _profiles(spark, sf, events="risk_events"):
    e = view(spark, sf, events).withColumn("labels", F.array("label"))
    return risk.risk_profile(e, AS_OF_HOUR)


@query(
    "risk_heatmap",
    duck("risk_events", ctes=_PROFILE)
    + "SELECT actor_hash, score AS risk_score, CAST(pii AS BIGINT) AS pii, last_us AS last_seen_us, labels, pii > 3 AS quarantined FROM prof ORDER BY score DESC, actor_hash LIMIT 100",
)
def risk_heatmap(spark, sf):
    h = risk.heatmap(_profiles(spark, sf))
    return h.select(
        "actor_hash", "risk_score", F.col("pii_attempts_last_hour").alias("pii"), _micros("last_seen"), F.array_join("labels", ";").alias("labels"), "quarantined"
    )


@query(
    "risk_alerts",
    duck("dense_events", ctes=_DENSE)
    + """SELECT actor_hash AS id, CASE WHEN pii > 3 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CASE WHEN pii > 3 THEN 'AUTO_QUARANTINE' ELSE 'RISK_SPIKE' END AS type,
  score AS risk_score, CASE WHEN pii > 3 THEN 'PII_ATTEMPTS_EXCEEDED_3_PER_HOUR' ELSE 'High-risk activity detected' END AS reason, 'OPEN' AS status
FROM prof WHERE pii > 3 OR score >= 50 OR inj > 0""",
)
def risk_alerts(spark, sf):
    return risk.alerts(_profiles(spark, sf, "dense_events")).drop("created_at", "actor_hash")


@query(
    "quarantined_actors",
    duck("dense_events", ctes=_DENSE) + "SELECT actor_hash, score AS risk_score FROM prof WHERE pii > 3",
)
def quarantined_actors(spark, sf):
    return risk.quarantined_actors(_profiles(spark, sf, "dense_events")).select("actor_hash", "risk_score")


@query(
    "tenant_profiles",
    duck("dense_events", ctes=_DENSE.replace("FROM dense_events WHERE", "FROM dense_events WHERE tenant_id = 't1' AND"))
    + "SELECT actor_hash, score AS risk_score, CAST(pii AS BIGINT) AS pii, pii > 3 AS quarantined FROM prof",
)
def tenant_profiles(spark, sf):
    """Profiles of the actors of one tenant, from its events alone."""
    events = view(spark, sf, "dense_events").where("tenant_id = 't1'")
    return risk.risk_profile(events, AS_OF_HOUR).select("actor_hash", "risk_score", F.col("pii_attempts_last_hour").alias("pii"), "quarantined")


@query(
    "events_retained",
    duck("risk_events")
    + f"SELECT actor_hash, count(*) AS n_events FROM risk_events WHERE us >= {us(AS_OF)} - 7 * 86400000000 GROUP BY 1",
)
def events_retained(spark, sf):
    kept = risk.retain_events(view(spark, sf, "risk_events"), AS_OF)
    return kept.groupBy("actor_hash").agg(F.count("*").alias("n_events"))


@query(
    "daily_first_alert",
    duck("risk_events")
    + """SELECT event_id AS id, us FROM (SELECT *, row_number() OVER (PARTITION BY us // 86400000000 ORDER BY us, event_id) AS rn FROM risk_events WHERE is_pii) WHERE rn = 1""",
)
def daily_first_alert(spark, sf):
    e = view(spark, sf, "risk_events").where("is_pii").select(F.col("event_id").alias("id"), "us", "ts")
    return risk.throttle_daily(e).select("id", "us")


@query(
    "actor_rollup",
    duck("usage_events")
    + """SELECT sha256(actor) AS actor_hash, least(CAST(100 AS DOUBLE), CAST(round(sum(CAST(risk_score * 5 AS DECIMAL(28,8))), 2) AS DOUBLE)) AS risk_score,
  CAST(sum(pii_count) AS BIGINT) AS pii, CAST(sum(CASE WHEN detection_type = 'Prompt Injection' THEN 1 ELSE 0 END) AS BIGINT) AS inj,
  bool_or(event = 'AUTO_QUARANTINE') AS quarantined, max(us) AS last_seen_us,
  (SELECT string_agg(detection_type, ';' ORDER BY f, detection_type) FROM (SELECT detection_type, min(us) AS f FROM usage_events u2 WHERE u2.actor = u.actor GROUP BY 1)) AS labels
FROM usage_events u GROUP BY actor ORDER BY risk_score DESC, actor_hash LIMIT 10""",
)
def actor_rollup(spark, sf):
    r = risk.actor_rollup(view(spark, sf, "usage_events"))
    return r.select(
        "actor_hash", "risk_score", F.col("pii_attempts_last_hour").alias("pii"), F.col("injection_attempts_last_hour").alias("inj"),
        "quarantined", _micros("last_seen"), F.array_join("labels", ";").alias("labels"),
    )


_BUDGET = """, r AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY us, request_id) AS rn, tokens / CAST(1000 AS DOUBLE) * 0.01::DOUBLE AS cost FROM {source}), walk AS (
  SELECT actor, rn, request_id, us AS start_us, 1 AS used, cost AS spent, 'OK' AS decision FROM r WHERE rn = 1
  UNION ALL
  SELECT actor, rn, request_id, start_us, CASE WHEN d = 'OK' THEN used0 + 1 ELSE used0 END, CASE WHEN d = 'OK' THEN spent0 + cost ELSE spent0 END, d FROM (
    SELECT *, CASE WHEN used0 + 1 > {most} THEN 'RATE_LIMIT_EXCEEDED' WHEN spent0 + cost > {cap} THEN 'COST_BUDGET_EXCEEDED' ELSE 'OK' END AS d FROM (
      SELECT r.actor, r.rn, r.request_id, r.cost, CASE WHEN r.us - w.start_us > {win} THEN r.us ELSE w.start_us END AS start_us,
        CASE WHEN r.us - w.start_us > {win} THEN 0 ELSE w.used END AS used0, CASE WHEN r.us - w.start_us > {win} THEN CAST(0 AS DOUBLE) ELSE w.spent END AS spent0
      FROM walk w JOIN r ON r.actor = w.actor AND r.rn = w.rn + 1)))
SELECT request_id, start_us AS window_start, decision FROM walk"""


def _budget_sql(source: str, **limits) -> str:
    return duck(source).replace("WITH ", "WITH RECURSIVE ", 1) + _BUDGET.format(source=source, **limits)


@query("rate_cost_decisions", _budget_sql("request_bursts", cap="CAST(0.1 AS DOUBLE)", win=60_000_000, most=8))
def rate_cost_decisions(spark, sf):
    """Requests of five actors within two hours, so that both limits are reached."""
    d = budget.rate_cost_decisions(view(spark, sf, "request_bursts"), max_requests=8, max_cost=0.1)
    return d.select("request_id", "window_start", "decision")


@query("stream_budget_replay", "SELECT request_id, decision FROM (" + _budget_sql("request_bursts", cap="CAST(0.1 AS DOUBLE)", win=60_000_000, most=8) + ")")
def stream_budget_replay(spark, sf):
    """The same decisions from a stream with state per actor."""
    use_rocksdb(spark)
    base = f"{checkpoint_dir(spark)}/stream-budget-{uuid.uuid4().hex}"
    rows = view(spark, sf, "request_bursts").select("request_id", F.col("actor").cast("string").alias("actor"), "ts", "tokens")
    rows.write.parquet(f"{base}/arriving")
    stream = stream_budget(spark.readStream.schema(rows.schema).parquet(f"{base}/arriving"), 8, 60_000_000, 0.1)
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append")
    sink.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select("request_id", "decision")


@query("budget_by_day", _budget_sql("requests", cap="CAST(1 AS DOUBLE)", win=86_400_000_000, most=120))
def budget_by_day(spark, sf):
    """A tighter budget over a day, so that both limits are reached."""
    d = budget.rate_cost_decisions(
        view(spark, sf, "requests"), window_us=86_400_000_000, max_cost=1.0, block_us=7 * 86_400_000_000
    )
    return d.select("request_id", "window_start", "decision")


@query(
    "suspicious_paths",
    duck("requests")
    + "SELECT request_id, ({f}) AS suspicious, CASE WHEN {f} THEN 'NOT_FOUND' WHEN content_length > 524288 THEN 'REQUEST_TOO_LARGE' END AS deny_reason FROM requests".format(
        f=" OR ".join(f"contains(lower(path), '{x}')" for x in BLOCKED_FRAGMENTS)
    ),
)
def suspicious_paths(spark, sf):
    r = view(spark, sf, "requests").withColumn("content_length", F.col("content_length").cast("string"))
    return path_checks(r).select("request_id", "suspicious", "deny_reason")


# ---- ledger ---------------------------------------------------------------

_LEDGER = duck("ledger_rows", ctes=LEDGER_CTE)


@query("ledger_verify", _LEDGER + """SELECT 'global' AS chain_id, TRUE AS valid, count(*) AS total_entries, CAST(NULL AS BIGINT) AS corrupted_seq, CAST(NULL AS VARCHAR) AS corrupted_reason
FROM ledger HAVING bool_and(entry_hash = sha256(canonical))""")
def ledger_verify(spark, sf):
    return led.verify_chain(ledger(spark, sf, linked=True), block=5_000)


_TAMPER = """, tampered AS (SELECT * REPLACE (CASE WHEN seq % 4001 = 4000 THEN canonical || '!' ELSE canonical END AS canonical,
  CASE WHEN seq % 3001 = 3000 THEN 'forged' ELSE prev_hash END AS prev_hash) FROM ledger),
bad AS (SELECT seq, CASE WHEN prev_hash <> coalesce(lag(entry_hash) OVER (ORDER BY seq), 'GENESIS') THEN 'prev_hash mismatch'
  WHEN entry_hash <> sha256(canonical) THEN 'content tampered' END AS reason FROM tampered)
"""


def _tampered(spark, sf):
    rows = ledger(spark, sf, linked=True)
    return rows.withColumns(
        {
            "canonical": F.when(F.col("seq") % 4001 == 4000, F.concat("canonical", F.lit("!"))).otherwise(F.col("canonical")),
            "prev_hash": F.when(F.col("seq") % 3001 == 3000, "forged").otherwise(F.col("prev_hash")),
        }
    )


@query(
    "ledger_first_break",
    _LEDGER.rstrip()
    + _TAMPER
    + """SELECT 'global' AS chain_id, count(reason) = 0 AS valid, count(*) AS total_entries, min(CASE WHEN reason IS NOT NULL THEN seq END) AS corrupted_seq,
  arg_min(reason, CASE WHEN reason IS NOT NULL THEN seq END) AS corrupted_reason FROM bad""",
)
def ledger_first_break(spark, sf):
    return led.verify_chain(_tampered(spark, sf), block=1_000)


@query(
    "ledger_links",
    _LEDGER.rstrip() + _TAMPER + "SELECT t.seq, coalesce(p.entry_hash, '') = t.prev_hash AS link_ok FROM tampered t JOIN ledger p ON p.seq = t.seq - 1",
)
def ledger_links(spark, sf):
    rows = _tampered(spark, sf)
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("previous_entry_hash"))
    return led.verify_links(rows.join(before, "seq")).select("seq", "link_ok")


_N_RED = "CAST(sum(n_redactions) AS BIGINT) AS total_redactions"


@query(
    "audit_summary",
    _LEDGER
    + f"""SELECT tenant_id, count(*) AS total_events, round(CAST(sum(CAST(risk_score AS DECIMAL(28,8))) AS DOUBLE) / count(risk_score), 2) AS avg_risk_score,
  {_N_RED}, CAST(sum(CASE WHEN risk_score > 7 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_events FROM ledger GROUP BY 1""",
)
def audit_summary(spark, sf):
    return led.audit_summary(ledger(spark, sf), "tenant_id")


@query("audit_actions", _LEDGER + "SELECT tenant_id, action, count(*) AS n_events FROM ledger GROUP BY ALL")
def audit_actions(spark, sf):
    return led.audit_actions(ledger(spark, sf), "tenant_id")


@query(
    "audit_search",
    _LEDGER + "SELECT seq, user_id, action, entry_hash FROM ledger WHERE department = 'LAW_FIRM' AND tenant_id = 't1' AND contains(upper(action), 'BLOCK') ORDER BY seq DESC LIMIT 100",
)
def audit_search(spark, sf):
    e = led.audit_entries(ledger(spark, sf), 100, department="LAW_FIRM", tenant_id="t1", action="block")
    return e.select("seq", "user_id", "action", "entry_hash")


@query(
    "recent_activity",
    _LEDGER + "SELECT seq, action, risk_score, model_queried, actor_hash, entry_hash FROM ledger WHERE tenant_id = 't1' ORDER BY seq DESC LIMIT 12",
)
def recent_activity(spark, sf):
    r = led.recent_activity(ledger(spark, sf), "t1")
    return r.select("seq", "action", "risk_score", "model_queried", "actor_hash", "entry_hash")


@query("incident_timeline", _LEDGER + "SELECT seq, action, entry_hash FROM ledger WHERE json_extract_string(metadata, '$.actor_hash') = 'meta-4'")
def incident_timeline(spark, sf):
    return led.incident_timeline(ledger(spark, sf), "meta-4").select("seq", "action", "entry_hash")


def _tree_sql(leaves: str, fanout: int) -> tuple[str, str]:
    """CTEs l0 (k, h, n) from ``leaves`` up to the level that holds one node; the last SELECT gives root and count."""
    levels = led.tree_levels(fanout)
    ctes = [f"l0 AS ({leaves})"] + [
        f"l{i + 1} AS (SELECT k // {fanout} AS k, sha256(string_agg(h, '' ORDER BY k)) AS h, sum(n) AS n FROM l{i} GROUP BY 1)" for i in range(levels)
    ]
    return ", ".join(ctes), f"sha256(string_agg(h, '' ORDER BY k)) AS {{root}}, CAST(sum(n) AS BIGINT) AS {{count}} FROM l{levels}"


_CERT_LEAVES, _CERT_ROOT = _tree_sql(
    """SELECT seq AS k, 1 AS n, sha256(concat('{"timestamp":null,"action":"', action, '","policy_triggered":', coalesce('"' || policy_triggered || '"', 'null'),
  ',"risk_score":', coalesce(CAST(risk_score AS VARCHAR), 'null'), ',"model_queried":', coalesce('"' || model_queried || '"', 'null'), ',"entry_hash":"', entry_hash, '"}')) AS h
  FROM ledger WHERE json_extract_string(metadata, '$.actor_hash') = 'meta-4'""",
    led.FANOUT,
)


@query("timeline_certificate", _LEDGER.rstrip() + ", " + _CERT_LEAVES + " SELECT " + _CERT_ROOT.format(root="certificate", count="total"))
def timeline_certificate(spark, sf):
    return led.timeline_certificate(led.incident_timeline(ledger(spark, sf), "meta-4"))


_ANCHOR_LEAVES, _ANCHOR_ROOT = _tree_sql("SELECT seq AS k, 1 AS n, entry_hash AS h FROM ledger WHERE tenant_id = 't1'", led.FANOUT)


@query("ledger_anchor", _LEDGER.rstrip() + ", " + _ANCHOR_LEAVES + " SELECT " + _ANCHOR_ROOT.format(root="ledger_root", count="entry_count"))
def ledger_anchor(spark, sf):
    return led.anchor_root(ledger(spark, sf), "t1")


_ROOT_LEAVES, _ROOT_ROOT = _tree_sql("SELECT seq AS k, 1 AS n, entry_hash AS h FROM ledger", 1000)


@query("ledger_root", _LEDGER.rstrip() + ", " + _ROOT_LEAVES + " SELECT " + _ROOT_ROOT.format(root="ledger_root", count="entry_count"))
def ledger_root(spark, sf):
    return led.merkle_root(ledger(spark, sf), fanout=1000)


@query("high_sensitivity", _LEDGER + "SELECT seq, risk_score FROM ledger WHERE coalesce(risk_score, 0) > 7")
def high_sensitivity(spark, sf):
    return led.high_sensitivity(ledger(spark, sf)).select("seq", "risk_score")


@query(
    "audit_export",
    _LEDGER
    + """SELECT tenant_id, user_id, user_role, department, action, '[' || array_to_string(list_transform([{labels}][1:n_redactions], lambda x: '"' || x || '"'), ', ') || ']' AS redactions_applied,
  policy_triggered, model_queried, risk_score, entry_hash, CAST(us AS VARCHAR) AS "timestamp", concat('doc-', seq % 50) AS document, sha256(canonical) AS prompt_hash FROM ledger""".format(labels=", ".join(f"'{x}'" for x in REDACTION_LABELS)),
)
def audit_export(spark, sf):
    rows = ledger(spark, sf).withColumns(
        {"timestamp": F.col("us").cast("string"), "document": F.concat(F.lit("doc-"), (F.col("seq") % 50).cast("string")), "prompt_hash": F.sha2("canonical", 256)}
    )
    return export_rows(rows)


@query(
    "usage_meter",
    duck("ledger_rows", "licenses", ctes=LEDGER_CTE)
    + """SELECT tenant_id, active_users, active_api_keys, api_calls, redactions, reports_generated FROM
  (SELECT tenant_id, count(*) AS active_users FROM licenses WHERE is_active GROUP BY 1)
  JOIN (SELECT tenant_id, count(*) AS active_api_keys FROM licenses WHERE is_active AND expires_us > 883612800000000 GROUP BY 1) USING (tenant_id)
  JOIN (SELECT tenant_id, count(*) AS api_calls, CAST(sum(n_redactions) AS BIGINT) AS redactions,
    CAST(sum(CASE WHEN action = 'EVIDENCE_REPORT_GENERATED' THEN 1 ELSE 0 END) AS BIGINT) AS reports_generated FROM ledger GROUP BY 1) USING (tenant_id)""",
)
def usage_meter(spark, sf):
    lic = view(spark, sf, "licenses").select("tenant_id", "is_active", "expires_at")
    return led.usage_meter(lic, lic.where(F.unix_micros("expires_at") > 883612800000000), ledger(spark, sf))


@query("model_route_counts", _LEDGER + "SELECT tenant_id, model_queried, count(*) AS n_events FROM ledger WHERE model_queried IS NOT NULL GROUP BY ALL")
def model_route_counts(spark, sf):
    return led.model_route_counts(ledger(spark, sf), "tenant_id")


@query(
    "audit_view_by_role",
    _LEDGER
    + """, viewers AS (SELECT DISTINCT user_id, user_role, department AS own FROM ledger)
SELECT v.user_id, count(*) AS n_visible FROM viewers v JOIN (SELECT department, count(*) AS n FROM ledger GROUP BY 1) d
  ON v.user_role IN ('SUPER_ADMIN', 'AUDITOR') OR d.department = v.own GROUP BY 1""",
)
def audit_view_by_role(spark, sf):
    """Departments each user may see, over the (viewer, own department) pairs of the ledger."""
    rows = ledger(spark, sf)
    viewers = rows.select("user_id", F.col("user_role").alias("viewer_role"), F.col("department").alias("own")).distinct()
    depts = rows.groupBy("department").agg(F.count("*").alias("n"))
    # The departments (a handful) travel as one array, so every viewer row can be checked in place.
    names = F.array_sort(F.collect_set("department"))
    listed = depts.agg(names.alias("all")).withColumn("k", F.lit(1))
    pairs = viewers.withColumn("k", F.lit(1)).join(F.broadcast(listed), "k").select("user_id", "viewer_role", "own", F.explode("all").alias("department"))
    seen = led.audit_view(pairs, F.col("viewer_role"), F.col("own"))
    return seen.groupBy("user_id").agg(F.count("*").alias("n_visible"))


@query("audit_view_rows", _LEDGER + "SELECT seq, department FROM ledger WHERE department = 'LAW_FIRM'")
def audit_view_rows(spark, sf):
    """The ledger rows that a member of one department may see."""
    return led.audit_view(ledger(spark, sf), "STAFF", "LAW_FIRM").select("seq", "department")


_ACTION_PERMISSION = "CASE action WHEN 'AI_QUERY' THEN 'run_ai_query' WHEN 'EVIDENCE_REPORT_GENERATED' THEN 'export_audit_pdf' WHEN 'PROMPT_BLOCKED' THEN 'view_policy' ELSE 'manage_users' END"
_MATRIX = "matrix(role, permission) AS (VALUES " + ", ".join(f"('{r}', '{p}')" for r, ps in led.ROLE_PERMISSIONS.items() for p in ps) + ")"


@query(
    "permission_checks",
    duck("ledger_rows", ctes=_MATRIX)
    + f"""SELECT seq, user_role AS role, {_ACTION_PERMISSION} AS permission, (user_role, {_ACTION_PERMISSION}) IN (SELECT role, permission FROM matrix) AS allowed FROM ledger_rows""",
)
def permission_checks(spark, sf):
    asked = view(spark, sf, "ledger_rows").select("seq", F.col("user_role").alias("role"), F.expr(_ACTION_PERMISSION).alias("permission"))
    yes = led.allowed(asked).withColumn("allowed", F.lit(True))
    return yes.unionByName(led.denied(asked).withColumn("allowed", F.lit(False))).select("seq", "role", "permission", "allowed")


@query(
    "session_list",
    duck("sessions")
    + "SELECT session_id, user_id, c_name AS email, us FROM sessions JOIN customer ON c_custkey = user_id WHERE tenant_id = 't1' ORDER BY us DESC, session_id DESC LIMIT 250",
)
def session_list(spark, sf):
    users = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    s = view(spark, sf, "sessions").withColumnRenamed("ts", "started_at")
    return led.session_list(users, s, "t1").select("session_id", "user_id", "email", "us")


@query(
    "scheduled_evidence",
    _LEDGER
    + f""", schedules AS (SELECT DISTINCT tenant_id, tenant_id <> 't2' AS enabled FROM ledger)
SELECT tenant_id, concat('org ', tenant_id) AS org_name, count(*) AS total_events, coalesce({_MEAN}, 0) AS avg_risk_score, {_N_RED},
  CAST(sum(CASE WHEN risk_score > 7 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_events FROM ledger JOIN schedules USING (tenant_id) WHERE enabled GROUP BY 1""",
)
def scheduled_evidence(spark, sf):
    rows = ledger(spark, sf)
    plan = rows.select("tenant_id").distinct().select(
        "tenant_id", (F.col("tenant_id") != "t2").alias("enabled"), F.concat(F.lit("org "), "tenant_id").alias("org_name")
    )
    return led.scheduled_evidence(plan, rows)


_TENANT_TREE = [f"l0 AS (SELECT tenant_id, seq AS k, entry_hash AS h FROM ledger)"] + [
    f"l{i + 1} AS (SELECT tenant_id, k // {led.FANOUT} AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l{i} GROUP BY 1, 2)" for i in range(led.tree_levels(led.FANOUT))
]
_TENANT_EVIDENCE = (
    _LEDGER.rstrip()
    + ", " + ", ".join(_TENANT_TREE)
    + f""", roots AS (SELECT tenant_id, sha256(string_agg(h, '' ORDER BY k)) AS ledger_root FROM l{led.tree_levels(led.FANOUT)} GROUP BY 1),
risk_events AS ({view_sql("risk_events", "duck")}),
prof AS (SELECT *, {_SCORE} AS score FROM (SELECT tenant_id, actor_hash, sum(CAST(is_pii AS BIGINT)) AS pii, sum(CAST(is_injection AS BIGINT)) AS inj,
  sum(CAST(is_semantic AS BIGINT)) AS sem, sum({_SEV}) AS sev FROM risk_events WHERE us BETWEEN {us(AS_OF_HOUR)} - 3600000000 AND {us(AS_OF_HOUR)} GROUP BY 1, 2)),
actors AS (SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY score DESC, actor_hash) AS rank, actor_hash, score FROM prof QUALIFY rank <= 5),
high AS (SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY seq DESC) AS rank, seq, entry_hash, risk_score FROM ledger WHERE coalesce(risk_score, 0) > 7 QUALIFY rank <= 25),
figures AS (SELECT tenant_id, count(*) AS total_events, {_N_RED}, CAST(sum(CASE WHEN risk_score > 7 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_events FROM ledger WHERE tenant_id <> 't2' GROUP BY 1),
named AS (SELECT tenant_id, string_agg(actor_hash, ',' ORDER BY rank) AS top_actors FROM actors GROUP BY 1),
listed AS (SELECT tenant_id, string_agg(concat(seq, ':', entry_hash), ',' ORDER BY rank) AS high_entries FROM high GROUP BY 1),
evidence AS (SELECT * FROM figures LEFT JOIN roots USING (tenant_id) LEFT JOIN named USING (tenant_id) LEFT JOIN listed USING (tenant_id))
"""
)


def _tenant_evidence(spark, sf):
    rows = ledger(spark, sf)
    plan = rows.select("tenant_id").distinct().select(
        "tenant_id", (F.col("tenant_id") != "t2").alias("enabled"), F.concat(F.lit("org "), "tenant_id").alias("org_name")
    )
    profiles = risk.risk_profile(view(spark, sf, "risk_events"), AS_OF_HOUR, "tenant_id")
    return led.tenant_certificates(plan, rows, profiles)


@query(
    "tenant_evidence",
    _TENANT_EVIDENCE
    + """SELECT *, sha256(concat_ws('|', tenant_id, total_events, total_redactions, high_risk_events, ledger_root, coalesce(top_actors, ''), coalesce(high_entries, ''))) AS certificate FROM evidence""",
)
def tenant_evidence(spark, sf):
    """Figures, root of the ledger, tables and certificate of every tenant with an enabled schedule, in one job."""
    return _tenant_evidence(spark, sf)["figures"].drop("avg_risk_score", "org_name")


@query(
    "tenant_evidence_rows",
    _TENANT_EVIDENCE
    + """SELECT tenant_id, 'actor' AS kind, rank, actor_hash AS id, score AS risk FROM actors WHERE tenant_id <> 't2'
UNION ALL SELECT tenant_id, 'entry', rank, entry_hash, risk_score FROM high WHERE tenant_id <> 't2'""",
)
def tenant_evidence_rows(spark, sf):
    """The tables beside those figures: five actors by risk and the newest 25 high-sensitivity entries of each tenant."""
    parts = _tenant_evidence(spark, sf)
    rank = F.col("rank").cast("bigint").alias("rank")
    actors = parts["top_actors"].select("tenant_id", F.lit("actor").alias("kind"), rank, F.col("actor_hash").alias("id"), F.col("risk_score").alias("risk"))
    return actors.unionByName(parts["high_sensitivity"].select("tenant_id", F.lit("entry").alias("kind"), rank, F.col("entry_hash").alias("id"), F.col("risk_score").alias("risk")))


_DAY_US = 86_400_000_000


def _sealed_by_day(spark, sf):
    rows = view(spark, sf, "ledger_rows").select(
        F.concat_ws("/", "tenant_id", F.expr(f"us div {_DAY_US}L").cast("string")).alias("chain_id"),
        "seq",
        F.concat(F.lit('"'), "canonical", F.lit(f'"|{led.PREV_MARK}')).alias("body"),
    )
    return led.build_chain(rows, salt="pepper")


@query(
    "sealed_chain",
    duck("ledger_rows").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""", e AS (SELECT concat(tenant_id, '/', us // {_DAY_US}) AS chain_id, seq, concat('"', canonical, '"|') AS body,
    row_number() OVER (PARTITION BY tenant_id, us // {_DAY_US} ORDER BY seq) AS i FROM ledger_rows),
c AS (SELECT chain_id, i, sha256(concat('pepper:', body, 'GENESIS')) AS h FROM e WHERE i = 1
  UNION ALL SELECT e.chain_id, e.i, sha256(concat('pepper:', e.body, c.h)) FROM c JOIN e ON e.chain_id = c.chain_id AND e.i = c.i + 1),
heads AS (SELECT chain_id AS name, max(i) AS entries, arg_max(h, i) AS head, row_number() OVER (ORDER BY chain_id) AS i FROM c GROUP BY 1),
r AS (SELECT i, sha256(concat('pepper:', name, '|', entries, '|', head, '|GENESIS')) AS h FROM heads WHERE i = 1
  UNION ALL SELECT n.i, sha256(concat('pepper:', name, '|', entries, '|', head, '|', r.h)) FROM r JOIN heads n ON n.i = r.i + 1)
SELECT name AS chain_id, TRUE AS valid, entries AS total_entries, head FROM heads
UNION ALL SELECT 'root', TRUE, count(*), arg_max(h, i) FROM r""",
)
def sealed_chain(spark, sf):
    """Entries sealed per tenant and day and a chain over these chains, each verified, with the last digest."""
    sealed = _sealed_by_day(spark, sf)
    root = led.build_chain(led.chain_heads(sealed), salt="pepper")
    out = None
    for chain in (sealed, root):
        last = chain.groupBy(F.col("chain_id").alias("c")).agg(F.max_by("entry_hash", "seq").alias("head"))
        checked = led.verify_chain(chain, "chain_id", "pepper").join(last, F.col("chain_id") == F.col("c"))
        part = checked.select("chain_id", "valid", "total_entries", "head")
        out = part if out is None else out.unionByName(part)
    return out


_HEADS = duck("ledger_rows").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", e AS (SELECT concat(tenant_id, '/', us // {_DAY_US}) AS chain_id, seq, concat('"', canonical, '"|') AS body,
    row_number() OVER (PARTITION BY tenant_id, us // {_DAY_US} ORDER BY seq) AS i FROM ledger_rows),
c AS (SELECT chain_id, i, sha256(concat('pepper:', body, 'GENESIS')) AS h FROM e WHERE i = 1
  UNION ALL SELECT e.chain_id, e.i, sha256(concat('pepper:', e.body, c.h)) FROM c JOIN e ON e.chain_id = c.chain_id AND e.i = c.i + 1),
heads AS (SELECT chain_id AS name, max(i) AS entries, arg_max(h, i) AS head, row_number() OVER (ORDER BY chain_id) - 1 AS idx FROM c GROUP BY 1)"""
_LEVELS = 24
_PROOFS = (
    _HEADS
    + ", t0 AS (SELECT idx AS i, sha256(concat(name, '|', entries, '|', head)) AS h FROM heads)"
    + "".join(f", t{k + 1} AS (SELECT i // 2 AS i, CASE count(*) WHEN 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM t{k} GROUP BY 1)" for k in range(_LEVELS))
    + ", sides AS ("
    + " UNION ALL ".join(f"SELECT idx, {k} AS k, CASE (idx >> {k}) % 2 WHEN 1 THEN 'L:' ELSE 'R:' END || h AS side FROM heads JOIN t{k} ON i = xor(idx >> {k}, 1)" for k in range(_LEVELS))
    + f") SELECT name, entries, head, coalesce(path, '') AS path, (SELECT h FROM t{_LEVELS}) AS root, TRUE AS proven FROM heads LEFT JOIN (SELECT idx, string_agg(side, ',' ORDER BY k) AS path FROM sides GROUP BY 1) USING (idx)"
)


@query("chain_head_proofs", _PROOFS)
def chain_head_proofs(spark, sf):
    """Every chain of the ledger with its path to the root of a hash tree over the last digests of all chains."""
    proofs = led.head_proofs(_sealed_by_day(spark, sf))
    return proofs.select("name", "entries", "head", F.array_join("path", ",").alias("path"), "root", (proven(F.col("leaf"), F.col("path")) == F.col("root")).alias("proven"))


@query("evidence_report")
def evidence_report(spark, sf):
    tables = led.evidence_tables(ledger(spark, sf, linked=True), _profiles(spark, sf).drop("labels"))
    return tables["certificate"]


@query(
    "verify_manifests",
    """SELECT o_orderkey, sha256(m) = s AS valid FROM (SELECT o_orderkey, concat('{"bundle": "', o_orderkey, '", "scope": "', o_orderstatus, '"}') AS m,
  sha256(concat('{"bundle": "', o_orderkey, '", "scope": "', CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END, '"}')) AS s FROM orders)""",
)
def verify_signatures(spark, sf):
    text = lambda status: F.concat(F.lit('{"bundle": "'), "o_orderkey", F.lit('", "scope": "'), status, F.lit('"}'))
    signed = F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))
    o = load(spark, sf, "orders").select("o_orderkey", text(F.col("o_orderstatus")).alias("manifest"), F.sha2(text(signed), 256).alias("signature"))
    return verify_manifests(o).select("o_orderkey", "valid")


@query(
    "policy_versions",
    """SELECT concat('bundle_', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS name, CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'approved' ELSE 'expired' END AS approval_state
FROM orders ORDER BY name DESC LIMIT 100""",
)
def newest_versions(spark, sf):
    o = load(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "approved").otherwise("expired")
    return policy_versions(o.select(F.concat(F.lit("bundle_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("name"), state.alias("approval_state")))


@query(
    "rule_validation",
    """WITH raw AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name,
  CASE c_custkey % 5 WHEN 0 THEN 'warn' WHEN 1 THEN 'redact' WHEN 2 THEN 'block' WHEN 3 THEN 'explode' END AS e,
  CASE WHEN c_custkey % 11 = 0 THEN 'high' WHEN c_custkey % 13 <> 0 THEN concat(c_custkey % 13, '.5') END AS t FROM customer)
SELECT c_custkey, coalesce(name, 'unnamed') AS name, CASE WHEN e = 'explode' OR e IS NULL THEN 'redact' ELSE e END AS enforcement,
  CASE WHEN try_cast(t AS DOUBLE) BETWEEN 0 AND 10 THEN try_cast(t AS DOUBLE) ELSE 5.0 END AS risk_threshold,
  CASE WHEN name IS NULL THEN 1 ELSE 0 END + CASE WHEN e = 'explode' THEN 1 ELSE 0 END
    + CASE WHEN t IS NOT NULL AND NOT coalesce(try_cast(t AS DOUBLE) BETWEEN 0 AND 10, FALSE) THEN 1 ELSE 0 END AS n_errors FROM raw""",
)
def rule_validation(spark, sf):
    """Raw rules made from the customer table, good and bad ones."""
    k = F.col("c_custkey")
    raw = load(spark, sf, "customer").select(
        "c_custkey",
        F.when(k % 7 != 0, F.col("c_name")).alias("name"),
        F.when(k % 5 == 0, "warn").when(k % 5 == 1, "redact").when(k % 5 == 2, "block").when(k % 5 == 3, "explode").alias("enforcement"),
        F.when(k % 11 == 0, "high").when(k % 13 != 0, F.concat(k % 13, F.lit(".5"))).alias("risk_threshold"),
    )
    checked = normalize_rules(raw)
    return checked.select("c_custkey", "name", "enforcement", "risk_threshold", F.size("errors").alias("n_errors"))


# ---- compliance -----------------------------------------------------------


@query(
    "retention_check",
    duck("records")
    + f"""SELECT record_id, CAST(age AS BIGINT) AS age_days, CAST(m AS BIGINT) AS max_days, age > m AS must_delete, CAST(greatest(0, m - age) AS BIGINT) AS days_remaining FROM (
  SELECT record_id, CAST(floor(({us(ORDERS_AS_OF)} - us) / 86400000000) AS BIGINT) AS age,
    CASE category WHEN 'SENSITIVE' THEN 90 WHEN 'PERSONAL' THEN 365 WHEN 'HEALTH' THEN 730 WHEN 'FINANCIAL' THEN 2555 ELSE 365 END AS m FROM records)""",
)
def retention_check(spark, sf):
    r = comp.retention_check(view(spark, sf, "records"), ORDERS_AS_OF, stored_at="ts")
    return r.select("record_id", "age_days", "max_days", "must_delete", "days_remaining")


@query(
    "principal_requests",
    duck("records")
    + f"""SELECT record_id, substring(sha256(CAST(principal_id AS VARCHAR)), 1, 16) AS principal_id_hash, upper(request_type) AS request_type, 'PENDING' AS status,
  us + 30 * 86400000000 AS sla_deadline_us, {us(ORDERS_AS_OF)} > us + 30 * 86400000000 AS overdue FROM records""",
)
def principal_requests(spark, sf):
    r = comp.principal_requests(view(spark, sf, "records"), ORDERS_AS_OF, filed_at="ts")
    return r.select("record_id", "principal_id_hash", "request_type", "status", _micros("sla_deadline"), "overdue")


_INCIDENTS = duck("records") + ", inc AS (SELECT *, CASE WHEN is_test THEN 'TEST_MODE' ELSE 'PENDING_SUBMISSION' END AS status FROM records)\n"


@query(
    "incident_reports",
    _INCIDENTS + "SELECT record_id, status, us + 72 * 3600000000 AS notification_due_by_us, upper(substring(sha256(concat(us, description)), 1, 12)) AS report_id FROM inc",
)
def incident_reports(spark, sf):
    r = comp.incident_reports(view(spark, sf, "records"))
    return r.select("record_id", "status", _micros("notification_due_by"), "report_id")


@query(
    "incident_score",
    _INCIDENTS
    + """SELECT org, n AS open_incidents, t AS total_incidents, CAST(greatest(0, 100 - 15 * n) AS BIGINT) AS dpdp_score,
  CASE WHEN 100 - 15 * n >= 90 THEN 'A' WHEN 100 - 15 * n >= 75 THEN 'B' WHEN 100 - 15 * n >= 60 THEN 'C' ELSE 'F' END AS grade
FROM (SELECT org, CAST(sum(CASE WHEN contains(status, 'PENDING') THEN 1 ELSE 0 END) AS BIGINT) AS n, count(*) AS t FROM inc GROUP BY 1)""",
)
def incident_score(spark, sf):
    r = comp.incident_reports(view(spark, sf, "records"))
    return comp.dpdp_score(r, "org")


@query(
    "consent_lookup",
    duck("consents")
    + f""", st AS (SELECT *, CASE WHEN revoked THEN 'REVOKED' WHEN {us(ORDERS_AS_OF)} > expires_us THEN 'EXPIRED' WHEN granted THEN 'VALID' END AS state FROM consents),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY principal_id, purpose ORDER BY seq DESC) AS rn FROM st WHERE state IS NOT NULL) WHERE rn = 1),
asked AS (SELECT o_orderkey AS request_id, o_custkey AS principal_id, CASE o_orderkey % 3 WHEN 0 THEN 'MARKETING' WHEN 1 THEN 'ANALYTICS' ELSE 'PATIENT_CARE' END AS purpose FROM orders)
SELECT request_id, coalesce(state, 'NOT_FOUND') AS reason, coalesce(state, 'NOT_FOUND') = 'VALID' AS has_consent, consent_id FROM asked LEFT JOIN newest USING (principal_id, purpose)""",
)
def consent_lookup(spark, sf):
    c = view(spark, sf, "consents").withColumn("principal_hash", comp.principal_hash(F.col("principal_id")))
    purpose = F.when(F.col("o_orderkey") % 3 == 0, "MARKETING").when(F.col("o_orderkey") % 3 == 1, "ANALYTICS").otherwise("PATIENT_CARE")
    asked = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), comp.principal_hash(F.col("o_custkey")).alias("principal_hash"), purpose.alias("purpose")
    )
    return comp.consent_check(asked, c, ORDERS_AS_OF).select("request_id", "reason", "has_consent", "consent_id")


_PURPOSE = "CASE purpose " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in comp.PURPOSES.items()) + " ELSE purpose END"


@query(
    "record_consents",
    duck("consents")
    + f"""SELECT seq, substring(sha256(concat(principal_id, purpose, us)), 1, 16) AS consent_id, substring(sha256(CAST(principal_id AS VARCHAR)), 1, 20) AS principal_hash,
  {_PURPOSE} AS purpose_description, us + 365 * 86400000000 AS expires_at_us FROM consents""",
)
def record_consents(spark, sf):
    c = comp.record_consents(view(spark, sf, "consents").drop("consent_id", "expires_at"))
    return c.select("seq", "consent_id", "principal_hash", "purpose_description", _micros("expires_at"))


@query(
    "revoke_consents",
    duck("consents") + "SELECT consent_id, revoked OR seq % 5 = 0 AS revoked, CASE WHEN seq % 5 = 0 THEN 'DATA_PRINCIPAL_REQUEST' END AS revoke_reason FROM consents",
)
def revoke_consents(spark, sf):
    c = view(spark, sf, "consents")
    asked = c.where("seq % 5 = 0").select("consent_id", F.col("ts").alias("revoked_at"), F.lit(None).cast("string").alias("revoke_reason"))
    return comp.revoke_consents(c, asked).select("consent_id", "revoked", "revoke_reason")


@query(
    "consents_for",
    duck("consents") + "SELECT consent_id FROM consents WHERE principal_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def consents_for(spark, sf):
    c = view(spark, sf, "consents").withColumn("principal_hash", comp.principal_hash(F.col("principal_id")))
    who = load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("principal_id"))
    return comp.consents_for(c, who).select("consent_id")


_INTEGRITY = "tenant_id <> 't2'"


_SCORECARD = (
    _LEDGER
    + f""", s AS (SELECT tenant_id, count(*) AS total_events, sum(n_redactions) AS total_redactions, sum(CASE WHEN risk_score > 7 THEN 1 ELSE 0 END) AS high_risk_events,
  {_INTEGRITY} AS chain_integrity, count(DISTINCT user_id) % 5 AS open_incidents, count(DISTINCT department) * 15 AS mfa, {len(bundled_rules())} AS policies FROM ledger GROUP BY tenant_id),
f AS (SELECT *, greatest(0, 100 - CASE WHEN chain_integrity THEN 0 ELSE 40 END - CASE WHEN total_redactions = 0 AND total_events > 5 THEN 15 ELSE 0 END - open_incidents * 10 - CASE WHEN mfa < 80 THEN 10 ELSE 0 END) AS hipaa,
  greatest(0, 100 - 15 * open_incidents) AS dpdp_2026,
  greatest(0, 100 - CASE WHEN chain_integrity THEN 0 ELSE 35 END - CASE WHEN policies < 1 THEN 20 ELSE 0 END - open_incidents * 8) AS gdpr_lite,
  greatest(0, 100 - CASE WHEN chain_integrity THEN 0 ELSE 30 END - CASE WHEN policies < 3 THEN 15 ELSE 0 END - CASE WHEN mfa < 50 THEN 20 ELSE 0 END - CASE WHEN open_incidents > 2 THEN 25 ELSE 0 END) AS iso_27001_lite FROM s),
c AS (SELECT *, CAST(round_even((hipaa * 35 + gdpr_lite * 35 + iso_27001_lite * 20 + dpdp_2026 * 10) / 100.0, 0) AS BIGINT) AS composite_score FROM f)
SELECT tenant_id, CAST(hipaa AS BIGINT) AS hipaa, CAST(dpdp_2026 AS BIGINT) AS dpdp_2026, CAST(gdpr_lite AS BIGINT) AS gdpr_lite, CAST(iso_27001_lite AS BIGINT) AS iso_27001_lite, composite_score,
  CASE WHEN composite_score >= 90 THEN 'A' WHEN composite_score >= 75 THEN 'B' WHEN composite_score >= 60 THEN 'C' WHEN composite_score >= 40 THEN 'D' ELSE 'F' END AS grade,
  open_incidents = 0 AND chain_integrity AS zero_incident_badge FROM c"""
)


def _scorecard(spark, sf, is_global):
    rows = ledger(spark, sf)
    stats = led.audit_summary(rows, "tenant_id").join(
        rows.groupBy("tenant_id").agg(
            (F.countDistinct("user_id") % 5).alias("open_incidents"), (F.countDistinct("department") * 15).alias("mfa_enabled_pct")
        ),
        "tenant_id",
    )
    stats = stats.withColumns(
        {
            "chain_integrity": F.expr(_INTEGRITY),
            "dpdp_score": F.greatest(F.lit(0), 100 - 15 * F.col("open_incidents")),
            "active_policies": F.lit(len(bundled_rules())),
        }
    )
    c = comp.compliance_scorecard(stats, is_global=is_global)
    return c.select("tenant_id", "hipaa", "dpdp_2026", "gdpr_lite", "iso_27001_lite", "composite_score", "grade", "zero_incident_badge")


_LIC_AS_OF = "1998-06-01 00:00:00"
_LIC = duck("licenses", "license_requests").rstrip() + f""", asked AS (SELECT r.*, l.license_key IS NOT NULL AS found, l.hardware_id AS hw, is_active, expires_us, seats_total, seats_used
  FROM license_requests r LEFT JOIN licenses l USING (license_key)),
early AS (SELECT *, CASE WHEN NOT found THEN 'KEY_NOT_FOUND' WHEN NOT is_active THEN 'DEACTIVATED' WHEN {us(_LIC_AS_OF)} > expires_us THEN 'EXPIRED' END AS e FROM asked)
"""


@query("compliance_scorecard", _SCORECARD)
def compliance_scorecard(spark, sf):
    return _scorecard(spark, sf, True)


@query("compliance_scorecard_mean", _SCORECARD.replace("(hipaa * 35 + gdpr_lite * 35 + iso_27001_lite * 20 + dpdp_2026 * 10) / 100.0", "(hipaa + gdpr_lite + iso_27001_lite + dpdp_2026) / 4.0"))
def compliance_scorecard_mean(spark, sf):
    """The same with every framework counted alike."""
    return _scorecard(spark, sf, False)


@query(
    "license_status",
    _LIC + "SELECT seq, coalesce(e, CASE WHEN hardware_id IS NOT NULL AND hw IS NOT NULL AND hw <> hardware_id THEN 'HARDWARE_MISMATCH' ELSE 'VALID' END) AS reason FROM early",
)
def license_status(spark, sf):
    s = comp.license_status(view(spark, sf, "license_requests"), view(spark, sf, "licenses"), _LIC_AS_OF)
    return s.select("seq", "reason")


@query(
    "license_seats",
    _LIC
    + """, fit AS (SELECT *, CASE WHEN e IS NULL AND (hw IS NULL OR coalesce(hw = hardware_id, FALSE)) THEN 1 ELSE 0 END AS take FROM early),
run AS (SELECT *, seats_used + coalesce(sum(take) OVER (PARTITION BY license_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM fit)
SELECT seq, o AS outcome, CASE WHEN o = 'ACTIVATED' THEN CAST(seats_total - taken - 1 AS BIGINT) END AS seats_remaining FROM (
  SELECT *, coalesce(e, CASE WHEN taken >= seats_total THEN 'SEATS_FULL' WHEN take = 0 THEN 'HARDWARE_MISMATCH' ELSE 'ACTIVATED' END) AS o FROM run)""",
)
def license_seats(spark, sf):
    s = comp.license_activate(view(spark, sf, "license_requests"), view(spark, sf, "licenses"), _LIC_AS_OF, width=5_000)
    return s.select("seq", "outcome", "seats_remaining")


@query(
    "api_key_status",
    duck("licenses")
    + f"""SELECT license_key, CASE WHEN NOT is_active THEN 'API_KEY_INVALID' WHEN expires_us < {us(_LIC_AS_OF)} THEN 'API_KEY_EXPIRED'
  WHEN NOT (list_contains(string_split(scope_list, ','), 'proxy:inspect') OR list_contains(string_split(scope_list, ','), '*')) THEN 'API_KEY_SCOPE_DENIED' ELSE 'OK' END AS status FROM licenses""",
)
def api_key_status(spark, sf):
    keys = view(spark, sf, "licenses").withColumn("scopes", F.split("scope_list", ","))
    return comp.api_key_status(keys, _LIC_AS_OF).select("license_key", "status")


@query(
    "upsert_licenses",
    duck("licenses")
    + """, v AS (SELECT license_key, seats_used, 1 AS version FROM licenses UNION ALL
  SELECT concat('LIC-', o_custkey), CAST(o_orderkey AS BIGINT), 2 + o_orderkey FROM orders)
SELECT license_key, arg_max(seats_used, version) AS seats_used FROM v GROUP BY 1""",
)
def upsert_licenses(spark, sf):
    old = view(spark, sf, "licenses").select("license_key", "seats_used", F.lit(1).cast("bigint").alias("version"))
    new = load(spark, sf, "orders").select(
        F.concat(F.lit("LIC-"), "o_custkey").alias("license_key"), F.col("o_orderkey").alias("seats_used"), (F.col("o_orderkey") + 2).alias("version")
    )
    return upsert_by_key(old, new, "license_key", "version").select("license_key", "seats_used")


@query("upsert_licenses_buckets", ORACLES["upsert_licenses"])
def upsert_licenses_buckets(spark, sf):
    """The same as a table in buckets in the shared folder, of which an upsert rewrites those that it touches."""
    old = view(spark, sf, "licenses").select("license_key", "seats_used", F.lit(1).cast("bigint").alias("version"))
    new = load(spark, sf, "orders").select(
        F.concat(F.lit("LIC-"), "o_custkey").alias("license_key"), F.col("o_orderkey").alias("seats_used"), (F.col("o_orderkey") + 2).alias("version")
    )
    base = f"{checkpoint_dir(spark)}/licenses-{uuid.uuid4().hex}"
    buckets.create_buckets(old, base, "license_key", "version", 16)
    buckets.upsert_buckets(new, base, "license_key", "version")
    return buckets.read_buckets(spark, base).select("license_key", "seats_used")


@query(
    "column_mask",
    """SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '[REDACTED]' END AS patient_id, c_mktsegment,
  CASE WHEN c_acctbal IS NOT NULL THEN '[REDACTED]' END AS billing_code FROM customer""",
)
def column_mask(spark, sf):
    from ..operators.mask import MASK_PRESETS

    c = load(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("patient_id"), "c_mktsegment", F.col("c_acctbal").alias("billing_code"))
    return mask_columns(c, MASK_PRESETS["rcm"])


# ---- usage of AI tools ----------------------------------------------------

_WATCH = """hosts AS (SELECT seq, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host FROM dns_log),
ranked AS (SELECT DISTINCT host, ('0x' || substring(sha256(host), 1, 6))::BIGINT AS rk FROM hosts),
watch AS (SELECT host AS domain, concat('Tool ', rk) AS name, CASE rk % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Acme' ELSE 'Globex' END AS vendor,
  CASE rk % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE NULL END AS risk FROM ranked WHERE rk % 2 = 1
  UNION ALL SELECT 'example.org', 'Example suite', 'Example', 'LOW'),
hits AS (SELECT h.seq, w.domain, w.name, w.vendor, coalesce(w.risk, 'MEDIUM') AS risk FROM hosts h JOIN watch w
  ON h.host = w.domain OR ends_with(h.host, '.' || w.domain) QUALIFY row_number() OVER (PARTITION BY h.seq ORDER BY length(w.domain) DESC) = 1)"""


def _detections(spark, sf, detect=shadow.detect_shadow_ai):
    log = view(spark, sf, "dns_log").select("seq", shadow.host_of(F.col("url")).alias("host"))
    log.createOrReplaceTempView("shadow_hosts")
    # The watch list is made from the hosts of the log: about every second one, by a digest.
    watch = spark.sql(
        """SELECT host AS domain, concat('Tool ', rk) AS name, CASE rk % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Acme' ELSE 'Globex' END AS vendor,
  CASE rk % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE NULL END AS risk
FROM (SELECT DISTINCT host, CAST(conv(substring(sha2(host, 256), 1, 6), 16, 10) AS BIGINT) AS rk FROM shadow_hosts) WHERE rk % 2 = 1
UNION ALL SELECT 'example.org', 'Example suite', 'Example', 'LOW'"""
    )
    return detect(log, watch, "seq")


@query("shadow_usage", duck("dns_log", ctes=_WATCH) + "SELECT seq, domain, name AS tool_name, vendor, risk FROM hits")
def shadow_usage(spark, sf):
    return _detections(spark, sf).select("seq", "domain", "tool_name", "vendor", "risk")


@query("shadow_usage_large", duck("dns_log", ctes=_WATCH) + "SELECT seq, domain, name AS tool_name, vendor, risk FROM hits")
def shadow_usage_large(spark, sf):
    """The same as for a list too large to broadcast: hosts and domains sorted together by reversed name."""
    return _detections(spark, sf, shadow.detect_in_large_list).select("seq", "domain", "tool_name", "vendor", "risk")


@query(
    "shadow_recent",
    duck("dns_log", ctes=_WATCH) + "SELECT seq, domain FROM hits WHERE risk = 'HIGH' ORDER BY seq DESC LIMIT 100",
)
def shadow_recent(spark, sf):
    return shadow.shadow_detections(_detections(spark, sf), "high").select("seq", "domain")


@query(
    "shadow_summary",
    duck("dns_log", ctes=_WATCH)
    + """SELECT coalesce(vendor, 'Unknown') AS vendor, count(*) AS total_detections, CAST(sum(CASE WHEN risk = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk,
  CAST(sum(CASE WHEN risk = 'MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS medium_risk FROM hits GROUP BY 1""",
)
def shadow_summary(spark, sf):
    return shadow.shadow_summary(_detections(spark, sf))


_DOMAINS = ", ".join(f"'{d}'" for d, *_ in shadow.AI_DOMAINS)
_LOGGED = f"CASE WHEN user_id % 2 = 0 THEN concat(CASE WHEN event_id % 3 = 0 THEN 'www.' ELSE '' END, {{pick}}) ELSE concat('site', user_id, '.example') END"


@query(
    "watchlist_hits",
    "WITH watch(domain, name, vendor, risk) AS (VALUES "
    + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in shadow.AI_DOMAINS)
    + "), log AS (SELECT event_id, " + _LOGGED.format(pick=f"[{_DOMAINS}][user_id // 2 % {len(shadow.AI_DOMAINS)} + 1]") + " AS host FROM events)"
    + " SELECT event_id, domain, name AS tool_name, vendor, risk FROM log JOIN watch ON host = domain OR ends_with(host, '.' || domain)",
)
def watchlist_hits(spark, sf):
    """Visits of watched tools in a log of hosts, against the fixed list."""
    pick = f"element_at(array({_DOMAINS}), CAST(user_id div 2 % {len(shadow.AI_DOMAINS)} + 1 AS INT))"
    log = load(spark, sf, "events").select("event_id", F.expr(_LOGGED.format(pick=pick)).alias("host"))
    return shadow.detect_shadow_ai(log, shadow.watchlist(spark), "event_id").select("event_id", "domain", "tool_name", "vendor", "risk")


# ---- metrics --------------------------------------------------------------

_BLOCKING = ", ".join(f"'{e}'" for e in metrics.BLOCKING_EVENTS)


@query(
    "hourly_series",
    duck("usage_events")
    + f"""SELECT us // 3600000000 * 3600000000 AS hour_us, CAST(sum(CASE WHEN event IN ({_BLOCKING}) THEN 1 ELSE 0 END) AS BIGINT) AS blocked, CAST(sum(pii_count) AS BIGINT) AS pii,
  {_MEAN} AS risk FROM usage_events GROUP BY 1 ORDER BY 1 DESC LIMIT 12""",
)
def hourly_series(spark, sf):
    return metrics.hourly_series(view(spark, sf, "usage_events")).select(_micros("hour"), "blocked", "pii", "risk")


@query(
    "detection_counts",
    duck("usage_events", ctes="dim(type, action, sample_token) AS (VALUES " + ", ".join(f"('{t}', '{a}', '{x}')" for t, a, x in metrics.DETECTIONS) + ")")
    + "SELECT type, action, sample_token, coalesce(n, 0) AS count FROM dim LEFT JOIN (SELECT detection_type AS type, count(*) AS n FROM usage_events GROUP BY 1) USING (type)",
)
def detection_counts(spark, sf):
    return metrics.detection_counts(view(spark, sf, "usage_events"))


@query(
    "event_summary",
    duck("usage_events")
    + """SELECT count(*) AS events, CAST(sum(CASE WHEN event <> 'PII_MASKED_BEFORE_LLM' THEN 1 ELSE 0 END) AS BIGINT) AS blocked, CAST(sum(pii_count) AS BIGINT) AS pii_detections,
  CAST(sum(CASE WHEN risk_score >= 7 THEN 1 ELSE 0 END) AS BIGINT) AS high_sensitivity_routes FROM usage_events""",
)
def event_summary(spark, sf):
    return metrics.event_summary(view(spark, sf, "usage_events"))


@query("recent_events", duck("usage_events") + "SELECT event_id, us, event FROM usage_events ORDER BY us DESC, event_id DESC LIMIT 25")
def recent_events(spark, sf):
    return metrics.recent_events(view(spark, sf, "usage_events")).select("event_id", "us", "event")


_HOOKS = """hooks AS (SELECT substring(sha256(concat('https://hook.example/', c_custkey, 't', c_custkey % 5000)), 1, 12) AS hook_id, c_custkey % 4 <> 0 AS active, concat('t', c_custkey % 5000) AS tenant_id,
  CASE c_custkey % 5 WHEN 0 THEN ['AI_QUERY'] WHEN 1 THEN ['PROMPT_BLOCKED', 'AI_QUERY'] WHEN 2 THEN ['USER_AUTO_QUARANTINED'] ELSE [] END AS event_types FROM customer)"""


def _hooks(spark, sf):
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    url, tenant = F.concat(F.lit("https://hook.example/"), k), F.concat(F.lit("t"), k % 5000)
    types = (
        F.when(k % 5 == 0, F.array(F.lit("AI_QUERY")))
        .when(k % 5 == 1, F.array(F.lit("PROMPT_BLOCKED"), F.lit("AI_QUERY")))
        .when(k % 5 == 2, F.array(F.lit("USER_AUTO_QUARANTINED")))
        .otherwise(F.array().cast("array<string>"))
    )
    return c.select(
        metrics.hook_id(url, tenant).alias("hook_id"), url.alias("target_url"), (k % 4 != 0).alias("active"), tenant.alias("tenant_id"), types.alias("event_types"),
        F.lit("s3cret").alias("secret"),
    )


_PAD = {m: "".join(f"\\x{(b ^ m):02X}" for b in b"s3cret".ljust(64, b"\0")) for m in (0x36, 0x5C)}


@query(
    "webhook_routes",
    duck("ledger_rows", ctes=_HOOKS)
    + f"""SELECT seq, hook_id, sha256(body) AS body_sha, 'sha256=' || sha256('{_PAD[0x5C]}'::BLOB || unhex(sha256('{_PAD[0x36]}'::BLOB || encode(body)))) AS signature FROM (
  SELECT seq, hook_id, concat('{{"event_type":"', action, '","tenant_id":"', tenant_id, '","timestamp":"', us, '","payload":"', user_id, '"}}') AS body
  FROM (SELECT * REPLACE (concat('t', seq % 5000) AS tenant_id) FROM ledger_rows) JOIN hooks USING (tenant_id) WHERE active AND list_contains(event_types, action))""",
)
def webhook_routes(spark, sf):
    e = view(spark, sf, "ledger_rows").select("seq", F.concat(F.lit("t"), F.col("seq") % 5000).alias("tenant_id"), F.col("action").alias("event_type"), F.col("us").alias("ts"), F.col("user_id").alias("payload"))
    r = metrics.route_webhooks(e, _hooks(spark, sf), "seq")
    return r.select("seq", "hook_id", "body_sha", "signature")


@query(
    "outbox_retry",
    """WITH q AS (SELECT o_orderkey AS delivery_id, o_orderkey % 3 AS attempts, 'HTTP_500' AS reason FROM orders),
r AS (SELECT o_orderkey AS delivery_id, o_orderstatus = 'F' AS delivered, 'HTTP_503' AS reason FROM orders WHERE o_orderstatus <> 'P')
SELECT q.delivery_id, q.attempts + CASE WHEN r.delivery_id IS NULL THEN 0 ELSE 1 END AS attempts, coalesce(r.reason, q.reason) AS reason
FROM q LEFT JOIN r USING (delivery_id) WHERE NOT coalesce(delivered, FALSE)""",
)
def outbox_retry(spark, sf):
    o = load(spark, sf, "orders")
    q = o.select(F.col("o_orderkey").alias("delivery_id"), (F.col("o_orderkey") % 3).alias("attempts"), F.lit("HTTP_500").alias("reason"))
    tried = o.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("delivery_id"), (F.col("o_orderstatus") == "F").alias("delivered"), F.lit("HTTP_503").alias("reason")
    )
    return metrics.retry_outbox(q, tried).select("delivery_id", "attempts", "reason")


@query(
    "control_room",
    duck("ledger_rows", "risk_events", ctes=LEDGER_CTE + ", " + _PROFILE)
    + """SELECT (SELECT count(*) FROM prof WHERE pii > 3 OR score >= 50 OR inj > 0) AS open_alerts, (SELECT count(*) FROM prof WHERE pii > 3) AS quarantined_users,
  CAST(sum(CASE WHEN risk_score > 7 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_events, CAST(sum(n_redactions) AS BIGINT) AS total_redactions,
  bool_and(entry_hash = sha256(canonical)) AS ledger_valid, count(*) AS total_entries, arg_max(entry_hash, seq) AS last_entry_hash FROM ledger""",
)
def control_room(spark, sf):
    return rooms.control_room(ledger(spark, sf, linked=True), view(spark, sf, "risk_events"), AS_OF_HOUR)
