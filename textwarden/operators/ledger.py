"""Hash-chained audit ledger: sealing, verification and analytics.

A ledger frame has ``seq`` (the chain order) and a ``canonical`` text per
entry, written when the entry is sealed. Long chains are cut into blocks of
``seq``; a block is sorted by one task, and what must cross blocks is carried
by one row per block. A chain is sealed in order by one task, so the caller
chooses chains of bounded length (a tenant and a day, say) and ties them
together with a chain over their heads (``chain_heads``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, hash_text, ledger_actor_hash, sha256
from ..schemas import LEDGER
from ..session import cut
from .trees import merkle_tree, numbered

GENESIS = "GENESIS"
PREV_MARK = "@@previous-entry-hash@@"
_EMPTY = {"metadata": "{}", "department": "UNKNOWN", "tenant_id": "default"}
HIGH_RISK = 7.0
BLOCK = 1_000_000  # entries per task when a chain is checked
FANOUT = 10_000  # digests per node of the root tree
KEY_SPAN = 1 << 63  # range of the keys that a root tree must cover
BROADCAST_TENANTS = 100_000  # tenants up to which their names are broadcast


# ---- sealing --------------------------------------------------------------


def salted(canonical: Column, salt: str) -> Column:
    return F.concat(F.lit(f"{salt}:"), canonical)


def entry_hash(canonical: Column, salt: str | None = None) -> Column:
    """Digest of a stored canonical text, with or without the ledger salt."""
    return sha256(canonical if salt is None else salted(canonical, salt))


def ledger_body(entries: DataFrame, out: str = "body") -> DataFrame:
    """Canonical JSON of the ledger fields, with a mark where the link goes."""
    fields = [f.name for f in LEDGER.fields if f.name not in ("prev_hash", "signature", "entry_hash")]
    cols = [
        (F.coalesce(F.col("metadata"), F.lit("{}")) if n == "metadata" and n in entries.columns else F.col(n) if n in entries.columns else F.lit(_EMPTY.get(n)).cast(LEDGER[n].dataType)).alias(n)
        for n in fields
    ]
    record = F.to_json(F.struct(*cols, F.lit(PREV_MARK).alias("prev_hash")), {"ignoreNullFields": "false"})
    return entries.withColumn(out, canonical_json(parse=("metadata",))(record))


def foreign_entry_hash(line: Column, salt: str | None = None) -> Column:
    """Digest of a JSON ledger line written elsewhere: canonicalised first."""
    drop = ("entry_hash",) if salt is None else ("entry_hash", "signature")
    return entry_hash(canonical_json(drop)(line), salt)


def build_chain(entries: DataFrame, chain: str = "chain_id", seq: str = "seq", body: str = "body", salt: str = "") -> DataFrame:
    """Seal entries: each digest covers the entry and the digest before it.

    ``body`` is the text of an entry with ``PREV_MARK`` where the digest of the
    previous entry belongs (see ``ledger_body``). A digest depends on the one
    before, so a chain is sealed in order by one task, through which its rows
    stream in batches; different chains are sealed in parallel.
    """
    schema = entries.select("*", F.lit("").alias("prev_hash"), F.lit("").alias("canonical"), F.lit("").alias("entry_hash")).schema
    prefix = f"{salt}:"

    def seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        current, prev, begun = None, GENESIS, False
        for pdf in batches:
            prevs, canon, hashes = [], [], []
            for c, text in zip(pdf[chain], pdf[body]):
                if not begun or c != current:
                    current, prev, begun = c, GENESIS, True
                full = text.replace(PREV_MARK, prev)
                prevs.append(prev)
                prev = hashlib.sha256((prefix + full).encode()).hexdigest()
                canon.append(full)
                hashes.append(prev)
            yield pdf.assign(prev_hash=prevs, canonical=canon, entry_hash=hashes)

    # By a digest, as a repartition by the key of a join before it is dropped from the plan (see budget.window_starts).
    return entries.repartition(F.xxhash64(chain)).sortWithinPartitions(chain, seq).mapInPandas(seal, schema)


def chain_heads(sealed: DataFrame, chain: str = "chain_id", seq: str = "seq", root: str = "root") -> DataFrame:
    """Entries of a chain over chains: one per chain, in the order of their names.

    The body of an entry holds the name, the length and the last digest of a
    chain, so sealing them with ``build_chain`` and checking them with
    ``verify_chain`` covers every chain: neither a chain nor its last entries can
    be replaced or left out unseen. ``seq`` numbers the names from 1.
    """
    heads = sealed.groupBy(F.col(chain).alias("name")).agg(F.count("*").alias("entries"), F.max_by("entry_hash", seq).alias("head"))
    # One row per chain; their sealing is sequential too, so one task is what it takes.
    numbered = heads.withColumn("seq", F.row_number().over(Window.partitionBy(F.lit(root)).orderBy("name")).cast("bigint"))
    body = F.concat_ws("|", "name", F.col("entries").cast("string"), "head", F.lit(PREV_MARK))
    return numbered.select(F.lit(root).alias("chain_id"), "seq", "name", "entries", "head", body.alias("body"))


def head_proofs(sealed: DataFrame, chain: str = "chain_id", seq: str = "seq") -> DataFrame:
    """name, entries, head, leaf, path, root of every chain: a hash tree over the heads, in the order of their names.

    Whoever holds the root can check one chain by its leaf and a path of as
    many digests as the tree has levels; no task sees all heads.
    """
    heads = sealed.groupBy(F.col(chain).alias("name")).agg(F.count("*").alias("entries"), F.max_by("entry_hash", seq).alias("head"))
    leaf = sha256(F.concat_ws("|", "name", F.col("entries").cast("string"), "head"))
    leaves = cut(numbered(heads.withColumn("leaf", leaf), (), "name"))
    root, paths = merkle_tree(leaves)
    top = root.first()
    return leaves.join(paths, "idx").select("idx", "name", "entries", "head", "leaf", "path", F.lit(top["root"] if top else None).cast("string").alias("root"))


# ---- verification ---------------------------------------------------------


def _checked(ledger: DataFrame, chain: str | None, salt: str | None, seq: str, signature: str | None) -> DataFrame:
    """Slim rows with the content check done before anything is shuffled."""
    stored = F.col("entry_hash")
    ok = entry_hash(F.col("canonical"), salt).eqNullSafe(stored)
    if signature:
        ok = ok & F.coalesce(F.col(signature), stored).eqNullSafe(stored)
    return ledger.select(
        (F.lit("global") if chain is None else F.col(chain)).alias("chain_id"),
        F.col(seq).cast("bigint").alias("seq"),
        "prev_hash",
        "entry_hash",
        ok.alias("content_ok"),
    )


def chain_breaks(ledger: DataFrame, chain: str | None = None, salt: str | None = None, seq: str = "seq", signature: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per chain and block: counts, edges and the first break inside it."""
    rows = _checked(ledger, chain, salt, seq, signature).withColumn("block", F.expr(f"CAST(seq AS BIGINT) div {int(block)}L"))
    w = Window.partitionBy("chain_id", "block").orderBy("seq")
    linked = rows.withColumns({"before": F.lag("entry_hash").over(w), "first": F.row_number().over(w) == 1})
    link_ok = F.col("first") | F.col("prev_hash").eqNullSafe(F.col("before"))
    bad = ~link_ok | ~F.col("content_ok")
    reason = F.when(~link_ok, "prev_hash mismatch").otherwise("content tampered")
    return linked.groupBy("chain_id", "block").agg(
        F.count("*").alias("n"),
        F.min("seq").alias("first_seq"),
        F.min_by("prev_hash", "seq").alias("first_prev"),
        F.max_by("entry_hash", "seq").alias("last_hash"),
        F.min(F.when(bad, F.struct("seq", reason.alias("reason")))).alias("broken"),
    )


def verify_chain(ledger: DataFrame, chain: str | None = None, salt: str | None = None, seq: str = "seq", signature: str | None = None, block: int = BLOCK) -> DataFrame:
    """Per chain: valid, total entries, and where and why the first break is.

    The link is checked before the content. Later entries are compared with
    the stored digest, so one change yields one break and the check is exact
    without recomputing the chain in order. An empty global chain is valid.
    """
    blocks = chain_breaks(ledger, chain, salt, seq, signature, block)
    w = Window.partitionBy("chain_id").orderBy("block")
    edge_bad = ~F.col("first_prev").eqNullSafe(F.coalesce(F.lag("last_hash").over(w), F.lit(GENESIS)))
    per_block = blocks.withColumn("edge_bad", edge_bad)
    edge = F.when(F.col("edge_bad"), F.struct(F.col("first_seq").alias("seq"), F.lit("prev_hash mismatch").alias("reason")))
    # At the first entry of a block a broken link outranks its content.
    first = F.when(F.col("edge_bad"), edge).otherwise(F.col("broken"))
    found = per_block.select("chain_id", "n", first.alias("broken"))
    if chain is None:  # one row that counts nothing, so that an empty ledger is a chain too
        nothing = ledger.sparkSession.range(1).select(F.lit("global").alias("chain_id"), F.lit(0).cast("bigint").alias("n"))
        found = found.unionByName(nothing, allowMissingColumns=True)
    return found.groupBy("chain_id").agg(
        F.sum("n").alias("total_entries"), F.min("broken").alias("broken")
    ).select(
        "chain_id",
        F.col("broken").isNull().alias("valid"),
        "total_entries",
        F.col("broken.seq").alias("corrupted_seq"),
        F.col("broken.reason").alias("corrupted_reason"),
    )


def verify_links(pairs: DataFrame, previous: str = "previous_entry_hash", current: str = "prev_hash") -> DataFrame:
    return pairs.withColumn("link_ok", F.coalesce(F.col(previous), F.lit("")) == F.coalesce(F.col(current), F.lit("")))


def reseal(ledger: DataFrame, archive: str, active: str, as_of: str, salt: str = "", triggered_by: str = "SYSTEM", user_role: str = "SUPER_ADMIN", tenant: str = "default", reason: str = "LEDGER_CHAIN_RESEAL", file_hash: str | None = None) -> DataFrame:
    """Archive a broken ledger unchanged and start a new chain.

    Returns the incident row; a valid ledger is left alone and gives no row.
    The caller's ledger is written to ``archive`` as it is, never rewritten.
    """
    spark = ledger.sparkSession
    status = verify_chain(ledger, salt=salt).first()
    schema = (
        "generated_at string, reason string, triggered_by string, user_role string, tenant_id string, archived_path string, "
        "archived_sha256 string, previous_last_hash string, valid_before boolean, entries_before bigint, "
        "corrupted_seq_before bigint, corrupted_reason_before string, salt_fingerprint string"
    )
    if status is None or status.valid:
        return spark.createDataFrame([], schema)
    ledger.write.mode("error").parquet(archive)
    digest = file_hash or merkle_root(spark.read.parquet(archive), "entry_hash").first().ledger_root
    last = ledger.agg(F.max_by("entry_hash", "seq").alias("h")).first().h
    fingerprint = spark.range(1).select(F.substring(sha256(F.lit(salt)), 1, 16)).first()[0]
    row = (as_of, reason, triggered_by, user_role, tenant, archive, digest, last, False, status.total_entries, status.corrupted_seq, status.corrupted_reason, fingerprint)
    incident = spark.createDataFrame([row], schema)
    entry = ledger_body(
        incident.select(
            F.lit("global").alias("chain_id"),
            F.lit(1).cast("bigint").alias("seq"),
            F.col("generated_at").alias("timestamp"),
            ledger_actor_hash(F.col("tenant_id"), F.col("triggered_by"), F.col("user_role")).alias("actor_hash"),
            "tenant_id",
            F.col("triggered_by").alias("user_id"),
            "user_role",
            F.lit("SECURITY").alias("department"),
            F.lit("LEDGER_RESEALED").alias("action"),
            F.array().cast("array<string>").alias("redactions_applied"),
            F.lit("LEDGER_RESEAL").alias("policy_triggered"),
            F.lit(9.9).alias("risk_score"),
            F.to_json(F.struct("reason", "archived_path", "previous_last_hash")).alias("metadata"),
        )
    )
    build_chain(entry, salt=salt).write.mode("error").parquet(active)
    return incident


# ---- reads ----------------------------------------------------------------


def audit_entries(
    ledger: DataFrame,
    limit: int | None = 100,
    user_id: str | None = None,
    department: str | None = None,
    tenant_id: str | None = None,
    action: str | None = None,
    seq: str = "seq",
) -> DataFrame:
    """Newest entries first; the action filter is a case-insensitive substring."""
    df = ledger
    for name, value in (("user_id", user_id), ("department", department), ("tenant_id", tenant_id)):
        if value:
            df = df.where(F.col(name) == value)
    if action:
        df = df.where(F.contains(F.upper("action"), F.lit(action.upper())))
    if limit is None:
        return df
    return df.orderBy(F.col(seq).desc()).limit(limit)


def summary_figures() -> list[Column]:
    """The aggregates of an audit summary."""
    risk = F.col("risk_score").cast("decimal(28,8)")
    return [
        F.count("*").alias("total_events"),
        F.coalesce(F.round(F.avg(risk), 2).cast("double"), F.lit(0.0)).alias("avg_risk_score"),
        F.coalesce(F.sum(F.size(F.coalesce("redactions_applied", F.array().cast("array<string>")))), F.lit(0)).alias("total_redactions"),
        F.count_if(F.col("risk_score") > HIGH_RISK).alias("high_risk_events"),
    ]


def audit_summary(ledger: DataFrame, *by: str, tenant_id: str | None = None) -> DataFrame:
    return audit_entries(ledger, None, tenant_id=tenant_id).groupBy(*by).agg(*summary_figures())


def audit_actions(ledger: DataFrame, *by: str, tenant_id: str | None = None) -> DataFrame:
    df = audit_entries(ledger, None, tenant_id=tenant_id)
    return df.groupBy(*by, F.coalesce("action", F.lit("UNKNOWN")).alias("action")).agg(F.count("*").alias("n_events"))


_ACTIVITY = ("timestamp", "action", "policy_triggered", "risk_score", "model_queried", "actor_hash", "entry_hash")


def recent_activity(ledger: DataFrame, tenant_id: str | None = None, limit: int = 12, seq: str = "seq") -> DataFrame:
    newest = audit_entries(ledger, limit, tenant_id=tenant_id, seq=seq)
    return newest.select(seq, *[c for c in _ACTIVITY if c in ledger.columns])


def incident_timeline(ledger: DataFrame, actor_hash: str, tenant_id: str | None = None) -> DataFrame:
    """Entries of an actor, named in the entry itself or in its metadata."""
    df = audit_entries(ledger, None, tenant_id=tenant_id)
    return df.where((F.col("actor_hash") == actor_hash) | (F.get_json_object("metadata", "$.actor_hash") == actor_hash))


_CERTIFIED = ("timestamp", "action", "policy_triggered", "risk_score", "model_queried", "entry_hash")


def timeline_certificate(timeline: DataFrame, seq: str = "seq") -> DataFrame:
    """Digest over six fields of every entry of a timeline, as the root of a tree in the order of ``seq``."""
    fields = [F.col(c) if c in timeline.columns else F.lit(None).cast("string").alias(c) for c in _CERTIFIED]
    leaf = sha256(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    root = merkle_root(timeline.withColumn("leaf", leaf), "leaf", seq)
    return root.select(F.coalesce("entry_count", F.lit(0)).alias("total"), F.col("ledger_root").alias("certificate"))


def high_sensitivity(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.coalesce("risk_score", F.lit(0.0)) > HIGH_RISK)


def anchor_root(ledger: DataFrame, tenant_id: str | None = None, limit: int | None = None, seq: str = "seq") -> DataFrame:
    """Root over all digests of a tenant, or over its newest ``limit`` entries."""
    return merkle_root(audit_entries(ledger, limit, tenant_id=tenant_id, seq=seq), "entry_hash", seq)


def tree_levels(fanout: int) -> int:
    """Levels after which all keys below ``KEY_SPAN`` are in one node."""
    levels, span = 0, KEY_SPAN
    while span > 1:
        levels, span = levels + 1, -(-span // fanout)
    return levels


def merkle_root(ledger: DataFrame, digest: str = "entry_hash", seq: str = "seq", fanout: int = FANOUT, by: Sequence[str] = ()) -> DataFrame:
    """Root over a whole ledger, or one per group: digests of blocks, of blocks of blocks, and so on.

    Keys fall into one node if they agree after division by ``fanout``, so no
    node sees more than ``fanout`` digests however sparse the keys are, and
    there are as many levels as bring any 64-bit keys into one node. Keys are
    unique in their group and not negative. An empty ledger has the digest of
    no text.
    """
    rows = ledger.select(*by, F.col(seq).cast("bigint").alias("k"), F.col(digest).alias("h"), F.lit(1).cast("bigint").alias("n"))
    joined = sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda e: e["h"]), ""))
    for _ in range(tree_levels(fanout)):
        rows = rows.groupBy(*by, F.expr(f"k div {int(fanout)}L").alias("g")).agg(joined.alias("h2"), F.sum("n").alias("n2"))
        rows = rows.select(*by, F.col("g").alias("k"), F.col("h2").alias("h"), F.col("n2").alias("n"))
    return rows.groupBy(*by).agg(joined.alias("ledger_root"), F.coalesce(F.sum("n"), F.lit(0)).alias("entry_count"))


def usage_meter(users: DataFrame, keys: DataFrame, ledger: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Per tenant: active users and keys, events, redactions and reports."""
    u = users.where("is_active").groupBy(tenant).agg(F.count("*").alias("active_users"))
    k = keys.where("is_active").groupBy(tenant).agg(F.count("*").alias("active_api_keys"))
    s = ledger.groupBy(tenant).agg(
        F.count("*").alias("api_calls"),
        F.sum(F.size("redactions_applied")).cast("bigint").alias("redactions"),
        F.count_if(F.col("action") == "EVIDENCE_REPORT_GENERATED").alias("reports_generated"),
    )
    merged = u.join(k, tenant, "full").join(s, tenant, "full")
    return merged.na.fill(0)


def model_route_counts(ledger: DataFrame, *by: str) -> DataFrame:
    used = ledger.where("model_queried IS NOT NULL AND model_queried <> ''")
    return used.groupBy(*by, "model_queried").agg(F.count("*").alias("n_events"))


# ---- evidence -------------------------------------------------------------


def evidence_tables(ledger: DataFrame, profiles: DataFrame, tenant_id: str | None = None) -> dict[str, DataFrame]:
    """The tables of an evidence report and a certificate over them."""
    from .risk import heatmap

    entries = audit_entries(ledger, None, tenant_id=tenant_id)
    summary = audit_summary(entries)
    top = heatmap(profiles, 5)
    high = high_sensitivity(entries).orderBy(F.col("seq").desc()).limit(25)
    certificate = evidence_certificate(summary, merkle_root(entries), verify_chain(ledger), top)
    return {"summary": summary, "top_actors": top, "high_sensitivity": high, "certificate": certificate}


def evidence_certificate(summary: DataFrame, root: DataFrame, chain: DataFrame, top: DataFrame) -> DataFrame:
    """Digest over one row of each part: root, statistics, chain state and top actors."""
    parts = [
        root.select(F.lit(1).alias("p"), F.to_json(F.struct("*")).alias("j")),
        summary.select(F.lit(2).alias("p"), F.to_json(F.struct("*")).alias("j")),
        chain.select(F.lit(3).alias("p"), F.to_json(F.struct("*")).alias("j")),
        top.select(F.lit(4).alias("p"), F.to_json(F.struct("actor_hash", "risk_score")).alias("j")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    text = F.to_json(F.array_sort(F.collect_list(F.struct("p", "j"))))
    return rows.agg(sha256(text).alias("certificate"))


def _due(schedules: DataFrame) -> DataFrame:
    return schedules.where(F.coalesce("enabled", F.lit(True))).select(
        F.coalesce("org_name", F.lit("Buyer Organization")).alias("org_name"),
        F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"),
    )


def scheduled_evidence(schedules: DataFrame, ledger: DataFrame) -> DataFrame:
    """Report figures per enabled schedule: one pass over the ledger for all tenants."""
    return _due(schedules).join(audit_summary(ledger, "tenant_id"), "tenant_id", "left").na.fill(0)


def first_of_each(rows: DataFrame, by: str, order: Sequence[Column], limit: int, spread: str) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank``; a group is ranked in parts before the parts' first are."""
    part = rows.withColumn("__p", F.pmod(F.xxhash64(spread), F.lit(64)))
    inside = Window.partitionBy(by, "__p").orderBy(*order)
    best = part.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= limit).drop("__p")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit)


def tenant_certificates(
    schedules: DataFrame, ledger: DataFrame, profiles: DataFrame, seq: str = "seq", top: int = 5, high: int = 25, fanout: int = FANOUT
) -> dict[str, DataFrame]:
    """Evidence of every enabled schedule in one job: figures with root and certificate, top actors, high-sensitivity entries.

    The trees of all tenants are built together. A certificate covers the
    figures, the root and both tables of its tenant. ``profiles`` are those of
    ``risk_profile`` by tenant.
    """
    due = _due(schedules)
    wanted = due.select("tenant_id").distinct()
    rows = ledger.join(F.broadcast(wanted) if wanted.limit(BROADCAST_TENANTS + 1).count() <= BROADCAST_TENANTS else wanted, "tenant_id", "left_semi")
    actors = first_of_each(profiles.join(wanted, "tenant_id", "left_semi"), "tenant_id", [F.col("risk_score").desc(), F.col("actor_hash")], top, "actor_hash")
    actors = cut(actors.select("tenant_id", "rank", "actor_hash", "risk_score"))
    entries = first_of_each(high_sensitivity(rows), "tenant_id", [F.col(seq).desc()], high, seq)
    entries = cut(entries.select("tenant_id", "rank", F.col(seq).alias("seq"), "risk_score", "entry_hash"))
    listed = lambda df, *cols: df.groupBy("tenant_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", *cols))), lambda e: F.concat_ws(":", *[e[c].cast("string") for c in cols])), ",").alias("__l")
    )
    figures = due.join(audit_summary(rows, "tenant_id"), "tenant_id", "left").na.fill(0)
    figures = figures.join(merkle_root(rows, "entry_hash", seq, fanout, ("tenant_id",)).drop("entry_count"), "tenant_id", "left")
    figures = figures.join(listed(actors, "actor_hash").withColumnRenamed("__l", "top_actors"), "tenant_id", "left")
    figures = figures.join(listed(entries, "seq", "entry_hash").withColumnRenamed("__l", "high_entries"), "tenant_id", "left")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tenant_id", "total_events", "total_redactions", "high_risk_events", "ledger_root", "top_actors", "high_entries")]
    return {"figures": figures.withColumn("certificate", sha256(F.concat_ws("|", *parts))), "top_actors": actors, "high_sensitivity": entries}


# ---- access ---------------------------------------------------------------

# What each role may do. A super administrator may do everything.
PERMISSIONS = (
    "manage_users",
    "view_all_users",
    "edit_global_policy",
    "edit_dept_policy",
    "view_policy",
    "run_ai_query",
    "ingest_documents",
    "view_vault_status",
    "export_audit_csv",
    "export_audit_pdf",
    "view_audit_log",
    "view_all_sessions",
    "view_own_sessions",
    "manage_licenses",
    "view_license_status",
    "generate_board_report",
)
ROLE_PERMISSIONS = {
    "SUPER_ADMIN": PERMISSIONS,
    "DEPARTMENT_HEAD": (
        "edit_dept_policy",
        "view_policy",
        "run_ai_query",
        "ingest_documents",
        "view_vault_status",
        "export_audit_csv",
        "export_audit_pdf",
        "view_audit_log",
        "view_all_sessions",
        "view_own_sessions",
        "view_license_status",
        "generate_board_report",
    ),
    "STAFF": ("run_ai_query", "ingest_documents", "view_vault_status", "view_own_sessions", "view_policy"),
    "AUDITOR": (
        "view_audit_log",
        "view_all_sessions",
        "export_audit_csv",
        "export_audit_pdf",
        "view_vault_status",
        "generate_board_report",
        "view_policy",
        "view_license_status",
    ),
}
CROSS_DEPARTMENT_ROLES = ("SUPER_ADMIN", "AUDITOR")


def permission_matrix(spark) -> DataFrame:
    rows = [(r, p) for r, ps in ROLE_PERMISSIONS.items() for p in ps]
    return spark.createDataFrame(rows, "role string, permission string")


def allowed(requests: DataFrame, role: str = "role", permission: str = "permission") -> DataFrame:
    """Requests whose role has the permission; the matrix is a fixed small table."""
    matrix = F.broadcast(permission_matrix(requests.sparkSession).toDF(role, permission))
    return requests.join(matrix, [role, permission], "left_semi")


def denied(requests: DataFrame, role: str = "role", permission: str = "permission") -> DataFrame:
    matrix = F.broadcast(permission_matrix(requests.sparkSession).toDF(role, permission))
    return requests.join(matrix, [role, permission], "left_anti")


def audit_view(ledger: DataFrame, role: Column | str, department: Column | str | None) -> DataFrame:
    """Rows a viewer may see: all departments for two roles, their own for others."""
    r = F.lit(role) if isinstance(role, str) else role
    d = F.lit(department) if department is None or isinstance(department, str) else department
    own = r.isin("DEPARTMENT_HEAD", "STAFF") & F.col("department").eqNullSafe(d)
    return ledger.where(r.isin(*CROSS_DEPARTMENT_ROLES) | own)


def session_list(users: DataFrame, sessions: DataFrame, tenant_id: str | None = None, viewer: str | None = None, user: str = "user_id", limit: int = 250) -> DataFrame:
    """Newest sessions with their users; ``viewer`` restricts to one's own."""
    s = sessions if tenant_id is None else sessions.where(F.col("tenant_id") == tenant_id)
    u = users if viewer is None else users.where(F.col("email") == viewer)
    return s.join(u, user).orderBy(F.col("started_at").desc(), F.col("session_id").desc()).limit(limit)


def llm_request_log(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Ledger rows for governed traffic; seal them with ``build_chain``."""
    return prompts.select(
        F.lit("LLM_GATEWAY_REQUEST").alias("action"),
        ledger_actor_hash(F.lit("default"), F.col("actor"), F.lit("SERVICE_ACTOR")).alias("actor_hash"),
        F.lit("default").alias("tenant_id"),
        F.col("actor").alias("user_id"),
        F.lit("SERVICE_ACTOR").alias("user_role"),
        F.lit("UNKNOWN").alias("department"),
        hash_text(F.col(text)).alias("prompt_hash"),
        F.array().cast("array<string>").alias("redactions_applied"),
        "policy_triggered",
        F.col("preferred_model").alias("model_queried"),
        F.col("sensitivity_score").alias("risk_score"),
        *[c for c in ("prompt_id", "ts", "seq") if c in prompts.columns],
    )
