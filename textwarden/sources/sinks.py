"""Sinks: CSV exports, append-only ledgers, outboxes, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the audit export.
EXPORT_COLUMNS = (
    "timestamp",
    "tenant_id",
    "user_id",
    "user_role",
    "department",
    "action",
    "document",
    "prompt_hash",
    "redactions_applied",
    "policy_triggered",
    "model_queried",
    "risk_score",
    "entry_hash",
)


def audit_export(ledger: DataFrame) -> DataFrame:
    """Projection of the export; the array column becomes a JSON list with blanks after commas."""
    items = F.transform(
        F.coalesce("redactions_applied", F.array().cast("array<string>")),
        lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')),
    )
    as_json = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return ledger.select(
        *[
            (as_json if c == "redactions_applied" else F.col(c) if c in ledger.columns else F.lit(None).cast("string")).alias(c)
            for c in EXPORT_COLUMNS
        ]
    )


def write_audit_csv(ledger: DataFrame, path: str) -> None:
    audit_export(ledger).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append_ledger(df: DataFrame, path: str, partition: str | None = "tenant_id") -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def outbox_writer(path: str, event_type: str = "GOVERNANCE_ALERT") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        body = batch.select(F.lit(event_type).alias("event_type"), F.to_json(F.struct("*")).alias("alert"))
        body.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def write_outbox(alerts: DataFrame, path: str, batch_id: int = 0) -> None:
    outbox_writer(path)(alerts, batch_id)


def upsert_by_key(target: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Newest version per key. A maximum per key: hot keys are reduced before the shuffle."""
    rows = target.unionByName(updates, allowMissingColumns=True)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")
