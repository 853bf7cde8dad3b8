"""One snapshot over ledger and actor risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import summary_figures, verify_chain
from ..operators.metrics import snapshot
from ..operators.risk import is_loud, risk_profile


def control_room(ledger: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Open alerts, quarantined actors, ledger figures and its integrity, as one row.

    One pass over the events, one over the ledger for its figures and one for its chain.
    """
    profiles = risk_profile(events, as_of)
    parts = snapshot(
        actors=profiles.agg(F.count_if(is_loud()).alias("loud"), F.count_if("quarantined").alias("held")),
        stats=ledger.agg(*summary_figures(), F.max_by("entry_hash", "seq").alias("last")),
        chain=verify_chain(ledger).agg(F.bool_and("valid").alias("valid"), F.sum("total_entries").alias("n")),
    )
    get = lambda part, path, type_: F.get_json_object(part, f"$.{path}").cast(type_)
    return parts.select(
        get("actors", "loud", "bigint").alias("open_alerts"),
        get("actors", "held", "bigint").alias("quarantined_users"),
        get("stats", "high_risk_events", "bigint").alias("high_risk_events"),
        get("stats", "total_redactions", "bigint").alias("total_redactions"),
        get("chain", "valid", "boolean").alias("ledger_valid"),
        get("chain", "n", "bigint").alias("total_entries"),
        get("stats", "last", "string").alias("last_entry_hash"),
    )
