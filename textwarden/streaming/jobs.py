"""Continuous forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.budget import MAX_COST, MAX_REQUESTS, WINDOW_US, request_cost
from ..operators.risk import (
    HOUR_US,
    PII_LIMIT,
    QUARANTINE_REASON,
    SEVERITY_UNITS,
    alerts,
    risk_profile,
    risk_score,
    severity_units,
)
from .state import Budget, TrailingHour

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of many actors belongs on disk; ``transformWithState`` needs this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_documents(spark: SparkSession, folder: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """New files of a drop folder as a stream; the checkpoint remembers what was processed."""
    files = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .schema("value string")
        .load(folder)
        .select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col("value").alias("text"))
    )
    return files.where(~F.endswith("file", F.lit(".tmp")) & ~F.startswith("file", F.lit(".")) & (F.trim("text") != ""))


def stream_risk(events: DataFrame, watermark: str = "10 minutes", window_us: int = HOUR_US) -> DataFrame:
    """Profile of the actor at each event of a stream, from state of the last hour.

    Columns in: ``event_id, actor_hash, ts, severity`` and the three flags.
    A batch is sorted per actor before it is added. A row within the watermark
    is scored against its whole hour, whatever came before it; later ones are
    dropped. The state of an actor ends with the hour after its last event.
    """
    num = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("bigint")
    slim = events.withWatermark("ts", watermark).select(
        "actor_hash",
        "event_id",
        "ts",
        F.unix_micros("ts").alias("us"),
        severity_units(F.col("severity")).alias("sev"),
        num("is_pii").alias("pii"),
        num("is_injection").alias("inj"),
        num("is_semantic").alias("sem"),
    )
    schema = "actor_hash string, event_id bigint, us bigint, sev bigint, pii bigint, inj bigint, sem bigint"
    state = slim.groupBy("actor_hash").transformWithStateInPandas(
        statefulProcessor=TrailingHour(window_us, int(pd.Timedelta(watermark).value // 1000)), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    exact = F.col("sev").cast("decimal(28,8)") / F.lit(SEVERITY_UNITS)
    return state.select(
        "event_id",
        "actor_hash",
        F.timestamp_micros("us").alias("ts"),
        risk_score(exact.cast("decimal(28,8)"), F.col("pii"), F.col("inj"), F.col("sem")).alias("risk_score"),
        F.col("pii").alias("pii_attempts_last_hour"),
        F.col("inj").alias("injection_attempts_last_hour"),
        F.col("sem").alias("semantic_hits_last_hour"),
        (F.col("pii") > PII_LIMIT).alias("quarantined"),
        F.when(F.col("pii") > PII_LIMIT, QUARANTINE_REASON).alias("quarantine_reason"),
    )


def stream_budget(
    requests: DataFrame, max_requests: int = MAX_REQUESTS, window_us: int = WINDOW_US, max_cost: float = MAX_COST, watermark: str = "10 minutes"
) -> DataFrame:
    """Budget decisions on a stream of ``request_id, actor STRING, ts, tokens``.

    The state of an actor ends with its window; requests later than the
    watermark are dropped.
    """
    slim = requests.withWatermark("ts", watermark).select("actor", "request_id", "ts", F.unix_micros("ts").alias("us"), request_cost(F.col("tokens")).alias("cost"))
    return slim.groupBy("actor").transformWithStateInPandas(
        statefulProcessor=Budget(max_requests, window_us, max_cost),
        outputStructType="actor string, request_id bigint, us bigint, decision string",
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_hourly(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Events and quarantine-relevant events per actor and hour, closed by the watermark."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 hour").alias("w"), "actor_hash")
        .agg(F.count("*").alias("n_events"), F.count_if("is_pii").alias("n_pii"))
        .select(F.col("w.start").alias("hour"), "actor_hash", "n_events", "n_pii")
    )


def stream_daily_first(alert_stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """At most one alert per day: the first to arrive."""
    return alert_stream.withColumn("day", F.to_date("ts")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["day"])


def start_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; the checkpoint belongs in a shared folder."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )


def control_room_writer(store: str, target: str, as_of: Callable[[], str], snapshot: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: append the batch to the store, then replace the snapshot.

    A batch that is run again overwrites its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        events = batch.sparkSession.read.parquet(store)
        snapshot(events, as_of()).write.mode("overwrite").json(target)

    return write


def risk_snapshot(events: DataFrame, as_of: str) -> DataFrame:
    """Open alerts and quarantined actors at one instant."""
    profiles = risk_profile(events, as_of)
    loud = alerts(profiles).agg(F.count("*").alias("open_alerts")).withColumn("k", F.lit("alerts"))
    held = profiles.agg(F.count_if("quarantined").alias("quarantined_users")).withColumn("k", F.lit("held"))
    both = loud.unionByName(held, allowMissingColumns=True)
    return both.agg(F.max("open_alerts").alias("open_alerts"), F.max("quarantined_users").alias("quarantined_users"))
