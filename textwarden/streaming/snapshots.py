"""The control room kept up to date batch by batch: hourly partials, versions, and commit markers.

A batch writes its rows below its own number, adds its hourly sums to those of
the version before, reads the rows of the live hour alone, and writes a new
version. The version counts only once its commit marker has been renamed into
place, so a reader never meets half a snapshot, and a batch that is run again
either finds its marker or overwrites what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.risk import HOUR_US, alerts, risk_profile, severity_units
from ..sources.commits import commit, forget, versions

HOURS = "hour bigint, events bigint, pii bigint, injections bigint, semantic bigint, severity_units bigint, batches array<bigint>"
_COUNTS = {"pii": "is_pii", "injections": "is_injection", "semantic": "is_semantic"}


def read_snapshot(spark: SparkSession, base: str, part: str = "snapshot") -> DataFrame:
    """The newest committed snapshot (or its ``hours``)."""
    done = versions(spark, base)
    if not done:
        raise FileNotFoundError(f"no committed version in {base}")
    return spark.read.parquet(f"{base}/versions/{done[-1]}/{part}")


def hour_of(us) -> F.Column:
    return F.floor(us / HOUR_US)


def hourly(events: DataFrame, batch: int) -> DataFrame:
    """Sums of one batch by hour; they add up with those of other batches."""
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return events.groupBy("hour").agg(
        F.count("*").alias("events"),
        *[count(c).alias(n) for n, c in _COUNTS.items()],
        F.sum(F.coalesce(severity_units(F.col("severity")), F.lit(0))).alias("severity_units"),
        F.array(F.lit(batch).cast("bigint")).alias("batches"),
    )


def merged(hours: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("events", *_COUNTS, "severity_units")]
    return hours.groupBy("hour").agg(*sums, F.array_sort(F.flatten(F.collect_list("batches"))).alias("batches"))


def _live(spark: SparkSession, base: str, hours: DataFrame, as_of: str, schema: str) -> DataFrame:
    """Rows of the hours that the trailing hour touches, from the batches that have some."""
    end = F.unix_micros(F.lit(as_of).cast("timestamp"))
    near = hours.where(F.col("hour").between(hour_of(end - HOUR_US), hour_of(end))).select("hour", F.explode("batches").alias("batch"))
    paths = [f"{base}/rows/batch={r['batch']}/hour={r['hour']}" for r in near.collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def control_room_batches(base: str, as_of: Callable[[], str], keep: int = 3) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for events ``actor_hash, ts, severity`` and the three flags."""
    facts = ["actor_hash", "ts", "severity", *_COUNTS.values()]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = versions(spark, base)
        if batch_id in done:
            return
        rows = f"{base}/rows/batch={batch_id}"
        slim = batch.select(*facts)
        slim.withColumn("hour", hour_of(F.unix_micros("ts"))).write.mode("overwrite").partitionBy("hour").parquet(rows)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
        own = hourly(spark.read.schema(schema + ", hour bigint").parquet(rows), batch_id).select(*[c.split()[0] for c in HOURS.split(", ")])
        before = [v for v in done if v < batch_id]
        if before:
            own = own.unionByName(spark.read.schema(HOURS).parquet(f"{base}/versions/{before[-1]}/hours"))
        new = f"{base}/versions/{batch_id}"
        merged(own).write.mode("overwrite").parquet(f"{new}/hours")
        hours = spark.read.schema(HOURS).parquet(f"{new}/hours")
        now = as_of()
        profiles = risk_profile(_live(spark, base, hours, now, schema), now)
        held = profiles.agg(F.count_if("quarantined").alias("quarantined_users"))
        loud = alerts(profiles).agg(F.count("*").alias("open_alerts"))
        sums = hours.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", *_COUNTS, "severity_units")], F.count("*").alias("active_hours"))
        one = lambda df: df.withColumn("__one", F.lit(1))
        snapshot = one(loud).join(one(held), "__one").join(one(sums), "__one").drop("__one").withColumn("as_of", F.lit(now))
        snapshot.coalesce(1).write.mode("overwrite").parquet(f"{new}/snapshot")
        commit(spark, base, batch_id)
        forget(spark, base, keep)

    return write
