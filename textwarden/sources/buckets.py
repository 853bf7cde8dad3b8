"""A table in buckets of its key, of which an upsert rewrites only those that it touches.

``data/version=V/bucket=B`` holds a bucket as some version wrote it, and a
manifest says for each bucket which one counts. A version counts once its
marker is in place (see ``commits``), so readers see all of an upsert or
nothing, and of two writers that start from one version only the first commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import commit, versions
from .sinks import upsert_by_key

MANIFEST = "bucket int, version bigint, buckets int"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifests/{version}")


def _write(rows: DataFrame, base: str, key: str, buckets: int, version: int, touched: list[int], before: int | None) -> None:
    spark = rows.sparkSession
    dealt = rows.withColumn("bucket", bucket_of(key, buckets))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/data/version={version}")
    new = spark.createDataFrame([(b, version, buckets) for b in touched], MANIFEST)
    if before is not None:
        new = new.unionByName(_manifest(spark, base, before).where(~F.col("bucket").isin(touched)))
    new.coalesce(1).write.mode("overwrite").parquet(f"{base}/manifests/{version}")
    if not commit(spark, base, version):
        raise RuntimeError(f"version {version} of {base} was committed by another writer")


def _paths(base: str, manifest: DataFrame) -> list[str]:
    return [f"{base}/data/version={r['version']}/bucket={r['bucket']}" for r in manifest.orderBy("bucket").collect()]


def create_buckets(rows: DataFrame, base: str, key: str, version: str, buckets: int = 64) -> None:
    """Start a table from rows, of which the newest of each key counts."""
    if versions(rows.sparkSession, base):
        raise FileExistsError(base)
    first = upsert_by_key(rows.limit(0), rows, key, version)
    touched = sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())
    _write(first, base, key, buckets, 1, touched, None)


def upsert_buckets(updates: DataFrame, base: str, key: str, version: str) -> int:
    """Merge updates into the buckets they fall into; the number of buckets rewritten."""
    spark = updates.sparkSession
    now = versions(spark, base)[-1]
    manifest = _manifest(spark, base, now)
    buckets = manifest.first()["buckets"]
    touched = sorted(r[0] for r in updates.select(bucket_of(key, buckets)).distinct().collect())
    if not touched:
        return 0
    held = _paths(base, manifest.where(F.col("bucket").isin(touched)))
    old = spark.read.schema(updates.schema).parquet(*held) if held else updates.limit(0)
    _write(upsert_by_key(old, updates, key, version), base, key, buckets, now + 1, touched, now)
    return len(touched)


def read_buckets(spark: SparkSession, base: str, key: str | None = None, values: list | None = None) -> DataFrame:
    """The table as last committed; only the buckets of ``values`` of the key if these are given."""
    manifest = _manifest(spark, base, versions(spark, base)[-1])
    if values is not None:
        buckets = manifest.first()["buckets"]
        wanted = spark.createDataFrame([(str(v),) for v in values], "k string").select(bucket_of("k", buckets)).distinct().collect()
        manifest = manifest.where(F.col("bucket").isin([r[0] for r in wanted]))
    paths = _paths(base, manifest)
    rows = spark.read.parquet(*paths)
    return rows if values is None else rows.where(F.col(key).cast("string").isin([str(v) for v in values]))
