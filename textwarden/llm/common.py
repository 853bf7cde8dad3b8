"""Helpers shared by the corpus operators: tables in the shared folder, exact ranks, connected components."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, configure, cut


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that reach a Python worker at once; texts may be long.
BATCH = 1000
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings for operators that send texts to Python workers."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def worker_memory(name: str) -> dict:
    """A dict that lives as long as its Python worker, or until another name is asked for.

    Functions sent to workers bring no state of their own; what one operator
    remembers must not fill the worker of the next.
    """
    home = sys.modules.setdefault("_textwarden_worker", types.ModuleType("_textwarden_worker")).__dict__
    if home.get("name") != name:
        freed = home.pop("memory", None)
        home["name"], home["memory"] = name, {}
        if freed:
            freed.clear()
            _give_back()
    return home["memory"]


def fresh_worker() -> None:
    """Called first by functions of workers that remember nothing: they need the room of those that do."""
    worker_memory("")


def _give_back() -> None:
    """Freed memory goes back to the system where the C library can do that; else it stays with the worker."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def shared_path(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    Cuts the lineage; losing an executor costs no work that is already written.
    """
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids up to which they are broadcast to leave out their rows (8 MB of numbers); for more, rows are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in the only column of ``ids``; texts stay where they are if these are few."""
    gone = stored(ids.select(F.col(ids.columns[0]).alias("__gone")).where("__gone IS NOT NULL").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def bucket_of(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, buckets: int = 32) -> DataFrame:
    """Adds ``name``: numbers from 0 without gaps inside each combination of ``keys``.

    Rows are dealt into buckets by the hash of ``order``, numbered inside a
    bucket, and moved up by the counts of the buckets before it. A key that
    holds a third of all rows is so sorted by ``buckets`` tasks, not by one.
    """
    df = df.withColumn("__b", bucket_of(buckets, *order))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "__b")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__ob"),
                F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    # Dealt by bucket too: rows that already lie by their keys would else be numbered a whole key at a time.
    rows = df.repartition(*keys, "__b").withColumn("__r", F.row_number().over(inside) - 1)
    same = F.col("__b") == F.col("__ob")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (
        rows.join(offsets, same)
        .withColumn(name, (F.col("__r") + F.col("__off")).cast("long"))
        .drop("__b", "__ob", "__r", "__off", *[f"__k{i}" for i in range(len(keys))])
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b): columns node, component.

    Alternating large and small stars: every round hangs the neighbours of a
    node on its smallest neighbour. Minima are aggregated before the shuffle,
    and joins on a node with very many neighbours are left to the skew join.
    Self loops are allowed; an empty input gives an empty result.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
    )
    nodes = now
    now = now.where("u <> v")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        before, seen = seen, mark(now)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    every = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    stars = now.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m"))
    return every.join(stars, F.col("node") == F.col("__u"), "left").select(
        "node", F.coalesce("__m", "node").alias("component")
    )
