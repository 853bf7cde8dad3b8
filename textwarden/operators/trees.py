"""Binary hash trees over many leaves, and the path that proves a leaf to be in one.

Leaves are numbered in the order of a key, inside each group, by sorted range
partitions and the counts of those before. A node is the digest of its two
children's digests; a node without a sibling moves up as it is. A task builds
``2**STEP`` leaves' subtree and all paths within it, so a tree of a billion
leaves takes three rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..session import cut

STEP = 10  # levels of a subtree


def numbered(rows: DataFrame, by: Sequence[str], order: str, name: str = "idx") -> DataFrame:
    """Adds ``name``: numbers from 0 in the order of ``order`` inside each group, without one task that sees all."""
    dealt = cut(rows.repartitionByRange(*by, order).withColumn("__p", F.spark_partition_id()))
    upto = Window.partitionBy(*[f"__{c}" for c in by]).orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col("__p").alias("__q"), *[F.col(c).alias(f"__{c}") for c in by]).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    placed = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__p", *by).orderBy(order)) - 1)
    joined = placed.join(before, _same(by) & (F.col("__p") == F.col("__q")))
    return joined.select(*rows.columns, (F.col("__i") + F.col("__before")).cast("bigint").alias(name))


def _up(nodes: Column) -> Column:
    """The level above a list of digests, which is a column of its own."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))

    def node(i: Column) -> Column:
        left, right = F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)
        return F.when(right.isNotNull(), sha256(F.concat(left, right))).otherwise(left)

    return F.transform(pairs, node)


def _sibling(nodes: Column, place: Column) -> Column:
    """The digest beside a place, marked by its side; null if there is none."""
    left = place % 2 == 1
    return F.concat(F.when(left, "L:").otherwise("R:"), F.get(nodes, place + F.when(left, -1).otherwise(1)))


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out


def merkle_tree(leaves: DataFrame, by: Sequence[str] = (), digest: str = "leaf", idx: str = "idx", step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(``by``, root, n_leaves) of every group, and (``by``, idx, path): siblings from the leaf up, ``L:`` or ``R:`` and the digest.

    ``idx`` numbers the leaves of a group from 0 without gaps.
    """
    level = leaves.select(*by, F.col(idx).cast("bigint").alias("__at"), F.col(digest).alias("__h"), F.lit(1).cast("bigint").alias("__n"))
    paths = leaves.select(*by, F.col(idx).cast("bigint").alias("idx"), F.array().cast("array<string>").alias("path"))
    shift = 0
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__h"))), lambda e: e["__h"])
        blocks = level.groupBy(*by, F.shiftright("__at", step).alias("__blk")).agg(ordered.alias("__x0"), F.sum("__n").alias("__n"))
        for k in range(step):
            blocks = blocks.withColumn(f"__x{k + 1}", _up(F.col(f"__x{k}")))
        blocks = cut(blocks)
        held = blocks.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__blk").alias("__there"), *[f"__x{k}" for k in range(step)])
        place = F.shiftright("idx", shift).bitwiseAND(F.lit((1 << step) - 1)).cast("int")
        beside = paths.join(held, _same(by) & (F.shiftright("idx", shift + step) == F.col("__there"))).withColumn("__i", place)
        siblings = F.array_compact(F.array(*[_sibling(F.col(f"__x{k}"), F.shiftright("__i", k)) for k in range(step)]))
        paths = beside.select(*by, "idx", F.concat("path", siblings).alias("path"))
        level = cut(blocks.select(*by, F.col("__blk").alias("__at"), F.get(f"__x{step}", F.lit(0)).alias("__h"), "__n"))
        shift += step
        if level.where("__at > 0").isEmpty():
            return level.select(*by, F.col("__h").alias("root"), F.col("__n").alias("n_leaves")), paths


def proven(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""

    def up(node: Column, side: Column) -> Column:
        other = F.substring(side, 3, 64)
        return F.when(F.startswith(side, F.lit("L:")), sha256(F.concat(other, node))).otherwise(sha256(F.concat(node, other)))

    return F.aggregate(path, leaf, up)
