"""Array helpers that stay linear for very long arrays and texts.

A fold that appends to an array copies it at each step. Here the input is cut
into chunks of ``CHUNK`` items, so that the copies stay short: n items cost
about ``n * CHUNK / 2 + (n / CHUNK) ** 2 / 2`` moves instead of ``n ** 2 / 2``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
BLOCK = 4096


def _chunk_ids(arr: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.greatest(F.size(arr), F.lit(1)) - 1) / CHUNK).cast("int"))


def _chunk(arr: Column, i: Column) -> Column:
    return F.slice(arr, i * CHUNK + 1, CHUNK)


def prefix_sums(lengths: Column) -> Column:
    """Inclusive running sums of an ``array<int>``."""
    zero = F.lit(0).cast("int")
    none = F.array().cast("array<int>")

    def local(arr: Column) -> Column:
        return F.aggregate(
            arr,
            F.struct(zero.alias("pos"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["pos"] + x).alias("pos"), F.array_append(acc["out"], acc["pos"] + x).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def total(arr: Column) -> Column:
        return F.coalesce(F.get(arr, F.size(arr) - 1), zero)

    chunks = F.transform(_chunk_ids(lengths), lambda i: local(_chunk(lengths, i)))
    bases = local(F.transform(chunks, total))
    return F.flatten(F.zip_with(chunks, bases, lambda c, b: F.transform(c, lambda x: x + b - total(c))))


def scan_fold(arr: Column, state: Column, step: Callable, item_type: str) -> Column:
    """Fold over ``arr`` carrying a scalar and emitting zero or one item per step.

    ``step(state, x)`` returns ``(new_state, keep, item)``; the kept items are
    returned in order.
    """
    none = F.array().cast(f"array<{item_type}>")
    nested = F.array().cast(f"array<array<{item_type}>>")

    def one(acc: Column, x: Column) -> Column:
        new_state, keep, item = step(acc["s"], x)
        return F.struct(
            new_state.alias("s"), F.when(keep, F.array_append(acc["out"], item)).otherwise(acc["out"]).alias("out")
        )

    def chunk(acc: Column, i: Column) -> Column:
        inner = F.aggregate(_chunk(arr, i), F.struct(acc["s"].alias("s"), none.alias("out")), one)
        # One-element transform binds the inner result so that it is computed once.
        return F.get(
            F.transform(
                F.array(inner),
                lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["out"], r["out"]).alias("out")),
            ),
            0,
        )

    return F.flatten(
        F.aggregate(_chunk_ids(arr), F.struct(state.alias("s"), nested.alias("out")), chunk, lambda acc: acc["out"])
    )


def text_blocks(text: Column) -> Column:
    """Blocks of ``BLOCK`` code points of a long text, NULL for a short one."""
    return F.when(F.length(text) > 4 * BLOCK, F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)))


def cut_text(text: Column, blocks: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` in code points, without walking a long text from its start."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.floor((F.greatest(end, start + 1) - 1) / BLOCK).cast("int") - first + 1
    return F.when(blocks.isNull(), F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))).otherwise(
        F.substring(
            F.array_join(F.slice(blocks, first + 1, count), ""),
            start - first * BLOCK + 1,
            F.greatest(end - start, F.lit(0)),
        )
    )


def explode_rows(df: DataFrame, keep: tuple, array: Column | str, alias: str, position: str | None = None) -> DataFrame:
    """One row per item of a computed array.

    A plain ``explode`` lets the optimizer add a filter on the size of the
    array, which repeats the whole computation below it; the outer form does
    not, and the rows of empty arrays are dropped afterwards.
    """
    if position:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, alias))
        return rows.where(F.col(position).isNotNull())
    return df.select(*keep, F.explode_outer(array).alias(alias)).where(F.col(alias).isNotNull())
