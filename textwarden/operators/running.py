"""Running sums per key that do not put a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], width: int, inclusive: bool = True, ties: Sequence[str] = ()
) -> DataFrame:
    """For each row the sums over all rows of its key up to its ``order`` value.

    ``order`` is a BIGINT. Rows are cut into cells of ``width`` along it, so a
    task sorts one cell of one key; what lies before a cell is the running
    total of the cell sums, a table that map-side aggregation keeps small.
    Rows with equal ``order`` see each other unless ``inclusive`` is false, or
    ``ties`` names columns that put them in order.
    """
    cells = df.withColumn("__cell", F.expr(f"`{order}` div {int(width)}L"))
    within = Window.partitionBy(*keys, "__cell").orderBy(order, *ties)
    last = Window.currentRow if inclusive else -1
    within = within.rowsBetween(Window.unboundedPreceding, last) if ties else within.rangeBetween(Window.unboundedPreceding, last)
    local = cells.withColumns({f"__l_{o}": F.coalesce(F.sum(c).over(within), F.lit(0)) for o, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        cells.groupBy(*keys, "__cell")
        .agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
        .select(*keys, "__cell", *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__c_{o}") for o in sums])
    )
    joined = local.join(carry, [*keys, "__cell"])
    return joined.withColumns({o: F.col(f"__l_{o}") + F.col(f"__c_{o}") for o in sums}).drop(
        "__cell", *[f"__l_{o}" for o in sums], *[f"__c_{o}" for o in sums]
    )
