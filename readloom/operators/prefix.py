"""Running sums, maxima and neighbours along positions, without one task for a whole key.

A key (a chromosome, a supplier) may hold most of the rows, so positions are cut into blocks:
blocks are aggregated first, running values over blocks are small, and the rows of a block
finish the job. Ties at one position run together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(a, b)


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: dict[str, tuple[str, str]],
    block: int = 1 << 16,
    strict: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``df`` with, for each ``new: (kind, column)``, the running sum, max or min up to its position.

    ``strict`` leaves out rows at the position itself. Rows with a null position run before
    all others, in a block of their own; null values add nothing. For each ``x`` of ``carry``
    there are also ``previous_x`` and ``next_x`` of the rows beside it; positions must then be
    unique within a key, and rows with a null position have no neighbours.
    """
    keys, b = list(keys), F.floor(F.col(position) / block)
    cut = df.withColumn("__block", b)
    row = F.struct(F.col(position).alias("__p"), *[F.col(c) for c in carry])
    told = F.when(F.col(position).isNotNull(), row)
    ends = [F.min(told).alias("__first"), F.max(told).alias("__last")] if carry else []
    sums = [_AGG[k](c).alias(f"__b_{n}") for n, (k, c) in values.items()]
    by_block = cut.groupBy(*keys, "__block").agg(*sums, *ends)
    order = Window.partitionBy(*keys).orderBy(F.col("__block").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sides = [F.lag("__last").over(order).alias("__before"), F.lead("__first").over(order).alias("__after")] if carry else []
    offsets = by_block.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__ob"),
        *[_AGG[k](f"__b_{n}").over(before).alias(f"__o_{n}") for n, (k, _) in values.items()], *sides,
    )
    on = F.col("__block").eqNullSafe(F.col("__ob"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__block").orderBy(position)
    frame = inside.rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    joined = cut.join(offsets, on, "left").select(
        *df.columns, "__block",
        *[_combine(k, F.col(f"__o_{n}"), _AGG[k](c).over(frame)).alias(n) for n, (k, c) in values.items()],
        *([F.coalesce(F.lag(told).over(inside), "__before").alias("__l"), F.coalesce(F.lead(told).over(inside), "__after").alias("__n")] if carry else []),
    )
    return joined.select(
        *df.columns, *values,
        *[F.col("__l").getField(c).alias(f"previous_{c}") for c in carry], *[F.col("__n").getField(c).alias(f"next_{c}") for c in carry],
    )


def neighbours(df: DataFrame, keys: Sequence[str], position: str, carry: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """``df`` with ``previous_x`` and ``next_x`` of the rows beside it for each ``x`` of ``carry``."""
    return running(df, keys, position, {}, block, False, carry)
