"""Exact ranks and running totals over a whole table, without one task holding it.

A window without partitions moves every row to one task. Here the table is
range-sorted, each sorted slice is numbered on its own, and only one row per
slice is combined. The sorted rows are written once (see `session.freeze`),
because a slice's content must not change when a later step reads it again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stayline.session import freeze

# monotonically_increasing_id keeps the partition above this many bits of row position.
POSITION_BITS = 33


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """Sort the table and add `_at` (increasing with the order) and `_slice`."""
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    return freeze(placed).withColumn("_slice", F.shiftright("_at", POSITION_BITS))


def number_rows(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Add the 1-based rank of every row under `order`, which must be unique."""
    placed = in_order(df, *order)
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_slice")
        .agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
        .select(
            "_slice",
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        )
    )
    # One row per sorted slice, so never more rows than shuffle partitions.
    return (
        placed.join(F.broadcast(shifts), "_slice")
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_slice", "_at", "_shift")
    )


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
    """`right` with its key columns renamed, and the condition that the keys are equal, nulls included."""
    renamed = right.withColumnsRenamed({n: f"_key_{n}" for n in names})
    return renamed, reduce(lambda a, b: a & b, [left[n].eqNullSafe(renamed[f"_key_{n}"]) for n in names])


def running_totals(
    df: DataFrame, order: Sequence[Column | str], sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add `cum_x` and `total_x` for every x in `sums`, along `order` within `by`.

    `by` plus `order` must be unique. Slices of one group are joined by the
    sums of the slices before, which is one row per slice and group.
    """
    placed = in_order(df, *by, *order)
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slice", *by)
        .agg(*[F.sum(c).alias(f"_in_{c}") for c in sums])
        .select(
            "_slice",
            *by,
            *[F.coalesce(F.sum(f"_in_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
            *[F.sum(f"_in_{c}").over(W.partitionBy(*by)).alias(f"total_{c}") for c in sums],
        )
    )
    inside = W.partitionBy("_slice", *by).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    run = placed.select("*", *[F.sum(c).over(inside).alias(f"_run_{c}") for c in sums])
    offsets, equal = same(run, offsets, ["_slice", *by])
    return (
        run.join(offsets, equal)
        .select(
            *df.columns,
            *[(F.col(f"_run_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sums],
            *[F.col(f"total_{c}") for c in sums],
        )
    )
