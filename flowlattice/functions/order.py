"""Running totals and exact quantiles over many levels, without one task for all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlattice.sources.scratch import cut_lineage

#: Above so many distinct values quantiles come from running totals instead of one aggregate.
IN_ONE_TASK = 1_000_000


def running_totals(levels: DataFrame, order: Sequence[Column], sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``<sum>_upto``: totals of a column over the rows up to each one, per group.

    Rows are dealt by ranges of the order; each range sums its own rows and the
    totals of the ranges before it (a row per range and group) are added.
    """
    by = list(by)
    place = cut_lineage(levels.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range_no", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per_range = place.groupBy("range_no", *by).agg(*[F.sum(c).alias(f"{c}_own") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    before = per_range.select("range_no", *by, *[F.coalesce(F.sum(f"{c}_own").over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums])
    summed = place.select("*", *[F.sum(c).over(inside).alias(f"{c}_here") for c in sums])
    out = summed.join(F.broadcast(before), ["range_no", *by])
    return out.select(*levels.columns, *[(F.col(f"{c}_here") + F.col(f"{c}_before")).alias(f"{c}_upto") for c in sums])


def quantiles(frame: DataFrame, column: str, fractions: Sequence[float], in_one_task: int = IN_ONE_TASK) -> list[float | None]:
    """Exact discrete quantiles (values of the column) of one column, nulls left out."""
    rows = frame.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    if rows.agg(F.approx_count_distinct("value")).first()[0] <= in_one_task:
        return list(rows.select(*[F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY value)") for f in fractions]).first())
    levels = cut_lineage(running_totals(rows.groupBy("value").agg(F.count("*").alias("n")), [F.col("value")], ["n"]), "levels")
    total = levels.agg(F.max("n_upto")).first()[0]
    return list(levels.agg(*[F.min(F.when(F.col("n_upto") >= total * f, F.col("value"))) for f in fractions]).first())


def interpolated(frame: DataFrame, column: str, fractions: dict[str, float], by: str) -> DataFrame:
    """(by, name...): exact interpolated quantiles per group, from running totals over distinct values."""
    rows = frame.where(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    levels = cut_lineage(running_totals(rows, [F.col("value")], ["n"], [by]), "levels")
    levels = levels.join(F.broadcast(levels.groupBy(by).agg(F.max("n_upto").alias("total"))), by)  # a row per group

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("n_upto") > rank, F.col("value")))

    def point(f: float) -> Column:
        rank = (F.max("total") - 1) * f
        place = (F.col("total") - 1) * f
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * (rank - F.floor(rank))

    return levels.groupBy(by).agg(*[point(f).alias(name) for name, f in fractions.items()])
