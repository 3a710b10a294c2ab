"""Running totals in a global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.sources.shared import materialise


def before(df: DataFrame, order: list[str | Column], name: str, value: Column | None = None) -> DataFrame:
    """Adds the total of value (1 if None) over all rows that come earlier in the order.

    Rows are dealt into ranges of the order and written, so that the totals of the ranges and the rows in them
    are those of one partitioning; each range is then numbered on its own and shifted by the ranges before it.
    """
    one = F.lit(1).cast("long") if value is None else value
    rows = df.withColumn("__value", one).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    rows = materialise(rows, "ranges")
    sizes = rows.groupBy("__part").agg(F.sum("__value").alias("__size"))
    shifts = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__shift"))  # one row per partition
    inside = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(shifts), "__part")
    return rows.withColumn(name, F.col("__shift") + F.col("__inside")).drop("__part", "__value", "__shift", "__inside")


def place_within(df: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds how many rows of the same group (by; no nulls) come earlier in the order: places over all groups, less where the group starts.

    One group may hold any part of the rows, and many groups cost no more than one.
    """
    placed = materialise(before(df, [*by, *order], "__place"), "placed")
    starts = placed.groupBy(*by).agg(F.min("__place").alias("__start"))
    return placed.join(starts, by).withColumn(name, F.col("__place") - F.col("__start")).drop("__place", "__start")
