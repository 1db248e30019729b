"""Intervals on a line: union, coverage, gaps, nearest, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.operators.joins import range_join


def merged(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Union of overlapping or touching intervals: keys, low, high, n."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col(low) > reach), 1).otherwise(0)
    islands = df.withColumn("__new", starts).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("__island")


def coverage(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Length covered by the union of a group's intervals, and the span from end to end."""
    parts = merged(df, keys, low, high)
    return parts.groupBy(*keys).agg(F.sum(F.col(high) - F.col(low)).alias("covered"), (F.max(high) - F.min(low)).alias("span"))


def empty_cells(df: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Runs of missing cells between a group's cells: keys, first_empty, last_empty."""
    w = Window.partitionBy(*keys).orderBy(cell)
    found = df.select(*keys, cell).distinct().withColumn("__next", F.lead(cell).over(w)).where(F.col("__next") > F.col(cell) + 1)
    return found.select(*keys, (F.col(cell) + 1).alias("first_empty"), (F.col("__next") - 1).alias("last_empty"))


def nearest_tick(value: Column, step: int) -> Column:
    """The nearest multiple of a step; halfway goes down."""
    return (F.ceil((value - F.lit(step) / 2) / F.lit(step)) * step).cast("bigint")


def smallest_container(boxes: DataFrame, key: str, group: list[str], low: str, high: str, area: str, width: int = 8) -> DataFrame:
    """For each interval the smallest one of its group that encloses it and is larger; ties go to the smallest key.

    An enclosing interval covers the start of the other, so pairs come from a range join on that point over cells of ``width``.
    Intervals equal in place and size stand for each other by their smallest key.
    """
    inner = boxes.select(*group, F.col(key).alias("inner"), F.col(low).alias("il"), F.col(high).alias("ih"), F.col(area).alias("ia"))
    outer = boxes.groupBy(*group, F.col(low).alias("ol"), F.col(high).alias("oh"), F.col(area).alias("oa")).agg(F.min(key).alias("outer"))
    pairs = range_join(inner, outer, group, "il", "ol", "oh", width).where((F.col("oh") >= F.col("ih")) & (F.col("oa") > F.col("ia")))
    return pairs.groupBy(F.col("inner").alias(key)).agg(F.min_by("outer", F.struct("oa", "outer")).alias("parent"))
