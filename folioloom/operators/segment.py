"""Ordered scans: carry-forward, islands, spans, as-of lookups, accepted starts, longest chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(value: Column, keys: list, order: list) -> Column:
    """The last non-null value up to and with this row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def island(starts: Column, keys: list, order: list) -> Column:
    """Number of the section: one more at each row that starts one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(starts, 1).otherwise(0)).over(w)


def spans(df: DataFrame, keys: list, start: str) -> DataFrame:
    """Half-open spans: ``until`` is the next start; ``gap`` tells that the next number is not the successor."""
    w = Window.partitionBy(*keys).orderBy(start)
    after = F.lead(start).over(w)
    return df.withColumn("until", after).withColumn("gap", F.coalesce(after > F.col(start) + 1, F.lit(False)))


def accepted(value: Column, keys: list, order: list) -> Column:
    """True where a value exceeds all before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(value > F.max(value).over(w), F.lit(True))


def as_of(facts: DataFrame, marks: DataFrame, keys: list[str], at: str, carried: list[str]) -> DataFrame:
    """Each fact with the latest mark at or before it: one union and one running last value, no range join."""
    fact = facts.select("*", F.lit(1).alias("__side"), F.lit(None).cast("struct<" + ",".join(f"{c}:{marks.schema[c].dataType.simpleString()}" for c in carried) + ">").alias("__mark"))
    missing = [c for c in facts.columns if c not in [*keys, at]]
    mark = marks.select(*keys, at, *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in missing], F.lit(0).alias("__side"), F.struct(*carried).alias("__mark"))
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = fact.unionByName(mark).withColumn("__last", F.last("__mark", ignorenulls=True).over(w)).where("__side = 1")
    return both.select(*facts.columns, *[F.col(f"__last.{c}").alias(f"mark_{c}") for c in carried])


def longest_chain(df: DataFrame, key: str, order: str, value: str, most_step: int = 12) -> DataFrame:
    """Longest ascending subsequence with steps of 1 to ``most_step``, for each key: length, first and last value.

    Among chains of equal length the one that ends earliest wins, and each element keeps
    its earliest best predecessor.  Only values within the step of one another matter, so
    a table of the last ``most_step`` values replaces the quadratic comparison.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, best, top, at = None, {}, (0, 0, 0), 0  # best: value -> length, position, first value
        for frame in frames:
            done = []
            for k, v in zip(frame["k"].tolist(), frame["v"].tolist(), strict=True):
                if k != key_now:
                    if top[0]:
                        done.append((key_now, *top))
                    key_now, best, top, at = k, {}, (0, 0, 0), 0
                near = max(((best[p][0], -best[p][1], best[p][2]) for p in range(v - most_step, v) if p in best), default=(0, 0, v))
                if v not in best or near[0] + 1 > best[v][0]:
                    best[v] = (near[0] + 1, at, near[2])
                if near[0] + 1 > top[0]:
                    top = (near[0] + 1, near[2], v)
                at += 1
            yield pd.DataFrame(done, columns=["k", "length", "first_value", "last_value"])
        if top[0]:
            yield pd.DataFrame([(key_now, *top)], columns=["k", "length", "first_value", "last_value"])

    source = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("bigint").alias("v"))
    sorted_rows = source.repartition("k").sortWithinPartitions("k", "o")
    return sorted_rows.mapInPandas(run, f"k {kind}, length bigint, first_value bigint, last_value bigint").withColumnRenamed("k", key)


def row_clusters(df: DataFrame, keys: list[str], y: str, order: list[str], tolerance: float) -> DataFrame:
    """Lines of positioned runs: sorted by y, a run joins the first line whose anchor (its first y) is within tolerance.

    A run without y is in no line (null).  Each anchor depends on the one before, which no window
    expression says, so the sorted values of a task go through one loop; it holds one anchor.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", line bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, anchor, line = None, 0.0, -1
        for frame in frames:
            lines = []
            for *k, v in zip(*(frame[c].tolist() for c in [*keys, y]), strict=True):
                if v is None or v != v:  # NaN stands for null here
                    lines.append(None)
                    continue
                if k != page:
                    page, anchor, line = k, v, 0
                elif v - anchor > tolerance:  # values ascend, so only the last anchor can be in reach
                    anchor, line = v, line + 1
                lines.append(line)
            yield frame.assign(line=pd.array(lines, "Int64"))

    return df.repartition(*keys).sortWithinPartitions(*keys, y, *order).mapInPandas(run, schema)
