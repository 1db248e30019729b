"""Question records: predicates, defaults, ordered picks and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_flagged(flag: Column, ordinal: str, keys: list) -> Column:
    """Ordinal of the next flagged row of the group after this one, else of the first; null if none is flagged."""
    marked = F.when(flag, F.col(ordinal))
    from_the_end = Window.partitionBy(*keys).orderBy(F.desc(ordinal)).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(marked, ignorenulls=True).over(from_the_end), F.min(marked).over(Window.partitionBy(*keys)))


def first_error(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule that holds, or null: may the row be stored?"""
    return F.coalesce(*[F.when(test, F.lit(code)) for code, test in rules])


def unit_box(box: Column) -> Column:
    """True for [x1, y1, x2, y2] inside the unit square with positive sides."""
    inside = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    return F.coalesce((F.size(box) == 4) & inside & (box[0] < box[2]) & (box[1] < box[3]), F.lit(False))


def overlap_share(a: list[Column], b: list[Column]) -> Column:
    """Common area of two boxes over the smaller one's area; zero if either has none."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    small = F.least(area(a), area(b))
    return F.when(small > 0, side(0) * side(1) / small).otherwise(0.0)


def affine(m: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the matrix (a, b, c, d, e, f) of a page description."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in m)
    return a * x + c * y + e, b * x + d * y + f


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """The middle value, the upper one of two."""
    ordered = F.array_sort(F.collect_list(value))
    return df.groupBy(key).agg(ordered.alias("__v")).select(key, F.element_at("__v", (F.floor(F.size("__v") / 2) + 1).cast("int")).alias("median"))


def apart(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Distinct values of each group that lie more than ``tolerance`` above the one before."""
    w = Window.partitionBy(*keys).orderBy(value)
    rows = df.select(*keys, value).distinct().withColumn("__before", F.lag(value).over(w))
    return rows.where(F.col("__before").isNull() | (F.col(value) - F.col("__before") > tolerance)).drop("__before")


def head_of(df: DataFrame, keys: list, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group; adds pos."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("pos") <= most)


def paged(df: DataFrame, keys: list, order: list, size: int = 20) -> DataFrame:
    """Adds page (from 1) and pos on it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("page", F.floor(n / size) + 1).withColumn("pos", n % size + 1)


def guard(df: DataFrame, most: int, what: str) -> DataFrame:
    """All rows, or an error if there are more than ``most``: too large a request is refused, never cut."""
    total = df.agg(F.count("*").alias("__n")).select(F.when(F.col("__n") > most, F.raise_error(F.lit(f"more than {most} {what}"))).otherwise(True).alias("__ok"))
    return df.join(F.broadcast(total), F.lit(True)).where("__ok").drop("__ok")


def overlay(base: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the columns that an edit of the same key sets (null: unchanged); last of several edits by ``ord``."""
    last = edits.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"__{c}") for c in columns])
    joined = base.join(last, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def dos_time(ts: Column) -> Column:
    """Time stamp of an archive entry: years from 1980, months, days, hours, minutes, two-second steps."""
    date = F.shiftleft(F.greatest(F.year(ts) - 1980, F.lit(0)), 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
    time = F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int"))
    return date.cast("bigint") * 65536 + time


def clamped(text: Column, low: float, high: float) -> Column:
    """A number from text, held between bounds; null if it is none."""
    return F.least(F.greatest(text.try_cast("double"), F.lit(float(low))), F.lit(float(high)))


def line_width(text: Column) -> Column:
    """Width of a line in hundredths: 55 for a character up to U+007F, 100 for others."""
    others = F.regexp_count(text, F.lit(r"[^\x{0}-\x{7F}]"))
    return (F.length(text) - others) * 55 + others * 100
