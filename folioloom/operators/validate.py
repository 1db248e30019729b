"""Row flags and set-level flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flags(rules: list[tuple[str, Column]]) -> Column:
    """Codes of the rules that hold, in the order given."""
    found = F.array(*[F.when(test, F.lit(code)) for code, test in rules])
    return F.filter(found, lambda c: c.isNotNull())


def overused(df: DataFrame, key: str, share: float = 0.15, least: int = 10) -> DataFrame:
    """Adds n (rows of the key), total and code_overused (n over ``share`` of at least ``least`` rows).

    The counts are small aggregates that are joined back, so no window gathers all
    rows in one task.  Null keys are never flagged.
    """
    counts = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    joined = df.join(counts, df[key].eqNullSafe(counts["__k"]), "left").drop("__k").join(F.broadcast(total), F.lit(True))
    over = (F.col("total") >= least) & (F.col("n") > share * F.col("total")) & F.col(key).isNotNull()
    return joined.withColumn("code_overused", over)


def uniform_sets(df: DataFrame, group: str, code: str) -> DataFrame:
    """For each group of two rows or more: is every row's code the same non-null one?"""
    found = df.groupBy(group).agg(F.count("*").alias("n"), F.count(code).alias("known"), F.min(code).alias("low"), F.max(code).alias("high"))
    return found.select(group, "n", ((F.col("n") > 1) & (F.col("known") == F.col("n")) & (F.col("low") == F.col("high"))).alias("uniform"))


def char_coverage(df: DataFrame, key: str, source: str, candidate: str) -> DataFrame:
    """Share of the source's characters, spaces aside, that the candidate holds as often."""
    def counted(column: str, name: str) -> DataFrame:
        chars = F.split(F.regexp_replace(column, r"\s", ""), "")
        return df.select(key, F.explode(chars).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count("*").alias(name))
    both = counted(source, "a").join(counted(candidate, "b"), [key, "ch"], "left")
    return both.groupBy(key).agg(F.sum("a").alias("n_chars"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("n_covered"))
