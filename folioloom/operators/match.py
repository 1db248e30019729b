"""Answer matching, conflicts, conditional updates and three-way merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_status(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """``entries``: entry, code, number, scope, value; ``questions``: question, code, number, scope, answer.

    An entry with a code matches by code alone; without, by number where scopes do not
    contradict.  The two cases are equi-joins of their own.  Status: unmatched (no question),
    ambiguous (several), conflict (another answer is there), matched.
    """
    q = questions.select("question", F.col("code").alias("q_code"), F.col("number").alias("q_number"), F.col("scope").alias("q_scope"), "answer")
    coded, plain = entries.where("code is not null"), entries.where("code is null")
    agree = F.col("scope").isNull() | F.col("q_scope").isNull() | (F.col("scope") == F.col("q_scope"))
    pairs = coded.join(q, F.col("code") == F.col("q_code")).unionByName(plain.join(q, (F.col("number") == F.col("q_number")) & agree))
    found = pairs.groupBy("entry").agg(F.count("*").alias("n"), F.min("question").alias("question"), F.min("answer").alias("answer"))
    joined = entries.select("entry", "value").join(found, "entry", "left")
    other = F.col("answer").isNotNull() & (F.col("answer") != F.col("value"))
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").when(other, "conflict").otherwise("matched")
    return joined.select("entry", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("question")).alias("question"))


def target_conflicts(matches: DataFrame, target: str, value: str) -> DataFrame:
    """Targets that several entries hit: conflict if their values differ, else ambiguous."""
    found = matches.groupBy(target).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).where("n > 1")
    return found.select(target, "n", F.when(F.col("low") != F.col("high"), "conflict").otherwise("ambiguous").alias("status"))


def revision(*columns: Column) -> Column:
    """Digest of a row, the token of optimistic updates."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def compare_and_swap(current: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``updates``: key, expected revision, new values.  Applies those whose revision still holds; adds applied."""
    rev = revision(*[F.col(c).cast("string") for c in columns])
    new = updates.select(F.col(key).alias("__k"), F.col("expected").alias("__e"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = current.join(new, current[key] == new["__k"], "left")
    applies = F.coalesce(rev == F.col("__e"), F.lit(False))
    return joined.select(key, *[F.when(applies, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns], applies.alias("applied"))


def three_way(base: Column, current: Column, incoming: Column) -> tuple[Column, Column]:
    """Merged value and conflict flag: a change on one side wins, changes on both conflict unless equal."""
    mine, theirs = ~current.eqNullSafe(base), ~current.eqNullSafe(incoming)
    conflict = mine & theirs & ~incoming.eqNullSafe(base)
    return F.when(mine, current).otherwise(incoming), conflict
