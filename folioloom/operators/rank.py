"""Catalogue ranking: token overlap, best subject, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_scores(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``questions``: q, tokens; ``catalogue``: pos, tokens.  Rows q, pos, score for pairs with a shared token.

    Score: 5 for each shared token plus its length up to 6.  The join is on the
    token; its catalogue side goes to every task only while it is small enough.
    """
    left = questions.select("q", F.explode("tokens").alias("token"))
    right = catalogue.select("pos", F.explode("tokens").alias("token"))
    return left.join(right, "token").groupBy("q", "pos").agg(F.sum(5 + F.least(F.length("token"), F.lit(6))).cast("bigint").alias("score"))


def confidence(score: Column) -> Column:
    return F.when(score <= 0, 35).otherwise(F.least(F.lit(96), 48 + 2 * score)).cast("bigint")


def rank_catalogue(questions: DataFrame, catalogue: DataFrame, top: int = 6) -> DataFrame:
    """The ``top`` catalogue rows of each question by score, ties in catalogue order.

    Rows that share nothing score 0 and fill up in catalogue order: only the first
    ``top`` positions can be needed for that, so no full product is formed.
    """
    scored = overlap_scores(questions, catalogue)
    first = catalogue.select("pos").orderBy("pos").limit(top)
    filler = questions.select("q").join(F.broadcast(first.agg(F.collect_list("pos").alias("p"))), F.lit(True)).select("q", F.explode("p").alias("pos"), F.lit(0).cast("bigint").alias("score"))
    both = scored.unionByName(filler).groupBy("q", "pos").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "pos")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.withColumn("confidence", confidence(F.col("score")))


def best_by(df: DataFrame, keys: list[str], value: str, carried: str) -> DataFrame:
    """Largest value of each group with a carried column; ties go to the smallest carried value."""
    order = F.struct(F.col(value), F.negative(F.col(carried)))
    return df.groupBy(*keys).agg(F.max(value).alias(f"best_{value}"), F.max_by(carried, order).alias(f"best_{carried}"))
