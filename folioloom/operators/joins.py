"""Joins that are no plain equi-joins: ranges, overlaps, nearest rows, rules, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rule tables up to this many rows are sent to every task; larger ones are joined as they are.
RULES_MOST = 10_000


def _cells(low, high, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, width: int) -> DataFrame:
    """Every point with each range [low, high] of its group that covers it.

    Ranges are laid into cells of ``width``, so the join is an equi-join on group and cell;
    a point lies in one cell and meets a range there once.
    """
    cut = ranges.where(F.col(low) <= F.col(high)).withColumn("__cell", _cells(low, high, width))
    located = points.withColumn("__cell", F.floor(F.col(at) / width))
    return located.join(cut, [*keys, "__cell"]).where(F.col(at).between(F.col(low), F.col(high))).drop("__cell")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], low: tuple[str, str], high: tuple[str, str], width: int) -> DataFrame:
    """Pairs of a group whose closed intervals meet; a pair comes from the cell of its later start only."""
    a = left.where(F.col(low[0]) <= F.col(high[0])).withColumn("__cell", _cells(low[0], high[0], width))
    b = right.where(F.col(low[1]) <= F.col(high[1])).withColumn("__cell", _cells(low[1], high[1], width))
    start = F.greatest(low[0], low[1])
    meet = (start <= F.least(high[0], high[1])) & (F.col("__cell") == F.floor(start / width))
    return a.join(b, [*keys, "__cell"]).where(meet).drop("__cell")


def nearest(facts: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str) -> DataFrame:
    """Each fact with the nearest mark of its group, earlier ones and then smaller ids on ties.

    One union and two running values; no pairs are made.  ``marks``: keys, at, mark.
    """
    kind = marks.schema[mark].dataType
    found = F.struct(F.col(at).alias("t"), F.col(mark).alias("m"))
    rows = facts.withColumn("__m", F.lit(None).cast(f"struct<t:{marks.schema[at].dataType.simpleString()},m:{kind.simpleString()}>"))
    spots = marks.groupBy(*keys, at).agg(F.min(mark).alias(mark)).withColumn("__m", found).drop(mark)
    both = rows.withColumn("__fact", F.lit(1)).unionByName(spots.withColumn("__fact", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(at, "__fact").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc(at), "__fact").rowsBetween(Window.unboundedPreceding, 0)  # a running value, from the end
    both = both.withColumn("__a", F.last("__m", True).over(before)).withColumn("__b", F.last("__m", True).over(after)).where("__fact = 1")
    back, ahead = F.col(at) - F.col("__a.t"), F.col("__b.t") - F.col(at)
    best = F.when(F.col("__b").isNull() | (back <= ahead), F.col("__a.m")).otherwise(F.col("__b.m"))
    return both.select(*facts.columns, best.alias(mark))


def exactly_one(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with a single candidate, and that candidate."""
    return df.groupBy(key).agg(F.count("*").alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def scope_sizes(wanted: DataFrame, catalogue: DataFrame, wanted_key: str, key: str, row: str) -> DataFrame:
    """Scope of each question in the catalogue: its own rows, or all of them if it has none.

    Adds scope (own, full), n_rows and first_row.  The catalogue is aggregated before it is joined.
    """
    own = catalogue.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.min(row).alias("__first"))
    full = own.agg(F.sum("__n").alias("__all_n"), F.min("__first").alias("__all_first"))
    joined = wanted.join(own, F.col(wanted_key) == F.col("__key"), "left").join(F.broadcast(full), F.lit(True), "left")
    picked = [F.when(F.col("__key").isNull(), "full").otherwise("own").alias("scope"), F.coalesce("__n", "__all_n").alias("n_rows"), F.coalesce("__first", "__all_first").alias("first_row")]
    return joined.select(*wanted.columns, *picked)


def rule_candidates(questions: DataFrame, text: str, rules: DataFrame, catalogue: DataFrame, statement: str, most: int | None = None) -> DataFrame:
    """Candidates by rules.  ``rules``: rule, test, area, statements (patterns over question and statement), preferred.

    A rule's catalogue rows are found once, so patterns over statements are not tried again for each question;
    a candidate has rank 2 if any rule that names it prefers it, else 1.  ``catalogue``: area, code, statement.
    With ``most`` only the first codes of each rule go on: a rule gives all its codes one rank, so no
    other can be among the ``most`` best of a question by it.
    """
    if rules.limit(RULES_MOST + 1).count() <= RULES_MOST:
        rules = F.broadcast(rules)
    rows = catalogue.join(rules, "area").where(F.rlike(F.col(statement), F.col("statements"))).select("rule", "code", F.when(F.col("preferred"), 2).otherwise(1).alias("__rank"))
    if most is not None:
        of_rule = Window.partitionBy("rule").orderBy("code")
        rows = rows.distinct().withColumn("__pos", F.row_number().over(of_rule)).where(F.col("__pos") <= most).drop("__pos")
    fired = questions.join(rules.select("rule", "test"), F.rlike(F.col(text), F.col("test"))).select("q", "rule")
    return fired.join(rows, "rule").groupBy("q", "code").agg(F.max("__rank").alias("rank"))


def top_candidates(found: DataFrame, most: int = 6) -> DataFrame:
    """The best candidates of each question: rank falling, code rising."""
    order = Window.partitionBy("q").orderBy(F.desc("rank"), "code")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most)
