"""The question bank: grouping, listing, selection, snapshots, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCLASSIFIED, UNCHECKED = "미분류", "분류 확인 필요"


def grouped(df: DataFrame, domain: str, code: str, ordinal: str, member: str) -> DataFrame:
    """Groups by (domain, code) with members in order; a blank code is unclassified."""
    blank = F.coalesce(F.trim(F.col(code)) == "", F.lit(True))
    rows = df.select(F.when(blank, UNCHECKED).otherwise(F.coalesce(domain, F.lit(""))).alias("domain"), F.when(blank, UNCLASSIFIED).otherwise(F.trim(F.col(code))).alias("code"), F.col(ordinal).alias("o"), F.col(member).cast("string").alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "m"))), lambda x: x["m"])
    return rows.groupBy("domain", "code").agg(F.count("*").alias("n"), F.array_join(listed, ",").alias("members"))


def first_of(df: DataFrame, key: str, ordinal: Column) -> DataFrame:
    """Distinct values in the order of their first row."""
    return df.groupBy(key).agg(F.min(ordinal).alias("first_seen"))


def search(df: DataFrame, query: str, columns: list[str], source: tuple[str, str] | None = None) -> DataFrame:
    """Rows whose columns hold the query, letter case aside, and optionally one source."""
    hay = F.lower(F.concat_ws(" ", *columns))
    found = df.where(F.contains(hay, F.lower(F.trim(F.lit(query)))))
    return found.where(F.col(source[0]) == source[1]) if source else found


def select_ordered(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``wanted``: pos, id.  Rows in the order asked for; ``found`` tells of missing ids."""
    have = df.withColumn("__found", F.lit(True))
    return wanted.join(have, wanted["id"] == have[key], "left").withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def last_snapshot(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key, whatever came before; a partial maximum, no window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, cap: float) -> DataFrame:
    """Adds total (running sum) and fits (total within the cap)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.round(F.sum(value).over(w), 4)).withColumn("fits", F.col("total") <= cap)


def numbered(df: DataFrame, ordinal: str, to: str) -> DataFrame:
    """Adds the dense number (from 1) of each row in the order of a column of distinct whole numbers.

    A prefix sum over ranges of the ordinal: each range numbers its own rows, so no task sees
    them all.  There are 4,096 ranges between the smallest and the largest value, whatever
    these are.
    """
    bounds = df.agg(F.min(ordinal).alias("__low"), F.max(ordinal).alias("__high"))
    spread = df.crossJoin(F.broadcast(bounds))  # one row
    ranges = F.floor((F.col(ordinal).cast("double") - F.col("__low")) / (F.col("__high").cast("double") - F.col("__low") + 1) * 4096)
    ranged = spread.withColumn("__r", ranges).drop("__low", "__high")
    base = ranged.groupBy("__r").agg(F.count("*").alias("__c"))
    base = base.select("__r", (F.sum("__c").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__r").orderBy(ordinal))
    return ranged.withColumn("__k", own).join(base, "__r").withColumn(to, F.col("__base") + F.col("__k")).drop("__r", "__k", "__base")


def payload_ids(df: DataFrame, payload: str, ordinal: str) -> DataFrame:
    """Dense id of each distinct payload in order of first appearance, with its first row and count."""
    raw = F.col(payload) if df.schema[payload].dataType.typeName() == "binary" else F.col(payload).cast("string").cast("binary")
    first = df.groupBy(F.sha2(raw, 256).alias("digest")).agg(F.min(ordinal).alias("first_row"), F.count("*").alias("n"))
    return numbered(first, "first_row", "image_id").select("digest", "first_row", "n", "image_id")
