"""Operator 2: a ledger of quality rules as failure bits.

Every rule is evaluated once per document; the ledger keeps the measurements
and one bit per failed rule.  A policy is a mask over those bits, so a new
version or an ablation is a bitwise expression on the ledger and never reads
the texts again.

Words are runs of characters other than space and 0x09-0x0D; lines end at
``\\n``.  Null text counts as no words.  Rows are judged one by one: repeated
rows get equal verdicts, an empty table gives an empty ledger, and other
columns are not read (``filter_documents`` passes all of them through as they are).

``ledger`` keeps the books of a table by id; ``with_ledger`` keeps them beside the
document's own columns, in one pass and without a shuffle, for filtering.  ``filter_documents``
stores the latter and filters by its failure bits alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm.store import Workspace
from folioloom.llm.text import raw_texts, slices

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper_words", "n_same_next", "n_bar_words", "n_alpha_words", "n_long_words",
)

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Bit ``bit`` of the ledger is set where ``fails`` (SQL over the measures) holds."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a changed rule gets a new bit, so old ledgers stay readable.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols_per_word", "10 * n_symbols > 4 * n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "shouting", "10 * n_upper_words > 3 * n_alpha_words"),
    Rule(5, "stuttering", "10 * n_same_next > 2 * n_words"),
    Rule(6, "table_bars", "10 * n_bar_words > n_words"),
    Rule(7, "few_letters", "10 * n_alpha_words < 6 * n_words"),
    Rule(8, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(9, "unbroken_runs", "20 * n_long_words > n_words"),
)
BASE = ("too_few_words", "repeated_windows")
POLICIES = {
    "base-v1": BASE,
    "standard-v1": tuple(r.name for r in RULES),
}
_BIT = {r.name: r.bit for r in RULES}


def mask(names) -> int:
    return sum(1 << _BIT[n] for n in names)


_LONG = 50


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0, 0, 0)
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    repeated = same = 0
    distinct: dict[bytes, int] = {}
    number = distinct.setdefault
    ids = np.fromiter((number(w, len(distinct)) for w in words), np.int64, n)
    if n > 1:
        same = int((ids[1:] == ids[:-1]).sum())
    if n > 3 and len(distinct) < n:
        ids32, k = ids, len(distinct)
        if k < 2_000_000:
            windows = (ids32[:-2] * k + ids32[1:-1]) * k + ids32[2:]
        else:  # the product would overflow
            pairs = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1]
            windows = pairs.ravel()
        order = np.argsort(windows, kind="stable")
        ordered = windows[order]
        equal = ordered[1:] == ordered[:-1]
        if equal.any():
            hit = np.zeros(n - 2, bool)
            hit[order[1:][equal]] = True
            hit[order[:-1][equal]] = True
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[j : n - 2 + j] |= hit
            repeated = int(covered.sum())
    upper = alpha = bars = long = 0
    counts = np.bincount(ids)
    for w, c in zip(distinct, counts.tolist(), strict=True):
        if w.isalpha() or not w.isascii():
            alpha += c
        elif w == b"|":
            bars += c
        elif any(65 <= x <= 90 or 97 <= x <= 122 for x in w):
            alpha += c
        if w[1:] and w.isupper():
            upper += c
        if len(w) > _LONG and len(w.decode()) > _LONG:
            long += c
    return (
        n,
        len(joined.decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        upper,
        same,
        bars,
        alpha,
        long,
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, every measure, ``failed`` (bitmask of the rules it fails)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            table = np.array([measure(t) for t in raw_texts(batch.column(1))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(len(MEASURES)))], ["id", *MEASURES])

    measured = source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return measured.withColumn("failed", failed_bits()).withColumnRenamed("id", id_col)


def failed_bits() -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def passes(policy: str, failed: str = "failed") -> Column:
    """True where a ledger row satisfies every rule of the policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(book: DataFrame, policy: str = "standard-v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be kept without it.

    Equal masks are counted first, so at most 2**rules rows go on.
    """
    m = mask(POLICIES[policy])
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << _BIT[n]).cast("bigint").alias("bit")) for n in POLICIES[policy]]))
    rows = masks.select("failed", "n", rules.alias("r")).select("failed", "n", "r.rule", "r.bit")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed") == F.col("bit")
    kept = F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return rows.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def with_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with its columns by position (c0, c1, ...; names may clash), the measures and ``failed``."""
    at = docs.columns.index(text_col)
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}"):
            table = np.array([measure(t) for t in raw_texts(batch.column(at).cast(pa.string()))], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(table[:, k]) for k in range(len(MEASURES)))], [*batch.schema.names, *MEASURES])

    return rows.mapInArrow(run, f"{kept}, " + ", ".join(f"{m} bigint" for m in MEASURES)).withColumn("failed", failed_bits())


def filter_documents(docs: DataFrame, policy: str = "standard-v1", text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, all columns as they came; by the stored ledger, no shuffle."""
    book = Workspace(docs.sparkSession, "ledger").table(with_ledger(docs, text_col), "book")
    return book.where(passes(policy)).select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def op2_rules(spark, sf_dir: str) -> DataFrame:
    """Ledger of ``documents`` under the policy standard-v1; contract columns first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base-v1")).alias("base_failed"), passes("standard-v1").alias("kept"), F.col("failed").alias("failed_mask"),
    )


def rule_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of standard-v1 does to ``documents``, by bitwise aggregation over the ledger's masks."""
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_BOOK_SQL = r"""
with texts as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (
  select r, unnest(ws) as w, unnest(range(len(ws))) as i
  from (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from texts)),
following as (select *, lead(w, 1) over o as w1, lead(w, 2) over o as w2 from words window o as (partition by r order by i)),
windows as (select *, w2 is not null and count(*) over (partition by r, w, w1, w2) > 1 as again from following),
covered as (select *, again or coalesce(lag(again, 1) over o, false) or coalesce(lag(again, 2) over o, false) as hit from windows window o as (partition by r order by i)),
by_word as (
  select r, count(*) as n_words, sum(length(w)) as word_chars, count_if(hit) as n_repeat_words, count_if(w1 = w) as n_same_next, count_if(w = '|') as n_bar_words,
         count_if(regexp_matches(w, '[A-Z]') and not regexp_matches(w, '[a-z]') and octet_length(encode(w)) > 1) as n_upper_words,
         count_if(regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) as n_alpha_words, count_if(length(w) > 50) as n_long_words
  from covered group by r),
by_line as (
  select r, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls, doc_id from texts),
measured as (
  select doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines, coalesce(n_upper_words, 0) as n_upper_words, coalesce(n_same_next, 0) as n_same_next,
         coalesce(n_bar_words, 0) as n_bar_words, coalesce(n_alpha_words, 0) as n_alpha_words, coalesce(n_long_words, 0) as n_long_words
  from by_line left join by_word using (r)),
book as (
  select *, cast(""" + " + ".join(f"case when {r.fails} then {1 << r.bit} else 0 end" for r in RULES) + r""" as bigint) as failed from measured)
"""

OP2_SQL = _BOOK_SQL + f"""
select doc_id, n_words, word_chars, cast(n_symbols as bigint) as n_symbols, n_dup_lines, n_repeat_words,
       failed & {mask(POLICIES["base-v1"])} <> 0 as base_failed, failed & {mask(POLICIES["standard-v1"])} = 0 as kept, failed as failed_mask from book
"""

ABLATION_SQL = _BOOK_SQL + f"""
, rules as (select * from (values {", ".join(f"('{n}', {1 << _BIT[n]})" for n in POLICIES["standard-v1"])}) t(rule, bit))
select rule, count_if(failed & bit <> 0) as n_failed, count_if(failed = bit) as n_only, count_if(failed & ~bit = 0) as n_kept_without
from (select failed & {mask(POLICIES["standard-v1"])} as failed from book) cross join rules group by rule
"""
