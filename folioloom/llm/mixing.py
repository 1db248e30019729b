"""Operator 4: temperature mixing of sources.

The token share p of a source becomes a weight p**a, normalised.  The exponent
a in [0, 1] is bisected: the flattest mix that meets the target entropy, then
raised until no source is repeated more than ``max_repeats`` times.  Without a
budget the mix is as large as it must be for every document to occur at least
once.  A source's weight times the budget gives its epochs: whole passes, then a
part of one.  Documents are dealt to blocks by hash, and in each epoch the source's
blocks come in a permutation of that epoch (``__rank``), in a block documents in hash
order (``__place``).  A partial epoch takes blocks in its own order, and in the block where
the budget ends documents in hash order, until the tokens are spent (the document
that crosses the budget is the last one taken).

Tokens are those of the vocabulary file, counted as in operator 7.
Null source is a source of its own.  Sources without tokens, and empty texts,
come once per epoch begun.  Repeated rows are documents of their own, but equal ids
share a block and a place in it, so they come together.  Null ids are one id.
An empty table gives an empty mix.  Other columns pass through, whatever their names but ``__epoch``,
``__block``, ``__rank`` and ``__place``, which the result adds.  Texts of any length count whole.

Scale: block sums come from partial aggregates.  There are about as many blocks as documents
in one (the square root of their number), so the running sums, over the blocks of a
source and over the documents of one block of it, both stay far below a task's room.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.encode import encoder
from folioloom.llm.store import Workspace
from folioloom.llm.text import slices

VOCAB, SEED, MAX_REPEATS, LEAST_BLOCKS = "word_bpe_49k.json", 7, 1.5, 64


@dataclass(frozen=True)
class Mix:
    """What to aim at.  ``entropy`` is a share of the largest possible, log(number of sources)."""

    entropy: float | None = None
    max_repeats: float = MAX_REPEATS
    budget: int | None = None


def _source_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def _hash(source: Column, ident: Column) -> Column:
    return F.xxhash64(source, ident, F.lit(SEED))


def _place(h: Column, n_blocks: int) -> tuple[Column, Column]:
    """Block and place in it of a document."""
    return F.pmod(h, F.lit(n_blocks)), F.xxhash64(h)


def block_count(n_docs: int) -> int:
    """The power of two at the square root of the number of documents."""
    return max(LEAST_BLOCKS, 1 << (max(1, n_docs).bit_length() + 1) // 2)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocab: str = VOCAB) -> DataFrame:
    """src, h, n_tokens of every row."""
    source = docs.select(F.col(id_col).alias("id"), _source_key(source_col).alias("src"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in slices(batches):
            n = np.fromiter((enc.count(t) if t else 0 for t in batch.column(2).to_pylist()), np.int64, batch.num_rows)
            enc.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["id", "src", "n_tokens"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, src string, n_tokens bigint").select("src", _hash(F.col("src"), F.col("id")).alias("h"), "n_tokens")


def _bisect(totals: DataFrame, mix: Mix) -> tuple[float, float, float]:
    """Exponent, sum of the weights before normalisation, and budget.

    Each pass tests 65 exponents in one aggregate and keeps the interval where the answer lies.
    """
    base = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count("*").alias("n")).first()
    if not base["all"]:
        return 1.0, 1.0, 0.0
    everything = float(base["all"])

    def at(exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent: z = sum p**a and the entropy of p**a / z."""
        p = F.col("tokens") / F.lit(everything)
        grid = F.array(*[F.struct(F.lit(k).alias("k"), F.pow(p, F.lit(a)).alias("w"), (F.pow(p, F.lit(a)) * F.log(p) * a).alias("wl")) for k, a in enumerate(exponents)])
        rows = totals.select(F.explode(grid).alias("g")).groupBy("g.k").agg(F.sum("g.w").alias("z"), F.sum("g.wl").alias("t")).collect()
        return [(r.z, math.log(r.z) - r.t / r.z) for r in sorted(rows)]

    def fits(a: float, z: float, entropy: float, need_entropy: bool) -> bool:
        if need_entropy:
            return entropy >= mix.entropy * math.log(base["n"]) - 1e-12
        p_most, p_least = base["most"] / everything, base["least"] / everything
        budget = mix.budget or everything * z * p_most ** (1 - a)
        return p_least ** (a - 1) / z * budget / everything <= mix.max_repeats * (1 + 1e-12)

    def search(low: float, high: float, need_entropy: bool) -> float:
        """The largest exponent with enough entropy, or the smallest without too many repeats."""
        for _ in range(4):
            grid = [low + (high - low) * k / 64 for k in range(65)]
            good = [fits(a, *v, need_entropy) for a, v in zip(grid, at(grid), strict=True)]
            if need_entropy:
                k = max((i for i, g in enumerate(good) if g), default=0)
                low, high = grid[k], grid[min(k + 1, 64)]
            else:
                k = min((i for i, g in enumerate(good) if g), default=64)
                low, high = grid[max(k - 1, 0)], grid[k]
        return low if need_entropy else high

    a = search(0.0, 1.0, True) if mix.entropy is not None else 0.0
    a = search(a, 1.0, False)
    z = at([a])[0][0]
    return a, z, float(mix.budget or everything * z * (base["most"] / everything) ** (1 - a))


def plan(rows: DataFrame, mix: Mix, space: Workspace) -> tuple[DataFrame, int]:
    """``rows``: as of ``sizes``.  For each block and epoch in which it comes: src, block, epoch, rank, cut (places up to it come); and the number of blocks."""
    rows = space.table(rows, "sizes")
    n_blocks = block_count(rows.count())
    block, place = _place(F.col("h"), n_blocks)
    rows = rows.select("src", block.alias("block"), place.alias("place"), "n_tokens")
    blocks = space.table(rows.groupBy("src", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    totals = space.table(blocks.groupBy("src").agg(F.sum("tokens").alias("tokens")).coalesce(1), "totals")  # a row per source
    a, z, budget = _bisect(totals.where("tokens > 0"), mix)
    everything = F.lit(float(totals.agg(F.sum("tokens")).first()[0] or 1))
    weight = F.pow(F.col("tokens") / everything, F.lit(a)) / F.lit(z)
    epochs = F.when(F.col("tokens") > 0, weight * F.lit(budget) / F.col("tokens")).otherwise(F.lit(1.0))
    totals = totals.select("src", F.round(epochs, 9).alias("epochs"), F.col("tokens").alias("all_tokens"))
    totals = totals.withColumn("whole", F.floor("epochs").cast("int")).withColumn("rest", F.round((F.col("epochs") - F.col("whole")) * F.col("all_tokens")))

    def order(epoch: str) -> Column:
        return F.xxhash64("src", "block", epoch, F.lit(SEED))

    last = blocks.join(totals, "src").withColumn("epoch", F.col("whole") + 1)
    in_order = Window.partitionBy("src").orderBy(order("epoch"), "block")
    last = last.withColumn("before", F.sum("tokens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    edge = last.where("before < rest and before + tokens > rest").select("src", "block", (F.col("rest") - F.col("before")).alias("room"))
    by_place = Window.partitionBy("src", "block").orderBy("place")  # one block of each source
    taken = rows.groupBy("src", "block", "place").agg(F.sum("n_tokens").alias("n")).join(edge, ["src", "block"]).withColumn("before", F.sum("n").over(by_place) - F.col("n"))
    cuts = taken.where("before < room").groupBy("src", "block").agg(F.max("place").alias("edge_cut"))
    everywhere = F.lit((1 << 63) - 1)
    cut = F.when(F.col("edge_cut").isNotNull(), F.col("edge_cut")).when((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") <= F.col("rest")), everywhere)
    partial = last.join(cuts, ["src", "block"], "left").select("src", "block", "epoch", cut.alias("cut")).where("cut is not null")
    whole = last.where("whole > 0").select("src", "block", F.explode(F.sequence(F.lit(1), "whole")).alias("epoch"), everywhere.alias("cut"))
    of_epoch = Window.partitionBy("src", "epoch").orderBy(order("epoch"), "block")
    laid = whole.unionByName(partial).withColumn("rank", F.row_number().over(of_epoch))
    return space.table(laid, "plan"), n_blocks


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each copy of a document: its columns, then __epoch (from 1), __block, __rank (of the block in its source's epoch) and __place (in the block)."""
    laid, n_blocks = plan(sizes(docs, id_col, text_col, source_col), mix, Workspace(docs.sparkSession, "mixing"))
    own = [f"c{k}" for k in range(len(docs.columns))]  # positions, as names may clash
    source, ident = (f"c{docs.columns.index(c)}" for c in (source_col, id_col))
    block, place = _place(F.col("h"), n_blocks)
    keyed = docs.toDF(*own).withColumn("key", _source_key(source)).withColumn("h", _hash(F.col("key"), F.col(ident)))
    keyed = keyed.withColumn("b", block).withColumn("p", place)
    joined = keyed.join(laid, (F.col("key") == F.col("src")) & (F.col("b") == F.col("block"))).where("p <= cut")
    return joined.select(*own, "epoch", "b", "rank", "p").toDF(*docs.columns, "__epoch", "__block", "__rank", "__place")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mix; a source is read in the order of epoch, rank and place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "source", *[F.col(f"__{c}").alias(c) for c in ("epoch", "block", "rank", "place")])
