"""Operator 10: near-duplicates by SimHash, joined in a grid of segment bit counts.

Fingerprints: A-Z lower-cased, words are runs of characters other than space and
0x09-0x0D, shingles are 3 consecutive words joined by spaces, repeats included
(fewer words: the whole sequence).  A bit is 1 if it is set in over half of the
shingles' XXH64 (seed 42).  A text without words (null, empty, blank) has
fingerprint zero and is linked like any other.

Links: fingerprints that differ in at most two bits.
* Every fingerprint is embedded as the bit counts of 32 segments of 2 bits.  The
  Manhattan distance of two embeddings is a lower bound of the Hamming distance.
* The 32 coordinates lie in 5 blocks.  Vectors within Manhattan distance 2 agree
  on at least 3 blocks, so both fall into one cell of at least one of the 10
  three-block grids: an equi-join on cells finds every pair in range.
* Candidates from a cell must pass the Manhattan bound, then the exact distance.
* A crowded cell (over ``cell_most`` fingerprints) is divided by the same rule: its
  two free blocks lie in 5 smaller ones, of which a pair in range agrees on at
  least 3, so the finer grid fixes 26 or more of the 32 coordinates.
* Where even a finer cell is crowded, its members are near copies that the embedding
  hardly tells apart.  There the exact check is made through common values: two
  fingerprints are at most two bits apart just if both are within one bit of a
  value, so each is linked to those of its 65 values that another member has,
  which costs 65 rows a member, not a row a pair.

Copies share a fingerprint and cost one row after a partial aggregation, so the
size of a group of copies does not matter.  Null ids are kept, but never name a
component unless all ids of it are null; repeated rows behave like copies.

With ``jaccard`` (the pipeline's stage), documents are linked as well if the sets
of their 5-word shingles are at least so similar.  Such pairs differ in about ten
bits, beyond any grid, so candidates come from MinHash bands: equal in one of
BANDS bands of ROWS minima (at similarity 0.8, all but 1 in 13,000 are), then a bound
that needs no sets (their parities differ in no more bits than the sets do in members),
then the exact similarity.  Every pair of a cell is a candidate that links found earlier
do not connect.  A cell of over NEAR_CELL_MOST sets is cut into blocks, and each two blocks
are compared in a place of their own: first members meet the cell's most central member and
one picked by hash, then each the first member of a block pair that size and parity admit,
at last all that these admit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm.components import connected_components
from folioloom.llm.store import Workspace
from folioloom.llm.text import raw_texts, slices

SHINGLE, MAX_BITS, CELL_MOST = 3, 2, 64
_BLOCKS = (7, 7, 6, 6, 6)  # segments in each block
NEAR_CELL_MOST, NEAR_BLOCK = 16, 512
NEAR_SHINGLE, BANDS, ROWS, SIEVE_BITS = 5, 24, 5, 28
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint as a signed integer."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    hash64, seed = xxhash.xxh64_intdigest, 42
    if n <= SHINGLE:
        h = hash64(b" ".join(words), seed)
        return h - (1 << 64) if h >> 63 else h
    joined = b" ".join(words)
    ends = list(np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1)
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.fromiter((hash64(joined[a:b], seed) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long) of every document."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([fingerprint(t) for t in raw_texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    return source.mapInArrow(run, f"id {kind}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_LOW, _HIGH = 0x5555555555555555, _signed(0xAAAAAAAAAAAAAAAA)


def embed(fp: Column) -> Column:
    """Bit counts of the 2-bit segments, each written as 00, 01 or 11: Manhattan distance is the bit count of an XOR."""
    low = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(_LOW))
    high = fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(F.lit(_HIGH))
    return low.bitwiseOR(high)


def _masks(sizes: list[int], places: list[int]) -> list[int]:
    """Blocks of so many of the segments at ``places``, as masks over the embedding."""
    left = iter(places)
    return [sum(3 << 2 * next(left) for _ in range(n)) for n in sizes]


def _grids() -> list[tuple[int, list[int]]]:
    """For each grid the mask of its three blocks and the masks of the finer grids within it."""
    out, n, blocks = [], len(_BLOCKS), _masks(list(_BLOCKS), list(range(32)))
    for fixed in combinations(range(n), n - MAX_BITS):
        mask = sum(blocks[k] for k in fixed)
        free = [k for k in range(32) if not mask >> 2 * k & 1]
        parts = _masks([len(free) // n + (k < len(free) % n) for k in range(n)], free)
        out.append((_signed(mask), [_signed(mask + sum(c)) for c in combinations(parts, n - MAX_BITS)]))
    return out


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell that pass the Manhattan bound and then the exact distance."""
    for batch in batches:
        a, b = [], []
        lists = batch.column(0)
        flat, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            x = flat[s:e]
            low = (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)
            t = low | x & (x << np.uint64(1)) & np.uint64(0xAAAAAAAAAAAAAAAA)
            i, j = np.triu_indices(len(x), 1)
            near = np.bitwise_count(t[i] ^ t[j]) <= MAX_BITS
            i, j = i[near], j[near]
            near = np.bitwise_count(x[i] ^ x[j]) <= MAX_BITS
            a.append(x[i[near]])
            b.append(x[j[near]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])


def _divided(cells: DataFrame, space: Workspace, name: str, cell_most: int) -> tuple[DataFrame, DataFrame]:
    """``cells``: fp, mask, cell.  Close pairs of the cells that are not crowded, and the members fp, mask of those that are."""
    shared = space.table(cells.groupBy("mask", "cell").agg(F.count("*").alias("n")).where("n > 1"), name)
    members = cells.join(shared, ["mask", "cell"])
    small = members.where(F.col("n") <= cell_most).groupBy("mask", "cell").agg(F.collect_list("fp").alias("fps"))
    return small.select("fps").mapInArrow(_close_pairs, "a bigint, b bigint"), members.where(F.col("n") > cell_most).select("fp", "mask")


def _in_cells(rows: DataFrame, masks: Column) -> DataFrame:
    """fp, mask, cell of each row's masks, each once."""
    return rows.select("fp", F.explode(masks).alias("mask")).distinct().select("fp", "mask", embed(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell"))


def links(fps: DataFrame, space: Workspace, cell_most: int = CELL_MOST) -> DataFrame:
    """``fps``: distinct fp.  Links a, b that hold every pair within MAX_BITS together (pairs that the finest cells crowd through common values)."""
    grids = _grids()
    cells = fps.select("fp", F.explode(F.array(*[F.lit(m) for m, _ in grids])).alias("mask"))
    cells = cells.select("fp", "mask", embed(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell"))
    pairs, crowded = _divided(cells, space, "cells", cell_most)
    finer = F.element_at(F.create_map(*[x for m, inner in grids for x in (F.lit(m), F.array(*map(F.lit, inner)))]), F.col("mask"))
    close, crowd = _divided(_in_cells(crowded, finer), space, "finer", cell_most)
    values = F.concat(F.array("fp"), F.transform(F.array(*[F.lit(_signed(1 << k)) for k in range(64)]), lambda bit: F.col("fp").bitwiseXOR(bit)))
    # at most 65 values lie within one bit of any value, so these lists are short
    common = crowd.select("fp").distinct().select("fp", F.explode(values).alias("value")).groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = common.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(close).unionByName(stars).distinct()


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles (fewer words: the whole sequence)."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    k = min(n, NEAR_SHINGLE)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out ^= h[j : n - k + 1 + j]
        out *= _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


_RANDOM = np.random.default_rng(10).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of minima over the set, which must not be empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[k : k + 2048, None] ^ _RANDOM[0]) * _RANDOM[1]).min(0), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def parity(shingles: np.ndarray) -> bytes:
    """Bit i tells whether the number of members with hash i is odd; there is a power of two of bits, one for each member or more."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) & bits - 1, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """At least so many members are in just one of the sets with these parities."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ folded).sum())


def _hopeful(pairs: DataFrame, jaccard: float) -> DataFrame:
    """``pairs``: a, b with a_n, b_n, a_parity, b_parity.  Those a, b that the parities do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [least_difference(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            members = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            # sets of Jaccard j differ in (1 - j) / (1 + j) of their members, both sets' counted
            near = np.array(apart, np.float64) * (1 + jaccard) <= members * (1 - jaccard) + 1e-6
            yield batch.select([0, 1]).filter(pa.array(near))

    return pairs.select("a", "b", "a_n", "b_n", "a_parity", "b_parity").mapInArrow(run, "a bigint, b bigint")


def _tag(ident: str, text: str) -> Column:
    """What names a row in filters; copies have names of their own, so that one of them can stand for all."""
    return F.xxhash64(F.col(ident), F.col(text).cast("string"))


def _signature(shingles: np.ndarray) -> int | None:
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes())) if len(shingles) else None


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag, fp, and of texts with words: sig (of the shingle set), n (its size), bands, parity."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _tag(id_col, text_col).alias("tag"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = raw_texts(batch.column(1))
            sets = [shingle_set(t) for t in texts]
            fps = pa.array([fingerprint(t) for t in texts], pa.int64())
            sigs, sizes = pa.array(map(_signature, sets), pa.int64()), pa.array(map(len, sets), pa.int64())
            bands = pa.array([band_keys(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
            parities = pa.array([parity(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps, sigs, sizes, bands, parities], ["id", "tag", "fp", "sig", "n", "bands", "parity"])

    return source.mapInArrow(run, f"id {kind}, tag bigint, fp bigint, sig bigint, n bigint, bands array<bigint>, parity binary")


def _meetings(cells: DataFrame, space: Workspace, name: str, cell_most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``cells``: sig, key.  Of every cell the pairs a, b of a member and its pivots; all other pairs of the cells that are not crowded; the members sig, key of the others."""
    shared = space.table(cells.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), f"{name}-shared")
    members = space.table(cells.join(shared, "key"), f"{name}-members")
    weight = members.groupBy("sig").agg(F.sum("size").alias("weight"))
    pivots = members.join(weight, "sig").groupBy("key").agg(F.max_by("sig", F.struct("weight", "sig")).alias("central"), F.min_by("sig", F.xxhash64("sig", "key")).alias("picked"))
    crowded = F.col("size") > cell_most
    stars = members.join(pivots, "key").select("sig", F.explode(F.when(crowded, F.array("central", "picked")).otherwise(F.array("central"))).alias("pivot")).where("sig <> pivot")
    small = members.where(~crowded).groupBy("key").agg(F.collect_list("sig").alias("sigs"))
    pairs = small.select("sigs", F.explode("sigs").alias("a")).select("a", F.explode("sigs").alias("b")).where("a < b")
    return stars.select(*_in_order("sig", "pivot")).distinct(), pairs, members.where(crowded).select("sig", "key")


def _in_order(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _blocks(crowd: DataFrame, labels: DataFrame, about: DataFrame, block: int) -> DataFrame:
    """``crowd``: sig, key.  key, i, j, block, sig, label, n, parity, sorted: any two members of a cell with different labels meet at one i, j.

    Members with the label that most of a cell have are in blocks of their own, which do not meet each other.
    """
    named = crowd.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    counts = named.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("mains"), F.sum("c").alias("size"))
    rows = named.join(counts.where("size > mains"), "key").join(about, "sig")
    main, parts, rest = F.col("label") == F.col("main"), F.ceil(F.col("mains") / block), F.ceil((F.col("size") - F.col("mains")) / block)
    at = F.pmod(F.xxhash64("sig", "key"), F.when(main, parts).otherwise(rest)) + F.when(main, rest).otherwise(0)
    rows = rows.withColumn("block", at).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(main, rest).otherwise(rest + parts) - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sig", "label", "n", "parity")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, i, j of sorted batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = (np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist()
        for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(place[:, s].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def admitted(rows: pa.Table, jaccard: float, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks (one, where i = j) with different labels that sizes and parities do not rule out; with ``first`` one pair at most for each second member."""
    n = rows.column("n").to_numpy()
    order = np.argsort(n, kind="stable")
    n, sig, label, block = (rows.column(c).to_numpy()[order] for c in ("n", "sig", "label", "block"))
    raw = rows.column("parity").to_pylist()
    parities = [np.frombuffer(raw[k], np.uint64) for k in order.tolist()]
    widths, ends = np.array([len(x) for x in parities]), np.searchsorted(jaccard * n, n, side="right")
    one, free = rows.column("i")[0].as_py() == rows.column("j")[0].as_py(), np.ones(len(n), bool)
    a, b = [sig[:0]], [sig[:0]]
    for width in np.unique(widths).tolist():
        s, e = np.searchsorted(widths, [width, width + 1]).tolist()
        folded = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in parities[s : ends[e - 1]]])
        for x in range(s, e):
            y = np.arange(x + 1, ends[x])
            y = y[(label[y] != label[x]) & (one | (block[y] != block[x])) & (free[y] | (not first))]
            apart = np.bitwise_count(folded[y - s] ^ folded[x - s]).sum(1, dtype=np.int64)
            y = y[apart * (1 + jaccard) <= (n[y] + n[x]) * (1 - jaccard) + 1e-6]
            free[y] = False
            a.append(np.minimum(sig[x], sig[y]))
            b.append(np.maximum(sig[x], sig[y]))
    return np.concatenate(a), np.concatenate(b)


def _admitted(crowd: DataFrame, labels: DataFrame, about: DataFrame, jaccard: float, block: int, first: bool) -> DataFrame:
    """Pairs a, b of the cells' members with different labels that sizes and parities do not rule out (``first``: some of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _places(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in admitted(rows, jaccard, first)], ["a", "b"])

    return _blocks(crowd, labels, about, block).mapInArrow(run, "a bigint, b bigint").distinct()


class Sieve:
    """Which 64-bit hashes are among those of a table: never no for one that is, seldom yes for another; of bounded size."""

    def __init__(self, hashes: DataFrame, name: str):
        bits = min(SIEVE_BITS, max(20, (64 * hashes.count()).bit_length()))
        slot = F.shiftrightunsigned(name, 64 - bits)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
        words = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        table = np.zeros(1 << bits - 6, np.uint64)
        table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        self.bits, self.table = bits, hashes.sparkSession.sparkContext.broadcast(table)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.table.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _needed_sets(docs: DataFrame, id_col: str, text_col: str, tags: DataFrame) -> DataFrame:
    """sig and shingles of the rows with these tags (and of few others), so that not every set is shuffled."""
    sieve = Sieve(tags, "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            inside = sieve.holds(batch.column(1).to_numpy())
            sets = [s for s in map(shingle_set, raw_texts(batch.filter(pa.array(inside)).column(0))) if len(s)]
            # a set goes on as the upper halves of its hashes, distinct ones
            halves = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(map(_signature, sets), pa.int64()), pa.array(halves, pa.list_(pa.int32()))], ["sig", "shingles"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), _tag(id_col, text_col).alias("tag"))
    return rows.mapInArrow(run, "sig bigint, shingles array<int>").groupBy("sig").agg(F.first("shingles").alias("shingles"))


def _similar(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """The pairs a, b whose sets are at least so similar."""
    left, right = (sets.select(F.col("sig").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size("a_set").alias("a_n"), F.size("b_set").alias("b_n"), F.size(F.array_intersect("a_set", "b_set")).alias("n"))
    return both.where(F.col("n") >= F.lit(jaccard) * (F.col("a_n") + F.col("b_n") - F.col("n"))).select("a", "b")


def near_links(docs: DataFrame, marked: DataFrame, space: Workspace, jaccard: float, id_col: str = "doc_id", text_col: str = "text", cell_most: int = NEAR_CELL_MOST, block: int = NEAR_BLOCK) -> DataFrame:
    """``marked``: as of ``marks`` for ``docs``.  Links a, b of fingerprints that connect all candidates at least ``jaccard`` similar.

    Pairs with a cell's pivot are checked first; another candidate only where these links do not connect its ends yet.
    """
    rows = marked.where("sig is not null")
    kinds = space.table(rows.select("sig", "fp").distinct(), "kinds")
    names = kinds.groupBy("sig").agg(F.min("fp").alias("name"))
    same = kinds.join(names, "sig").where("fp <> name").select(F.col("name").alias("a"), F.col("fp").alias("b"))
    nodes = space.table(rows.groupBy("sig").agg(F.first("bands").alias("bands"), F.first("parity").alias("parity"), F.first("n").alias("n"), F.min("tag").alias("tag")), "nodes")
    stars, pairs, crowd = _meetings(nodes.select("sig", F.explode(F.transform("bands", lambda key, k: F.xxhash64(key, k))).alias("key")), space, "bands", cell_most)
    about = [nodes.select(F.col("sig").alias(c), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_parity")) for c in "ab"]
    fits = F.least("a_n", "b_n") >= F.lit(jaccard) * F.greatest("a_n", "b_n")

    def hopeful(some: DataFrame) -> DataFrame:
        return _hopeful(some.join(about[0], "a").join(about[1], "b").where(fits), jaccard)

    def checked(some: DataFrame, name: str) -> DataFrame:
        needed = some.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        tags = space.table(nodes.join(needed, "sig", "left_semi").select("tag"), f"{name}-tags")
        return space.table(_similar(some, _needed_sets(docs, id_col, text_col, tags), jaccard), f"{name}-close")

    def in_crowds(labels: DataFrame, first: bool) -> DataFrame:
        return _admitted(crowd, labels, nodes.select("sig", "n", "parity"), jaccard, block, first)

    stars = space.table(hopeful(stars), "stars")
    pairs = space.table(hopeful(pairs.distinct()), "pairs")
    close = checked(stars, "stars")
    reached = connected_components(close, Workspace(docs.sparkSession, "simhash-near"))
    at = [reached.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab"]
    apart = ~F.coalesce(F.col("a_label") == F.col("b_label"), F.lit(False))
    left = pairs.join(at[0], "a", "left").join(at[1], "b", "left").where(apart).select("a", "b")
    left = space.table(left.unionByName(in_crowds(reached, True)).distinct().join(stars, ["a", "b"], "left_anti"), "left")
    close = close.unionByName(checked(left, "left"))
    reached = connected_components(close, Workspace(docs.sparkSession, "simhash-near"))
    rest = space.table(in_crowds(reached, False).join(stars.unionByName(left), ["a", "b"], "left_anti"), "rest")
    all_close = close.unionByName(checked(rest, "rest"))
    named = [names.select(F.col("sig").alias(c), F.col("name").alias(f"{c}_fp")) for c in "ab"]
    close_fps = all_close.join(named[0], "a").join(named[1], "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).where("a <> b")
    return same.unionByName(close_fps)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_most: int = CELL_MOST, jaccard: float | None = None, near_cell_most: int = NEAR_CELL_MOST) -> DataFrame:
    """id, fp, component_id (smallest id that links reach) of every document."""
    space = Workspace(docs.sparkSession, "simhash")
    marked = None if jaccard is None else space.table(marks(docs, id_col, text_col), "marks")
    fps = space.table(fingerprints(docs, id_col, text_col), "fps") if marked is None else space.table(marked.select("id", "fp"), "fps")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("first"))
    found = links(nodes.select("fp"), space, cell_most)
    if marked is not None:
        found = found.unionByName(near_links(docs, marked, space, jaccard, id_col, text_col, near_cell_most)).distinct()
    found = space.table(found, "links")
    if marked is not None:
        space.drop("marks", "kinds", "nodes", "bands-shared", "bands-members", "stars", "pairs", "left", "rest", "stars-tags", "stars-close", "left-tags", "left-close", "rest-tags", "rest-close")
    labels = connected_components(found, space)
    grouped = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    tops = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = space.table(grouped.join(tops, "label").select("fp", "component_id"), "components")
    return fps.join(of_fp, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None) -> DataFrame:
    """One row of each component; all columns as they came.

    It is the row with the smallest id, null ids last; of several rows with that id the
    one with the smallest hash of all its columns; of rows equal in all columns any.
    """
    space = Workspace(docs.sparkSession, "simhash-keep")
    at, text = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # positions, as names may clash
    ident = F.struct(F.col(f"c{at}").isNull().alias("none"), F.col(f"c{at}").alias("id"), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in rows.columns]).alias("row"))
    keyed = rows.withColumn("key", ident)
    groups = components(keyed.select("key", f"c{text}"), "key", f"c{text}", jaccard=jaccard)
    names = groups.groupBy("key").agg(F.min("component_id").alias("top"), F.count("*").alias("n"))
    names = space.table(names.where("key <> top or n > 1"), "keys")
    sieve = Sieve(names.select(F.xxhash64("key").alias("hash")), "hash")

    @F.arrow_udf("boolean")
    def named(hashes: pa.Array) -> pa.Array:
        return pa.array(sieve.holds(hashes.to_numpy()))

    # only rows that may be named are joined, so that the texts of all others are not shuffled
    keyed = keyed.withColumn("named", named(F.xxhash64("key")))
    free, keyed = keyed.where("not named").drop("named"), keyed.where("named").drop("named")
    gone = names.select(F.col("key").alias("other"))
    single = free.unionByName(keyed.join(gone, keyed["key"] == gone["other"], "left_anti"))
    several = names.where("key = top").select(F.col("key").alias("other"))  # equal rows that name a component
    one = keyed.join(several, keyed["key"] == several["other"], "left_semi").dropDuplicates(["key"])
    return single.unionByName(one).drop("key").toDF(*docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return components(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
