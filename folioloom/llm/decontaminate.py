"""Operator 9: benchmark decontamination by spaced-seed hashing.

Words are compared lower-cased and without punctuation at their ends; words of
punctuation alone do not count.  A seed is a fixed mask over successive words:
its ``0`` positions are ignored, so a substitution there does not change the
hash.  The three masks hit every 13-word window with up to two substituted
words; items of 5 to 12 words have masks of their own, by length, which lie over an
item with up to one (5 to 9 words) or two (10 to 12) substituted words, wherever
these are.  Of items of 1 to 4 words the 80 % rule lets no word differ, so their mask is
the whole item.  Hashes of the corpus that may occur in the benchmark are joined with the
benchmark's; around every hit the words of both sides are compared along the
diagonal, and a document is contaminated by an item where a window of 13 words
(or the whole item, if shorter) agrees in at least 80 % of its places.

Null and empty texts, and texts of punctuation alone, match nothing.  Equal items are searched
once, under their smallest id (``n_items`` tells how many they are).  Repeated rows and null ids of
documents are reported like others; other columns are not read.  ``drop_contaminated`` goes by the
text, so it removes contaminated rows without id as well and keeps a clean text whose id is repeated.

Scale: the corpus is read once and is never shuffled.  A filter over the benchmark's
hashes, sized by their number (at most 2**MOST_BITS bits), lets through few windows; a
benchmark that fills the largest filter makes the join larger, not wrong.  A document and
an item meet in one row however often their hashes do.  Of an item of 1 to 4 words only
the first place in a document goes on, so a frequent word costs one row a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.store import Workspace
from folioloom.llm.text import Memo, raw_texts, slices

#: Any window of WINDOW words with up to two substitutions holds one of these whole.
MASKS = ("11101111", "11010010111", "1101110011")
#: By length of a shorter item: whatever words the SHARE lets differ, one of these lies over it at some place that avoids them.
SHORT_MASKS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",),
    5: ("1111", "10111", "11011", "11101"), 6: ("10111", "11101"), 7: ("11011",), 8: ("10111",), 9: ("10111",),
    10: ("1111", "10111"), 11: ("10111",), 12: ("10111",),
}
WINDOW, SHARE, EXACT_WORDS = 13, 0.8, 4
FIRST_BITS, MOST_BITS = 20, 26
_ENDS = ".,;:!?\"'()[]{}<>*_`~#$%&|/\\-–—…«»“”‘’"


def _word_hash(word: bytes) -> int:
    """0 for a word of punctuation alone."""
    bare = word.decode().strip(_ENDS).lower()
    return (xxhash.xxh64_intdigest(bare) or 1) if bare else 0


@lru_cache(maxsize=1)
def _memo() -> Memo:
    return Memo(_word_hash, 150_000)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    h = np.fromiter(map(_memo().__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def _patterns(n_words: int) -> tuple[str, ...]:
    """The masks for an item of so many words."""
    return MASKS if n_words >= WINDOW else SHORT_MASKS[n_words]


def seed_hashes(h: np.ndarray, pattern: str, salt: str = "") -> np.ndarray:
    """The hash of the pattern's places at each start."""
    n = len(h) - len(pattern) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, xxhash.xxh64_intdigest(pattern + salt), np.uint64)
    for k, c in enumerate(pattern):
        if c == "1":
            out ^= h[k : k + n]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _items(benchmark: DataFrame, id_col: str, text_col: str, space: Workspace) -> DataFrame:
    """item_id (smallest of equal items), n_items, words (hashes, eight bytes each)."""
    source = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [word_hashes(t).astype("<u8").tobytes() for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["id", "words"])

    hashed = source.mapInArrow(run, f"id {kind}, words binary").where(F.length("words") > 0)
    return space.table(hashed.groupBy("words").agg(F.min("id").alias("item_id"), F.count("*").alias("n_items")), "items")


def _own_seeds(h: np.ndarray) -> np.ndarray:
    """All seed hashes of an item.  Those of whole short items are of a kind of their own."""
    return np.unique(np.concatenate([seed_hashes(h, p, _WHOLE if len(h) <= EXACT_WORDS else "") for p in _patterns(len(h))]))


_WHOLE = " whole"


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = _own_seeds(np.frombuffer(words, "<u8"))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array([item] * len(s), batch.column(1).type)], ["hash", "item_id"])


@dataclass(frozen=True)
class Filter:
    """Two sets of marks over the hashes: a small one that stays in the processor's cache, then one sized by the hashes."""

    small: np.ndarray
    bits: int
    words: np.ndarray

    def passed(self, s: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the set."""
        i = np.nonzero(self.small[(s & np.uint64((1 << FIRST_BITS) - 1)).astype(np.int64)])[0]
        at = s[i] >> np.uint64(64 - self.bits)
        return i[(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]


def _marked(slots: DataFrame, bits: int) -> np.ndarray:
    """A set of slots as 64-bit words; at most 2**(bits - 6) rows reach the driver."""
    rows = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _filter(seeds: DataFrame) -> Filter:
    bits = min(MOST_BITS, max(FIRST_BITS, (16 * seeds.count()).bit_length()))
    small = _marked(seeds.select(F.col("hash").bitwiseAND(F.lit((1 << FIRST_BITS) - 1)).alias("slot")), FIRST_BITS)
    large = _marked(seeds.select(F.shiftrightunsigned("hash", 64 - bits).alias("slot")), bits)
    return Filter(np.unpackbits(small.view(np.uint8), bitorder="little").astype(bool), bits, large)


def _hits(h: np.ndarray, patterns: list[str], known: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that the filter lets through, by position."""
    at, found = [], []
    for p in patterns:
        s = seed_hashes(h, p)
        i = known.passed(s)
        at.append(i)
        found.append(s[i])
    at, found = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    return at[order], found[order]


def _stretches(h: np.ndarray, patterns: list[str], whole: list[str], known: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Start and words of each stretch of a text that may hold an item, and the hashes met in it."""
    at, found = _hits(h, patterns, known)
    if len(at):
        reach = max(map(len, MASKS))
        cuts = np.nonzero(np.diff(at) > 2 * WINDOW + reach)[0] + 1
        for i, f in zip(np.split(at, cuts), np.split(found, cuts), strict=True):
            start = max(0, int(i[0]) - WINDOW)
            yield start, h[start : int(i[-1]) + reach + WINDOW], np.unique(f)
    for p in whole:
        s = seed_hashes(h, p, _WHOLE)
        i = known.passed(s)
        for k in i[np.unique(s[i], return_index=True)[1]].tolist():
            yield k, h[k : k + len(p)], s[k : k + 1]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_items, item_words, n_equal, n_compared, doc_pos.

    ``n_equal`` of ``n_compared`` words agree in the best window, which starts at the document's word ``doc_pos``.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "decontaminate")
    items = _items(benchmark, item_col, item_text, space)
    item_kind = items.schema["item_id"].dataType.simpleString()
    seeds = space.table(items.select("words", "item_id").mapInArrow(_seeds, f"hash bigint, item_id {item_kind}"), "seeds")
    marks = spark.sparkContext.broadcast(_filter(seeds))
    short = {int(r.n) for r in items.select(F.expr("length(words) div 8").alias("n")).where(f"n < {WINDOW}").distinct().collect()}
    whole = [SHORT_MASKS[n][0] for n in sorted(short) if n <= EXACT_WORDS]
    patterns = sorted({p for n in short if n > EXACT_WORDS for p in _patterns(n)}) + list(MASKS)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    doc_kind = source.schema["id"].dataType.simpleString()
    shape = pa.schema([("run_id", pa.int64()), ("start", pa.int32()), ("doc_words", pa.binary()), ("hash", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run_id, known = TaskContext.get().partitionId() << 40, marks.value
        for batch in slices(batches):
            rows, which = [], []
            for k, text in enumerate(raw_texts(batch.column(1))):
                for start, words, hashes in _stretches(word_hashes(text), patterns, whole, known):
                    rows.append({"run_id": run_id, "start": start, "doc_words": words.astype("<u8").tobytes(), "hash": hashes.view(np.int64).tolist()})
                    which.append(k)
                    run_id += 1
            _memo().trim()
            if rows:
                out = pa.RecordBatch.from_pylist(rows, shape)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *out.columns], ["id", *shape.names])

    runs = space.table(source.mapInArrow(scan, f"id {doc_kind}, run_id bigint, start int, doc_words binary, hash array<bigint>"), "runs")
    met = runs.select("run_id", F.explode("hash").alias("hash")).join(seeds, "hash").select("run_id", "item_id").distinct()
    pairs = met.join(runs.select("id", "run_id", "start", "doc_words"), "run_id").join(items, "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, equal, size, place = [], [], [], []
            starts, left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start", "doc_words", "words"))
            for start, a, b in zip(starts, left, right, strict=True):
                best, w, at = best_window(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"))
                good.append(best >= SHARE * w)
                equal.append(best)
                size.append(w)
                place.append(at + start)
            named = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "item_id", "n_items", "words")]
            named[3] = pc.divide(pc.binary_length(named[3]).cast(pa.int64()), 8)
            out = pa.RecordBatch.from_arrays([*named, *(pa.array(v, pa.int64()) for v in (equal, size, place))], ["id", "item_id", "n_items", "item_words", "n_equal", "n_compared", "doc_pos"])
            yield out.filter(pa.array(good, pa.bool_()))

    found = pairs.mapInArrow(verify, f"id {doc_kind}, item_id {item_kind}, n_items bigint, item_words bigint, n_equal bigint, n_compared bigint, doc_pos bigint")
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("n_equal", F.negative("doc_pos").alias("back"), "n_compared", "item_words", "n_items")).alias("m"))
    return best.select(F.col("id").alias("doc_id"), "item_id", "m.n_items", "m.item_words", "m.n_equal", "m.n_compared", F.negative("m.back").alias("doc_pos"))


def _shifts(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """By how much the item is moved along the document's words where a seed of both is equal, each shift once."""
    out = [np.zeros(0, np.int64)]
    for p in _patterns(len(item)):
        there, here = seed_hashes(doc, p), seed_hashes(item, p)
        order = np.argsort(here, kind="stable")
        low, high = np.searchsorted(here[order], there, "left"), np.searchsorted(here[order], there, "right")
        for k in range(int((high - low).max(initial=0))):  # once, but for repetitive items
            i = np.nonzero(high - low > k)[0]
            out.append(np.unique(i - order[low[i] + k]))
    return np.unique(np.concatenate(out))


def best_window(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Over all shifts: equal words of the best window, its size, its start in ``doc``; the first of equally good ones."""
    best = 0, min(WINDOW, len(item)), 0
    for shift in _shifts(doc, item).tolist():
        found = compare(doc, item, shift)
        if found[0] > best[0] or found[0] == best[0] and found[2] < best[2]:
            best = found
    return best


def compare(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Best window of the item laid over the document's words from ``shift``: equal words, window size, its start in ``doc``."""
    w = min(WINDOW, len(item))
    first, last = max(0, shift), min(len(doc), shift + len(item))
    if last - first < w:
        return 0, w, first
    equal = np.concatenate([[0], np.cumsum(doc[first:last] == item[first - shift : last - shift])])
    sums = equal[w:] - equal[:-w]
    k = int(sums.argmax())
    return int(sums[k]), w, first + k


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark passage, all columns as they came."""
    space = Workspace(docs.sparkSession, "decontaminated")
    digest = F.md5(F.col(text_col).cast("string").cast("binary"))
    bad = contaminated(docs.select(digest.alias("digest"), text_col), benchmark, "digest", text_col)
    bad = space.table(bad.select(F.col("doc_id").alias("__digest")).distinct(), "bad")
    return docs.join(bad, F.md5(docs[text_col].cast("string").cast("binary")) == bad["__digest"], "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
