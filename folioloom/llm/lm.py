"""Operator 8: language-model scores from a class-factored log-bilinear neural model.

Tokens: A-Z lower-cased, runs of characters other than space and 0x09-0x0D, then
one end.  Word counts cover every training document and stay a distributed table.

Classes: the end; the most frequent words, 2 sqrt(V) of them (at most MOST_WORDS, as
every task holds the model), each a class of its own; and groups of all other words
by their last two characters, half as many, the rarest endings in one group.  So
each word of the vocabulary, and each unseen one, has a class that the context predicts.
Inside a group a word has its add-one share of the group's count, and one share is
left for unseen words, so the model sums to one over the vocabulary and the unseen.

Model: the two words before a token predict its class: the sum of their vectors,
each scaled by a vector of its place, times the class's vector, plus its bias.  The
CONTEXTS most frequent classes have context vectors of their own, others share one
by their last character.  Training is noise-contrastive, with the class counts as
noise, in ROUNDS synchronous rounds.  Each training document belongs to a block by the
hash of its key, and each block to a round; in a round every block trains from the
common parameters and the results are averaged, weighted by tokens.  Blocks hold about
BLOCK_TOKENS tokens, so their number grows with the corpus and the model does not depend on splits.

Scoring is normalised exactly.  As the score is a sum over the two places, the
normaliser of every pair of contexts is one entry of a product of two
matrices; a token's log-probability is then three table entries and its share.

Words outside the HEAD most frequent ones (a table of bounded size that goes to
all tasks) get their counts by a join on the word, so no part of the
vocabulary is dropped however large it grows.

Null and empty texts are one end token.  Repeated rows are scored each, and equally; null
ids are training rows.  With nothing to learn from, every base score is that of an unseen token.
A block holds equal rows (same id and text) together; copies under other ids lie in other blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm.quality import held_out
from folioloom.llm.store import Workspace
from folioloom.llm.text import raw_texts, slices

MOST_WORDS, HEAD, DIMENSIONS, NOISE, BATCH, RATE = 8192, 200_000, 16, 64, 512, 0.1
CONTEXTS, SHARED_CONTEXTS, ROUNDS, BLOCK_TOKENS = 1000, 24, 4, 1 << 18
OTHER, END, FIRST_WORD = 0, 1, 2  # classes
_FLUSH = 300_000


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c over all texts; tasks count before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def emit() -> Iterator[pa.RecordBatch]:
            keys, values = list(counts), list(counts.values())
            counts.clear()
            for k in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 50_000], pa.binary()), pa.array(values[k : k + 50_000], pa.int64())], ["word", "c"])

        for batch in slices(batches):
            for t in raw_texts(batch.column(0)):
                counts.update(t.lower().split())
            if len(counts) > _FLUSH:
                yield from emit()
        yield from emit()

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``, cut between two steps of a fixed logarithmic scale."""
    step = F.floor(F.log2("c") * 16).cast("int")
    histogram = sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True)  # at most 16 x 63 steps
    total, least = 0, None
    for r in histogram:
        total += r["count"]
        if total > most:
            break
        least = r["s"]
    if least is None:
        return []
    table = counts.where(step >= least).toArrow()
    return sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows: head words with counts, the classes, and the totals."""

    words: list[bytes]
    counts: np.ndarray
    shortlist: int
    endings: dict[str, int]  # ending -> class
    class_counts: np.ndarray  # tokens of each class
    class_types: np.ndarray  # words of each class
    contexts: np.ndarray  # class -> context
    docs: int  # training documents, the end's count
    tokens: int  # N
    types: int  # V

    def noise(self) -> np.ndarray:
        c = self.class_counts + 1
        return c / c.sum()

    def group_of(self, word: bytes) -> int:
        return self.endings.get(word.decode(errors="replace")[-2:], OTHER)

    def head_classes(self) -> np.ndarray:
        """The class of every head word."""
        groups = np.fromiter(map(self.group_of, self.words[self.shortlist :]), np.int64, len(self.words) - self.shortlist)
        return np.concatenate([np.arange(FIRST_WORD, FIRST_WORD + self.shortlist), groups])

    def log_share(self) -> np.ndarray:
        """log10 of what a group's counts are divided by; 0 for classes of one word."""
        out = np.log10(self.class_counts + self.class_types + 1)
        out[END : FIRST_WORD + self.shortlist] = 0
        return out


def _contexts_of(class_counts: np.ndarray, names: list[str]) -> np.ndarray:
    """A context for each class: its own for the most frequent, else one shared by last character; START is one more."""
    out = np.fromiter((CONTEXTS + sum(n[-1:].encode()) % SHARED_CONTEXTS for n in names), np.int64, len(names))
    own = np.argsort(-class_counts, kind="stable")[:CONTEXTS]
    out[own] = np.arange(len(own))
    return out


START, N_CONTEXTS = CONTEXTS + SHARED_CONTEXTS, CONTEXTS + SHARED_CONTEXTS + 1


def vocabulary_of(counts: DataFrame, docs: int) -> Vocabulary:
    """``counts``: word, c.  Only the head and the endings of bounded number reach the driver."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    head = head_of(counts)
    words, types = [w for w, _ in head], total["v"] + (docs > 0)
    shortlist = min(len(head), MOST_WORDS, math.ceil(2 * math.sqrt(types)))
    rest = counts.select(F.substring(F.col("word").cast("string"), -2, 2).alias("ending"), "c")
    most = max(64, shortlist // 2)
    groups = rest.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("c"), "ending").limit(most).collect()
    listed = Counter(), Counter()  # what the shortlist takes from its endings
    for w, c in head[:shortlist]:
        ending = w.decode(errors="replace")[-2:]
        listed[0][ending] += c
        listed[1][ending] += 1
    groups = [(r.ending, r.c - listed[0][r.ending], r.n - listed[1][r.ending]) for r in groups]
    groups = [g for g in groups if g[2] > 0]
    n_short = sum(c for _, c in head[:shortlist])
    all_words = int(total["n"] or 0)
    class_counts = np.array([all_words - n_short - sum(g[1] for g in groups), docs, *(c for _, c in head[:shortlist]), *(g[1] for g in groups)], np.float64)
    class_types = np.array([total["v"] - shortlist - sum(g[2] for g in groups), int(docs > 0), *[1] * shortlist, *(g[2] for g in groups)], np.float64)
    names = ["", "", *(w.decode(errors="replace") for w in words[:shortlist]), *(g[0] for g in groups)]
    endings = {g[0]: FIRST_WORD + shortlist + k for k, g in enumerate(groups)}
    return Vocabulary(words, np.array([c for _, c in head], np.int64), shortlist, endings, class_counts, class_types, _contexts_of(class_counts, names), docs, all_words + docs, types)


class _Places(dict):
    """Head word -> its place; other words -> their class, as -1 - class."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__((w, k) for k, w in enumerate(vocabulary.words))
        self.group_of = vocabulary.group_of

    def __missing__(self, word: bytes) -> int:
        return -1 - self.group_of(word)


@lru_cache(maxsize=1)
def _index(key: str, vocabulary) -> tuple[_Places, np.ndarray]:
    """Places of words and classes of head words; one per worker and model."""
    return _Places(vocabulary.value), vocabulary.value.head_classes()


class _Broadcast:
    """A broadcast variable that caches can compare, by its key."""

    def __init__(self, key: str, variable):
        self.key, self.variable = key, variable

    @property
    def value(self):
        return self.variable.value

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


def _sequence(words: list[bytes], index: _Places) -> np.ndarray:
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def _classes(places: np.ndarray, head_classes: np.ndarray) -> np.ndarray:
    out = -1 - places
    known = places >= 0
    out[known] = head_classes[places[known]]
    return out


def _before(flat: np.ndarray, ends: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts one and two places before each class of texts put one after another; START before a text's first."""
    own = contexts[flat]
    first = np.append(0, ends[:-1])
    one, two = np.empty_like(own), np.empty_like(own)
    one[1:], two[2:] = own[:-1], own[:-2]
    one[first] = two[first] = START
    seconds = first[np.diff(ends, prepend=0) > 1] + 1
    two[seconds] = START
    return one, two


_NAMES = ("context", "target", "place", "bias")


def start_parameters(noise: np.ndarray, seed: int = 8) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "context": rng.normal(0, 0.1, (N_CONTEXTS, DIMENSIONS)).astype(np.float32),
        "target": rng.normal(0, 0.1, (len(noise), DIMENSIONS)).astype(np.float32),
        "place": np.array([[1.0], [0.7]], np.float32) * np.ones((2, DIMENSIONS), np.float32),
        "bias": np.log(noise).astype(np.float32),
    }


def start_memory(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    flat = (index[:, None] * DIMENSIONS + np.arange(DIMENSIONS)).ravel()
    return np.bincount(flat, rows.ravel(), n * DIMENSIONS).reshape(n, DIMENSIONS)


class Trainer:
    """Noise-contrastive steps with Adagrad, in numpy, from given parameters."""

    def __init__(self, noise: np.ndarray, seed: int, parameters: dict | None = None, memory: dict | None = None):
        self.p = {k: v.copy() for k, v in (parameters or start_parameters(noise)).items()}
        self.memory = {k: v.copy() for k, v in (memory or start_memory(self.p)).items()}
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def step(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n = self.p, len(token)
        x1, x2 = p["context"][one], p["context"][two]
        q = x1 * p["place"][0] + x2 * p["place"][1]
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(self.log_noise) - 1)
        t, d = p["target"][token], p["target"][drawn]
        true = 1 - _sigmoid((q * t).sum(1) + p["bias"][token] - self.log_noise[token])
        false = -_sigmoid(q @ d.T + p["bias"][drawn] - self.log_noise[drawn])
        dq = true[:, None] * t + false @ d
        gradient = {
            "target": _scatter(np.concatenate([token, drawn]), np.concatenate([true[:, None] * q, false.T @ q]), len(p["target"])),
            "context": _scatter(np.concatenate([one, two]), np.concatenate([dq * p["place"][0], dq * p["place"][1]]), N_CONTEXTS),
            "place": np.stack([(dq * x1).sum(0), (dq * x2).sum(0)]),
            "bias": np.bincount(np.concatenate([token, drawn]), np.concatenate([true, false.sum(0)]), len(p["bias"])),
        }
        root = np.float32(math.sqrt(n))
        for k, g in gradient.items():
            g = g.astype(np.float32) / root
            self.memory[k] += g * g
            p[k] += np.float32(RATE) * g / np.sqrt(self.memory[k])
        self.tokens += n

    def block(self, flat: np.ndarray, ends: np.ndarray, contexts: np.ndarray) -> None:
        """One pass over the classes of a block's texts, in random order."""
        one, two = _before(flat, ends, contexts)
        order = self.rng.permutation(len(flat))
        for k in range(0, len(order), BATCH):
            o = order[k : k + BATCH]
            self.step(flat[o], one[o], two[o])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _flat(trainer: Trainer) -> np.ndarray:
    return np.concatenate([state[k].ravel() for state in (trainer.p, trainer.memory) for k in _NAMES])


def _apart(flat: np.ndarray, p: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
    """Parameters and memory out of one vector."""
    out, at = [], 0
    for _ in range(2):
        state = {}
        for k in _NAMES:
            state[k] = flat[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        out.append(state)
    return out


_PIECES = 16


def _summed(rows: Iterator[tuple[int, int, bytes]]) -> dict[int, tuple[int, np.ndarray]]:
    """Weight and weighted sum of each piece."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for piece, weight, data in rows:
        w, total = sums.get(piece, (0, 0.0))
        sums[piece] = (w + weight, total + np.frombuffer(data, "<f8"))
    return sums


def _piece_batch(sums: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.int64()), pa.array([v.astype("<f8").tobytes() for _, v in sums.values()], pa.binary())], ["piece", "weight", "data"])


def _round(sequences: DataFrame, vocabulary: _Broadcast, state, n_blocks: int) -> np.ndarray | None:
    """``sequences``: block, key, classes.  The average over the blocks of what each learns from the common ``state``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        noise, (p, memory) = known.noise(), state.value
        total, weight, now, held = 0.0, 0, None, []

        def train() -> None:
            nonlocal total, weight
            flat = np.concatenate(held).astype(np.int64)
            trainer = Trainer(noise, now, p, memory)
            trainer.block(flat, np.cumsum(list(map(len, held))), known.contexts)
            total, weight = total + trainer.tokens * _flat(trainer).astype(np.float64), weight + trainer.tokens
            held.clear()

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and block != now:
                    train()
                now = block
                held.append(np.frombuffer(data, "<u2"))
        if held:
            train()
        if weight:
            yield _piece_batch({k: (weight, piece) for k, piece in enumerate(np.array_split(total, _PIECES))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _summed(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if sums:
            yield _piece_batch(sums)

    shape = "piece int, weight bigint, data binary"
    n = max(1, min(n_blocks, 4 * sequences.sparkSession.sparkContext.defaultParallelism))
    placed = sequences.repartitionById(n, F.floor(F.col("block") / ROUNDS).cast("int")).sortWithinPartitions("block", "key").select("block", "classes")
    rows = sorted(placed.mapInArrow(run, shape).repartition(_PIECES, "piece").mapInArrow(add, shape).collect())  # a model's size, whatever the corpus
    return np.concatenate([np.frombuffer(bytes(r.data), "<f8") / r.weight for r in rows]).astype(np.float32) if rows else None


def train(texts: DataFrame, vocabulary: _Broadcast, space: Workspace) -> dict[str, np.ndarray]:
    """``texts``: text, key.  Parameters after ROUNDS rounds."""
    known = vocabulary.value
    n_blocks = ROUNDS * math.ceil(max(1, known.tokens) / BLOCK_TOKENS / ROUNDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, head_classes = _index(vocabulary.key, vocabulary)
        for batch in slices(batches):
            found = [np.append(_classes(_sequence(t.lower().split(), index), head_classes), END).astype("<u2").tobytes() for t in raw_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["key", "classes"])

    block = F.pmod("key", F.lit(n_blocks)).cast("int")
    sequences = texts.select("text", "key").mapInArrow(run, "key bigint, classes binary").withColumn("block", block)
    sequences = space.table(sequences, "sequences")
    p = start_parameters(known.noise())
    state = [p, start_memory(p)]
    for turn in range(ROUNDS if known.tokens else 0):
        shared = texts.sparkSession.sparkContext.broadcast(state)
        flat = _round(sequences.where(F.col("block") % ROUNDS == turn), vocabulary, shared, n_blocks // ROUNDS)
        state = state if flat is None else _apart(flat, p)
        shared.unpersist()
    space.drop("sequences")
    return state[0]


def tables(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by nearer context, scores by farther context with bias, and the log of every pair's normaliser."""
    near = (p["context"] * p["place"][0]) @ p["target"].T
    far = (p["context"] * p["place"][1]) @ p["target"].T + p["bias"]
    top1, top2 = near.max(1, keepdims=True), far.max(1, keepdims=True)
    sums = np.exp(near - top1) @ np.exp(far - top2).T
    with np.errstate(divide="ignore"):
        z = np.log(sums) + top1 + top2.T
    for one, two in np.argwhere(sums < 1e-30):  # contexts whose peaks lie far apart: the sum on its own scale
        both = (near[one] + far[two]).astype(np.float64)
        z[one, two] = both.max() + math.log(np.exp(both - both.max()).sum())
    return near, far, z


@lru_cache(maxsize=1)
def _tables(key: str, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tables(model.value)


_PART = "id {kind}, row bigint, n_tokens bigint, n_known bigint, base double, score double, words array<binary>, times array<int>"


def score(docs: DataFrame, counts: DataFrame, vocabulary: _Broadcast, model: _Broadcast, space: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score (log10) of every text."""
    known = vocabulary.value
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    floor = math.log10(known.tokens + known.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        known = vocabulary.value
        index, head_classes = _index(vocabulary.key, vocabulary)
        near, far, z = _tables(model.key, model)
        log_c = np.log10(known.counts + 1.0)
        log_share, shortlist = known.log_share(), known.shortlist
        for batch in slices(batches):
            words = [t.lower().split() for t in raw_texts(batch.column(1))]
            places = [_sequence(w, index) for w in words]
            token = np.concatenate([np.append(_classes(p, head_classes), END) for p in places])
            ends = np.cumsum([len(p) + 1 for p in places])
            one, two = _before(token, ends, known.contexts)
            logs = (near[one, token] + far[two, token] - z[one, two]).astype(np.float64) / math.log(10) - log_share[token]
            totals = np.add.reduceat(logs, np.append(0, ends[:-1]))
            rest_words, rest_times, base, other, seen = [], [], [], [], []
            for w, p in zip(words, places, strict=True):
                c = log_c[p[p >= 0]]  # of words whose count is still to come, nothing
                far_off = np.nonzero(p < 0)[0]
                base.append(c.sum() + math.log10(known.docs + 1))
                other.append(log_c[p[p >= shortlist]].sum())
                seen.append(len(w) - len(far_off) + (known.docs > 0))
                tail = Counter([w[i] for i in far_off.tolist()])
                rest_words.append(list(tail))
                rest_times.append(list(tail.values()))
            n = np.array([len(w) + 1 for w in words], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + len(n))), pa.array(n), pa.array(seen, pa.int64()), pa.array(np.array(base) - n * floor), pa.array(totals + np.array(other)), pa.array(rest_words, pa.list_(pa.binary())), pa.array(rest_times, pa.list_(pa.int32()))],
                ["id", "row", "n_tokens", "n_known", "base", "score", "words", "times"],
            )
            row += len(n)

    parts = space.table(source.mapInArrow(run, _PART.format(kind=kind)), "parts")
    tail = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    found = tail.join(counts, "word")  # words that training never saw add nothing
    more = found.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"))
    both = parts.select("id", "row", "n_tokens", "n_known", "base", "score").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return both.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))


def learn(texts: DataFrame, space: Workspace) -> tuple[DataFrame, _Broadcast, _Broadcast]:
    """``texts``: text and, optionally, key (bigint, which names a document).  Counts (a table), vocabulary and model (broadcasts of bounded size)."""
    spark = texts.sparkSession
    keyed = texts.select("text", F.col("key") if "key" in texts.columns else F.xxhash64("text").alias("key"))
    counts = space.table(word_counts(keyed.select("text")), "counts")
    vocabulary = vocabulary_of(counts, texts.count())
    shared = _Broadcast(space.uri, spark.sparkContext.broadcast(vocabulary))
    return counts, shared, _Broadcast(space.uri, spark.sparkContext.broadcast(train(keyed, shared, space)))


def op8_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark, "lm")
    rest: Column = held_out(F.col("doc_id"), 7)
    text = F.col("text").cast("string")
    counts, vocabulary, model = learn(docs.where(rest != 2).select(text.alias("text"), F.xxhash64("doc_id", text).alias("key")), space)
    scored = score(docs, counts, vocabulary, model, space)
    return scored.select("doc_id", (rest == 2).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.value.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
