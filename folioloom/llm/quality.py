"""Operator 5: quality scores by nearest-neighbour voting in a latent-semantic space.

Features of a text are hashed counts of its words, of their shapes (letter case,
digits and marks, runs collapsed), of words that repeat the one before, and a
bucket for its length.  On a bounded sample of labelled rows (``SAMPLE``, those with
the smallest hash of the id) they are weighted by inverse document frequency and
reduced to ``DIMENSIONS`` by a truncated SVD.  The labelled vectors (at most SAMPLE x
DIMENSIONS numbers) are broadcast; every document's cosines with all of them
come from blocked matrix products, and the ``NEIGHBOURS`` most similar vote with their
labels, weighted by similarity.

Null and empty texts have the length feature alone and are scored like others.
Labels that are null, or whose id is null, teach nothing; several labels of one id
count as the lowest.  Repeated documents get equal scores.  Without any label
every score is 0.5.  Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm.text import Memo, raw_texts, slices

SAMPLE, DIMENSIONS, NEIGHBOURS, SHARPNESS, THRESHOLD = 4096, 32, 25, 4, 0.3
_WORDS, _SHAPES, _LENGTHS = 2048, 512, 24
_REPEAT = _WORDS + _SHAPES
_SIZE = _REPEAT + 1 + _LENGTHS
_MEMO = 150_000


def _shape(word: str) -> str:
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", out)


def _buckets(word: bytes) -> int:
    """The buckets of a word and of its shape, in one number."""
    text = word.decode()
    bare = text.strip(".,;:!?").lower()
    return xxhash.xxh32_intdigest(bare) % _WORDS << 16 | _WORDS + xxhash.xxh32_intdigest(_shape(text)) % _SHAPES


@lru_cache(maxsize=1)
def _memo() -> Memo:
    return Memo(_buckets, _MEMO)


def _tokens(text: bytes) -> tuple[np.ndarray, int]:
    """Feature numbers with repeats, one for each occurrence, and the number of words."""
    words = text.split()
    n = len(words)
    both = np.fromiter(map(_memo().__getitem__, words), np.int64, n)
    same = int((both[1:] == both[:-1]).sum()) if n > 1 else 0
    length = _REPEAT + 1 + min(n.bit_length(), _LENGTHS - 1)
    return np.concatenate([both >> 16, both & 0xFFFF, np.full(same, _REPEAT), [length]]), n


def _sampled(docs: DataFrame, labels: DataFrame, teach: Column, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts and labels of the bounded sample."""
    rows = labels.where(teach & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = texts.join(F.broadcast(rows), texts["id"] == rows["doc_id"]).groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counted = [np.unique(_tokens(t)[0], return_counts=True) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([f.tolist() for f, _ in counted], pa.list_(pa.int16())), pa.array([c.tolist() for _, c in counted], pa.list_(pa.int32())), batch.column(2).cast(pa.int32())], ["f", "c", "y"])

    table = known.select("id", "text", "y").mapInArrow(run, "f array<smallint>, c array<int>, y int").toArrow()
    x, y = np.zeros((table.num_rows, _SIZE), np.float32), np.zeros(table.num_rows, np.float32)
    at = 0
    for batch in table.to_batches():
        for f, c, label in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            x[at, f.values.to_numpy()] = c.values.to_numpy()
            y[at] = label.as_py() > 0
            at += 1
    return x, y


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights of every feature in the latent space, and the labelled unit vectors."""
    if not len(y):
        return {"map": np.zeros((_SIZE, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": y}
    idf = np.log((1 + len(y)) / (1 + (x > 0).sum(0))).astype(np.float32)
    idf[_WORDS:] *= 3  # shapes, repeats and length are few among many words
    weighted = x * idf
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(5)
    basis = rng.standard_normal((_SIZE, DIMENSIONS + 16)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    _, _, v = np.linalg.svd(weighted @ basis, full_matrices=False)
    project = basis @ v[:DIMENSIONS].T
    vectors = _unit(weighted @ project)
    return {"map": (idf[:, None] * project).astype(np.float32), "vectors": vectors.astype(np.float32), "labels": y}


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def vote(model: dict, vectors: np.ndarray, block: int = 512) -> np.ndarray:
    """Similarity-weighted labels of the nearest labelled vectors."""
    labels = model["labels"]
    if not len(labels):
        return np.full(len(vectors), 0.5)
    k = min(NEIGHBOURS, len(labels))
    out = np.empty(len(vectors))
    for at in range(0, len(vectors), block):
        cosines = vectors[at : at + block] @ model["vectors"].T
        near = np.argpartition(cosines, len(labels) - k, axis=1)[:, len(labels) - k :]
        w = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** SHARPNESS
        out[at : at + block] = (w * labels[near]).sum(1) / w.sum(1)
    return out


def score(docs: DataFrame, model) -> DataFrame:
    """id and score of every text; ``model`` is a broadcast of what ``fit`` returns."""
    source = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        weights = fitted["map"]
        for batch in slices(batches):
            vectors = np.empty((batch.num_rows, weights.shape[1]), np.float32)
            for k, text in enumerate(raw_texts(batch.column(1))):
                vectors[k] = np.bincount(_tokens(text)[0], minlength=_SIZE).astype(np.float32) @ weights
            _memo().trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vote(fitted, _unit(vectors)))], ["id", "score"])

    return source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", "doc_id")


def held_out(ident: Column, folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(folds)), F.lit(1).cast("bigint"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = held_out(F.col("doc_id"), 5)
    model = spark.sparkContext.broadcast(fit(*_sampled(docs, labels, rest != 0, SAMPLE)))
    scored = score(docs, model)
    return scored.select("doc_id", (rest == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
