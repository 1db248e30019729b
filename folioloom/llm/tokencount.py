"""Operator 7: token counts, lengths only.

Texts go through an Arrow function that returns lengths; batches are cut by
bytes, and long texts at safe boundaries (see ``encode``), so one very long
document needs no more memory than its pieces.  Null and empty texts have no
bytes and no tokens.  Repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.encode import encoder
from folioloom.llm.text import slices

VOCAB = "byte_bpe_50k.json"


def count_tokens(docs: DataFrame, vocab: str = VOCAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_bytes`` (UTF-8) and ``n_tokens`` of each text."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in slices(batches):
            sizes = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
            counts = np.array([enc.count(t) if t else 0 for t in batch.column(1).to_pylist()], np.int64)
            enc.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def op7_token_counts(spark, sf_dir: str, limit: int = 1024) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > limit)
