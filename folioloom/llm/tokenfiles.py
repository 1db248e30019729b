"""Operator 1: token ids as flat binary files.

A set of files holds, per part, ``ids`` (unsigned little-endian integers, two
bytes wide where the vocabulary allows, else four), ``off`` (int64 start of
every document inside the part, one more entry at the end) and ``doc`` (int64
document ids).  ``manifest`` is a table with one row per part; a part's base is
the prefix sum of the token counts before it.  Readers memory-map parts.

Documents are laid out in ascending id order: one range exchange, one sort in
each range.  Null ids come first and read back as null; repeated ids stand
beside each other, ordered by text.  Null and empty texts hold only the end id.
An empty table gives an empty manifest.  Only id and text are read.

Every task attempt writes files under a name of its own; the manifest names
those of the attempts that succeeded, so retried and duplicate tasks do no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.encode import encoder
from folioloom.llm.store import Workspace, make_dir, map_file, open_fs
from folioloom.llm.text import slices

VOCAB, END_ID = "word_bpe_49k.json", 2
_NULL_ID = np.iinfo(np.int64).min
_PART = "part int, base string, width int, n_docs bigint, n_tokens bigint"


def write_tokens(docs: DataFrame, uri: str, vocab: str = VOCAB, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below ``uri`` and returns the manifest (written there too), with ``start`` of each part."""
    spark = docs.sparkSession
    make_dir(uri)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocab), TaskContext.get().partitionId()
        base = f"{uri}/{part:07d}-{uuid.uuid4().hex}"
        end = np.array([end_id], enc.dtype).tobytes()
        ids, lengths, out = [], [], None
        for batch in slices(batches):
            if out is None:
                fs, path = open_fs(base)
                out = fs.open_output_stream(path + ".ids")
            encoded = [enc.encode(t) + end if t else end for t in batch.column(1).to_pylist()]
            enc.trim()
            out.write(b"".join(encoded))
            lengths.append(np.fromiter(map(len, encoded), np.int64, len(encoded)) // enc.dtype.itemsize)
            ids.append(batch.column(0).fill_null(_NULL_ID).to_numpy())
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        for suffix, data in ((".off", offsets), (".doc", np.concatenate(ids).astype("<i8"))):
            with fs.open_output_stream(path + suffix) as f:
                f.write(data.tobytes())
        row = {"part": part, "base": base, "width": enc.dtype.itemsize, "n_docs": len(offsets) - 1, "n_tokens": int(offsets[-1])}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("base", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    parts = sorted(ordered.mapInArrow(run, _PART).collect())  # a row per part, not per document
    starts = accumulate((p.n_tokens for p in parts), initial=0)
    manifest = spark.createDataFrame([(*p, s) for p, s in zip(parts, starts, strict=False)], _PART + ", start bigint")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{uri}/manifest")
    return spark.read.schema(_PART + ", start bigint").parquet(f"{uri}/manifest")


def read_tokens(manifest: DataFrame, digest_only: bool = False) -> DataFrame:
    """Documents back from the files: doc_id, start, n_tokens, ids_crc32 and, unless digest_only, tokens."""
    tokens = "" if digest_only else ", tokens array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(map_file(row["base"] + ".ids"), f"<u{row['width']}")
                off = np.frombuffer(map_file(row["base"] + ".off"), "<i8")
                doc = np.frombuffer(map_file(row["base"] + ".doc"), "<i8")
                for k in range(0, len(doc), 2000):
                    stop = min(k + 2000, len(doc))
                    crc = [zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(k, stop)]
                    columns = [
                        pa.array(doc[k:stop], mask=doc[k:stop] == _NULL_ID),
                        pa.array(off[k:stop] + row["start"]),
                        pa.array(np.diff(off[k : stop + 1])),
                        pa.array(crc, pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if not digest_only:
                        flat = pa.array(ids[off[k] : off[stop]].astype(np.int32))
                        columns.append(pa.ListArray.from_arrays(pa.array((off[k : stop + 1] - off[k]).astype(np.int32)), flat))
                        names.append("tokens")
                    yield pa.RecordBatch.from_arrays(columns, names)

    spark = manifest.sparkSession
    n = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.repartition(n).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + tokens)


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes the files for ``docs`` to the shared folder and reads the digest back from them."""
    space = Workspace(spark, "tokens")
    return read_tokens(write_tokens(docs, space.path("files")), digest_only=True)


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    return token_digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
