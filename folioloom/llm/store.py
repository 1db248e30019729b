"""Shared storage: where tables and files live that several tasks, or a later job, must see.

The folder comes from ``spark.checkpoint.dir``.  Only where that is unset, and
only in local mode (tests), a temporary folder of this machine stands in.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_leftovers: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="folioloom-")
    return _local_root


def _delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _sweep() -> None:
    for spark, uri in _leftovers:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, uri)
        except Exception:  # the JVM may have ended before this process
            return


class Workspace:
    """A folder for one run of an operator, below the shared root.

    ``table`` cuts lineage: it writes a DataFrame as Parquet and reads it back,
    so a lost executor costs no more than the stage at hand and the optimizer
    knows the real size.  What a returned DataFrame still reads stays until
    the process ends; ``drop`` removes the rest earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _leftovers.append((spark, self.uri))

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


@contextmanager
def recording() -> Iterator[list[tuple[SparkSession, str]]]:
    """Collects the folders of the workspaces made inside, for ``forget``."""
    made: list[tuple[SparkSession, str]] = []
    start = len(_leftovers)
    yield made
    made += _leftovers[start:]


def forget(made: list[tuple[SparkSession, str]]) -> None:
    """Deletes recorded folders, once what they led to is written."""
    for spark, uri in made:
        _delete(spark, uri)
        _leftovers.remove((spark, uri))
    made.clear()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a URI, for use on executors."""
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)


def map_file(uri: str):
    """A file as a buffer: memory-mapped where the file system is local, else read."""
    import pyarrow as pa

    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        if fs.get_file_info(path).size == 0:
            return pa.py_buffer(b"")
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def map_range(uri: str, start: int, stop: int):
    """Bytes start to stop of a file: memory-mapped where the file system is local, else read."""
    import pyarrow as pa

    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return map_file(uri).slice(start, stop - start)
    with fs.open_input_file(path) as f:
        return pa.py_buffer(f.read_at(stop - start, start))
