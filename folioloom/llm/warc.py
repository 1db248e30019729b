"""Operator 3: WARC archives, written and read back with boundary-chain verification.

Writing.  One plain record per page.  Of pages with
equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest id
is a ``response``; the others are ``revisit`` records that name it and hold no
payload.  Payload groups come from a partial minimum over digests and only groups
of two or more go on, so pages are shuffled just where that table is too large
to send to every task.  Tasks write files of their own, a new one after
``FILE_BYTES``; the list of files holds those of the attempts that succeeded.

Reading.  Files are read in byte ranges of ``RANGE_BYTES``.  Each task looks for the
magic in its range and emits, for every place where a record could start, the
place where its successor would.  Pointer jumping from the start of the file keeps
the reachable places, so the magic inside a payload starts no record.  A file's
chain is bounded by FILE_BYTES (or one record, if longer); only offsets take part in it.
A chain that does not end at the end of its file with the number of records that the
list of files tells is an error.  Headers are read to their end, however long.

Null html is an empty payload, null url leaves the target out, null page_id is
written as ``null`` and read back as null.  As nothing can tell such pages apart, each is a
``response``, equal payloads or not.  Repeated ids each get a record; of equal payloads with
the smallest id each is a response.  An empty table gives no file and no row.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.store import Workspace, make_dir, map_range, open_fs
from folioloom.llm.text import slices

REVISIT_BYTES, FILE_BYTES, RANGE_BYTES = 100, 64 << 20, 8 << 20
MAGIC = b"WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One uncompressed WARC record."""
    body = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    lines = ["WARC-Type: " + ("revisit" if revisit else "response"), "WARC-Record-ID: " + _name(page_id)]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", "WARC-Refers-To: " + _name(refers_to)]
    lines.append(f"Content-Length: {len(body)}")
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_FILE = "path string, n_records bigint, n_bytes bigint"


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives below ``uri``; returns the table of files (path, n_records, n_bytes)."""
    make_dir(uri)
    space = Workspace(pages.sparkSession, "warc-groups")
    source = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    digest = F.sha2(F.encode("html", "utf-8"), 256)
    groups = source.where(F.octet_length("html") >= REVISIT_BYTES).groupBy(digest.alias("digest")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = space.table(groups.where("n > 1").select(F.col("digest").alias("d"), "first"), "groups")
    keyed = source.withColumn("digest", digest)
    laid = keyed.join(groups, keyed["digest"] == groups["d"], "left").select("id", "url", "html", "digest", "first", F.col("d").isNotNull().alias("grouped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, fs = None, [], None
        for batch in slices(batches, "html"):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, url, html, digest, first, grouped = row
                data = record(page, url, html.encode(), digest, first, grouped and page is not None and page != first)
                if out is not None and size + len(data) > file_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
                if out is None:
                    path, n, size = f"{uri}/{uuid.uuid4().hex}.warc", 0, 0
                    fs, where = open_fs(path)
                    out = fs.open_output_stream(where)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "n_records", "n_bytes"])

    return space.table(laid.mapInArrow(run, _FILE), "files")


_FIELD = rb"[A-Za-z-]+:[^\r\n]*\r\n"
_HEAD = re.compile(rb"WARC/1\.1\r\n((?:" + _FIELD + rb")+)\r\n")
#: What a header looks like that the data at hand cut off.
_HEAD_CUT = re.compile(rb"WARC/1\.1\r\n(?:" + _FIELD + rb")*(?:[A-Za-z-]+(?::[^\r\n]*)?)?\r?\Z")
_HEADER = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
_HTTP_HEAD = re.compile(rb"HTTP/1\.[01] [^\r\n]*\r\n((?:[^\r\n]+\r\n)*)\r\n")


class CutOff(Exception):
    """The record may go on where the data at hand end."""


def parse_record(data, at: int) -> dict | None:
    """The record whose magic is at ``at``, with the offset of its successor; None if no record can start there."""
    m = _HEAD.match(data, at)
    if m is None:
        if _HEAD_CUT.match(data, at):
            raise CutOff
        return None
    fields = {k.lower(): v for k, v in _HEADER.findall(m[1])}
    try:
        length = int(fields[b"content-length"])
    except (KeyError, ValueError):
        return None
    body = m.end()
    if length < 0:
        return None
    if body + length + 4 > len(data):
        raise CutOff
    if bytes(data[body + length : body + length + 4]) != b"\r\n\r\n":
        return None
    return {"at": at, "next": body + length + 4, "fields": fields, "body": body, "length": length}


def _told(data, r: dict) -> tuple[int, str, str, bool]:
    """Payload bytes, digest, type of a record, and whether the digest that it tells is right."""
    f = r["fields"]
    kind = f.get(b"warc-type", b"").decode("latin-1")
    told = f.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
    end = r["body"] + r["length"]
    head = _HTTP_HEAD.match(data, r["body"], end)
    if kind == "revisit":
        m = head and re.search(rb"Content-Length: (\d+)", head[1])
        return int(m[1]) if m else 0, told, kind, True
    payload = data[head.end() if head else r["body"] : end]
    digest = hashlib.sha256(payload).hexdigest()
    return len(payload), digest, kind, digest == told


def _page(name: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", name or b"")
    return int(m[1]) if m else None


_CANDIDATE = "path string, size bigint, at bigint, next bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"
_NAMES = [c.split()[0] for c in _CANDIDATE.split(", ")]


def candidates(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every place where a record could start, with what the record would hold."""
    ranges = files.select("path", F.col("n_bytes").alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(range_bytes))).alias("from"))
    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(row: dict) -> Iterator[tuple]:
        low, stop = row["from"], min(row["from"] + range_bytes, row["size"])
        high = min(row["size"], stop + range_bytes)
        data = memoryview(map_range(row["path"], low, high))
        places = [m.start() for m in re.finditer(re.escape(MAGIC), data[: stop + len(MAGIC) - 1 - low])]
        for k in places:
            while True:
                try:
                    r = parse_record(data, k)
                    break
                except CutOff:
                    if high == row["size"]:
                        r = None
                        break
                    high = min(row["size"], low + 2 * (high - low))
                    data = memoryview(map_range(row["path"], low, high))
            if r is not None:
                n_bytes, digest, kind, intact = _told(data, r)
                yield (row["path"], row["size"], low + k, low + r["next"], _page(r["fields"].get(b"warc-record-id")), n_bytes, digest, kind, _page(r["fields"].get(b"warc-refers-to")), intact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in _NAMES[1:6]), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
        for batch in batches:
            for row in batch.to_pylist():
                found = list(scan(row))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return ranges.repartition(n).mapInArrow(run, _CANDIDATE)


def reachable(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which places (ascending) the chain from offset 0 visits, by pointer jumping."""
    n = len(at)
    where = np.searchsorted(at, following)
    exact = np.zeros(n, bool)
    inside = where < n
    exact[inside] = at[where[inside]] == following[inside]
    jump = np.append(np.where(exact, where, n), n)  # n: the end
    seen = np.zeros(n + 1, bool)
    seen[: n and int(at[0] == 0)] = True
    for _ in range(max(1, n).bit_length()):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    return rows[["path", "at"]][reachable(rows["at"].to_numpy(), rows["next"].to_numpy())]


def read_warc(files: DataFrame) -> DataFrame:
    """The records that the boundary chain of each file reaches: page_id, payload_bytes, payload_digest, record_type, refers_to, intact, path, at."""
    space = Workspace(files.sparkSession, "warc-read")
    found = space.table(candidates(files), "candidates")
    chain = found.select("path", "at", "next").groupBy("path").applyInPandas(_chain, "path string, at bigint")
    records = space.table(found.join(chain, ["path", "at"]), "records")
    ends = records.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("n"), F.max("next").alias("end"))
    broken = files.join(ends, files["path"] == ends["p"], "left").where(~(F.col("n_bytes").eqNullSafe(F.col("end")) & F.col("n_records").eqNullSafe(F.col("n")))).select("path").limit(5).collect()
    if broken:
        raise ValueError(f"archives whose chain of records does not reach their end: {[r.path for r in broken]}")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "path", "at")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "warc")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), space.path("archives"))
    return read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP3_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as h from pages),
q as (select page_id, octet_length(h) as n, sha256(h) as d from p),
r as (select *, min(page_id) over (partition by d) as first from q)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> first then first end as refers_to,
       true as intact
from r
"""
