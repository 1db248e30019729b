"""Documents packed as ZIP with XML parts: paragraphs, styled runs and tables.

A package is one row of bytes.  Bounds hold before anything is inflated; a package that
breaks one, or whose XML declares entities, gives a single row that says why, so one bad
file never fails the others.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds on a package. Fixed values.
MOST_ARCHIVE, MOST_ENTRY, MOST_EXPANDED, MOST_XML = 64 << 20, 32 << 20, 256 << 20, 24 << 20
MOST_ENTRIES, MOST_NODES, MOST_DEPTH, MOST_CELLS, MOST_RATIO = 2048, 500_000, 96, 4096, 200
_SECTION = re.compile(r"(?:Contents/section|word/document)(\d*)\.xml")
_BREAKS = {"lineBreak": "\n", "br": "\n", "tab": "\t", "nbSpace": " ", "fwSpace": "　"}
_CELL = pa.struct([("row", pa.int32()), ("column", pa.int32()), ("row_span", pa.int32()), ("column_span", pa.int32()), ("text", pa.string())])
_SHAPE = pa.schema([("section", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("styled", pa.string()), ("cells", pa.list_(_CELL)), ("error", pa.string())])
_SQL = "section int, ord int, kind string, text string, styled string, cells array<struct<row:int,column:int,row_span:int,column_span:int,text:string>>, error string"


class PackageError(ValueError):
    """The package breaks a bound or is damaged."""


def _safe(name: str) -> bool:
    plain = not re.search(r"[\\:%?#\x00-\x1f\x7f]", name) and 0 < len(name) <= 1024
    return plain and all(p not in ("", ".", "..") for p in name.removesuffix("/").split("/"))


def open_package(data: bytes) -> dict[str, bytes]:
    """Parts by name; raises PackageError."""
    if len(data) > MOST_ARCHIVE:
        raise PackageError("archive too large")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            entries = z.infolist()
            if len(entries) > MOST_ENTRIES or len({e.filename for e in entries}) < len(entries):
                raise PackageError("too many entries, or two of one name")
            for e in entries:
                if not _safe(e.filename) or e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise PackageError(f"entry not allowed: {e.filename[:100]}")
                if e.file_size > MOST_ENTRY or e.file_size > MOST_RATIO * max(e.compress_size, 1 << 10):
                    raise PackageError(f"entry too large: {e.filename[:100]}")
            if sum(e.file_size for e in entries) > MOST_EXPANDED:
                raise PackageError("contents too large")
            return {e.filename: z.read(e) for e in entries if not e.is_dir()}  # checks lengths and CRC-32
    except (zipfile.BadZipFile, EOFError, NotImplementedError, OSError) as e:
        raise PackageError(f"damaged archive: {e}") from e


def parse_xml(data: bytes) -> ElementTree.Element:
    """Root of a part without declarations of entities or document types."""
    if len(data) > MOST_XML:
        raise PackageError("part too large")
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise PackageError("part is not UTF-8") from e
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.I):
        raise PackageError("declarations are not allowed")
    nodes = depth = 0
    parser = ElementTree.XMLPullParser(["start", "end"])
    try:
        for at in range(0, len(text), 1 << 16):
            parser.feed(text[at : at + (1 << 16)])
            for event, root in parser.read_events():
                depth += 1 if event == "start" else -1
                nodes += event == "start"
                if nodes > MOST_NODES or depth > MOST_DEPTH:
                    raise PackageError("too many or too deep elements")
        parser.close()
    except ElementTree.ParseError as e:
        raise PackageError(f"damaged part: {e}") from e
    if not nodes:
        raise PackageError("empty part")
    return root


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attribute(e: ElementTree.Element, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def _text(e: ElementTree.Element) -> str:
    if _local(e) == "t":
        return (e.text or "") + "".join(_text(c) + (c.tail or "") for c in e)
    return _BREAKS.get(_local(e), "".join(map(_text, e)) if _local(e) != "tbl" else "")


def _styles(header: ElementTree.Element | None) -> dict[str, str]:
    """Marks (b, u) of each character style."""
    out = {}
    for e in header.iter() if header is not None else ():
        if _local(e) == "charPr":
            kinds = {_local(c): c for c in e}
            lined = "underline" in kinds and _attribute(kinds["underline"], "type", "BOTTOM") != "NONE"
            out[_attribute(e, "id")] = ("b" if "bold" in kinds else "") + ("u" if lined else "")
    return out


def _styled(paragraph: ElementTree.Element, styles: dict[str, str]) -> str:
    out = []
    for run in paragraph:
        text, marks = _text(run), styles.get(_attribute(run, "charPrIDRef"), "")
        out.append("".join(f"<{m}>" for m in marks) + text + "".join(f"</{m}>" for m in reversed(marks)) if text else "")
    return "".join(out)


def _cells(table: ElementTree.Element) -> list[dict]:
    out = []
    rows = [r for r in table if _local(r) == "tr"]
    for k, row in enumerate(rows):
        for j, cell in enumerate(c for c in row if _local(c) == "tc"):
            parts = {_local(c): c for c in cell}
            place, span = parts.get("cellAddr"), parts.get("cellSpan")
            number = lambda e, name, default: int(_attribute(e, name, str(default))) if e is not None else default
            body = "\n".join(_text(p) for p in cell.iter() if _local(p) == "p")
            out.append({"row": number(place, "rowAddr", k), "column": number(place, "colAddr", j), "row_span": number(span, "rowSpan", 1), "column_span": number(span, "colSpan", 1), "text": body})
    if len(out) > MOST_CELLS:
        raise PackageError("too many cells")
    return out


def _walk(e: ElementTree.Element, styles: dict[str, str]) -> Iterator[dict]:
    """Paragraphs and tables in order; a table's own paragraphs stay in its cells."""
    for child in e:
        kind = _local(child)
        if kind == "p":
            tables = [t for t in child.iter() if _local(t) == "tbl"]
            text = _text(child)
            if text or not tables:
                yield {"kind": "text", "text": text, "styled": _styled(child, styles)}
            nested = {id(x) for t in tables for x in t.iter() if x is not t}
            for t in tables:
                if id(t) not in nested:
                    yield {"kind": "table", "cells": _cells(t)}
        elif kind == "tbl":
            yield {"kind": "table", "cells": _cells(child)}
        else:
            yield from _walk(child, styles)


def read_package(data: bytes) -> list[dict]:
    """Rows of a package: section, ord, kind (text, table), text, styled, cells; or one row with the error."""
    try:
        parts = open_package(bytes(data))
        sections = sorted((int(m[1] or 0), name) for name in parts if (m := _SECTION.fullmatch(name)))
        if not sections:
            raise PackageError("no section")
        header = parts.get("Contents/header.xml")
        styles = _styles(parse_xml(header) if header else None)
        rows = [{"section": k, **row} for k, name in sections for row in _walk(parse_xml(parts[name]), styles)]
        return [{**row, "ord": k} for k, row in enumerate(rows)]
    except (PackageError, ValueError) as e:
        return [{"error": str(e)}]


def unpacked(df: DataFrame, name: str, content: str) -> DataFrame:
    """Rows of every package, with the column ``name`` in front.  Null content is a damaged archive."""
    source = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    kind = source.schema["name"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a package at a time
                rows = pa.RecordBatch.from_pylist(read_package(batch.column(1)[k].as_py() or b""), _SHAPE)
                names = batch.column(0).take(pa.array([k] * rows.num_rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([names, *rows.columns], ["name", *_SHAPE.names])

    return source.mapInArrow(run, f"name {kind}, {_SQL}").withColumnRenamed("name", name)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all packages below a path."""
    return unpacked(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"), "path", "content")
