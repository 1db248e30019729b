"""Answer keys and catalogues from CSV files, and the bank as partitioned Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header names that a column may have. Fixed values.
ALIASES = {
    "subject": ("과목", "subject"),
    "section": ("구분", "선택", "section"),
    "number": ("번호", "문항", "문항번호", "number", "no"),
    "value": ("정답", "답", "answer"),
    "code": ("문항코드", "code", "id"),
}
CATALOGUE = "school string, subject string, grade string, code string, statement string"
_ENTRY = "path string, line int, number int, value string, subject string, section string, code string, warning string"


def strict_rows(text: str) -> list[tuple[int, list[str]]] | None:
    """Rows of a CSV text with the line each starts on; None if any quote is out of place."""
    rows, row, cell, line, first = [], [], "", 1, 1
    quoted = closed = False
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    for c in text + ("" if text.endswith("\n") else "\n"):
        if quoted:
            quoted, closed = (False, True) if c == '"' else (True, False)
            cell += "" if c == '"' else c
        elif c == '"':
            if closed:  # a doubled quote
                cell, quoted, closed = cell + c, True, False
            elif cell:
                return None
            else:
                quoted = True
        elif c in ",\n":
            row, cell, closed = [*row, cell.strip()], "", False
            if c == "\n":
                if any(row):
                    rows.append((first, row))
                row, first = [], line + 1
        elif closed:
            return None
        else:
            cell += c
        line += c == "\n"
    return None if quoted else rows


def parse_answers(text: str) -> list[dict]:
    """Entries, and warnings for rows that hold none.  Without a header the columns are number and answer."""
    rows = strict_rows(text)
    if rows is None:
        return [{"line": 1, "warning": "misplaced quote"}]
    at = {"number": 0, "value": 1}
    if rows:
        names = [c.lower() for c in rows[0][1]]
        found = {k: next((names.index(a) for a in alias if a in names), None) for k, alias in ALIASES.items()}
        if found["value"] is not None:
            at, width = {k: v for k, v in found.items() if v is not None}, len(names)
            rows = rows[1:]
        else:
            width = 2
    out = []
    for line, cells in rows:
        get = {k: cells[v] if v < len(cells) else "" for k, v in at.items()}
        number = int(get["number"]) if get.get("number", "").isdecimal() else 0
        if len(cells) != width:
            out.append({"line": line, "warning": "wrong number of cells"})
        elif not get["value"]:
            out.append({"line": line, "warning": "no answer"})
        elif not number and not get.get("code"):
            out.append({"line": line, "warning": "no number"})
        else:
            out.append({"line": line, "number": number or None, "value": get["value"], **{k: get.get(k) or None for k in ("subject", "section", "code")}})
    return out


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Entries and warnings of every answer file below a path; a file is a row, so it is never split."""

    integers = ("line", "number")
    schema = pa.schema([(n, pa.int32() if n in integers else pa.string()) for n in (c.split()[0] for c in _ENTRY.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p, **e} for p, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in parse_answers(text)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(run, _ENTRY)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Standards with school, subject, code and statement; rows that lack one are left out."""
    table = spark.read.csv(path, schema=CATALOGUE, header=True, multiLine=True, quote='"', escape='"')
    return table.where(" and ".join(f"trim({c}) <> ''" for c in ("school", "subject", "code", "statement")))


def save_bank(questions: DataFrame, path: str) -> None:
    """Replaces the snapshots of the sources in ``questions``; other sources stay."""
    questions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def source_id(name, fingerprint):
    """Identity of a source: digest of its name and fingerprint."""
    return F.sha2(F.to_json(F.array(name, fingerprint)), 256)
