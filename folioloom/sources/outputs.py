"""What leaves the library: answer CSV, review JSON, archives, documents, drafts.

Writers return a row per set or group with its content, so a table of any number of sets
stays distributed; a set's own size is bounded by the caller (``records.guard``).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from email.message import EmailMessage
from email.policy import SMTP
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.text import csv_cell

REVIEW_VERSION = 1
_EPOCH = (1980, 1, 1, 0, 0, 0)
_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
#: Parts that every text document has. Fixed values.
_PARTS = (
    ("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'),
    ("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
)


def answer_csv(df: DataFrame, group: str, ordinal: str, columns: list[str]) -> DataFrame:
    """A CSV text for each group: byte order mark, header, CRLF, cells that no spreadsheet runs."""
    cells = F.concat_ws(",", *[csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    header = ",".join(f'"{c}"' for c in columns)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), cells.alias("line")))), lambda r: r["line"])
    return df.groupBy(group).agg(F.concat(F.lit("﻿"), F.concat_ws("\r\n", F.lit(header), lines), F.lit("\r\n")).alias("content"))


def review_json(df: DataFrame, group: str, ordinal: str, columns: list[str]) -> DataFrame:
    """A versioned review text for each group, with the named columns only."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("__o"), F.struct(*columns).alias("r")))), lambda x: x["r"])
    return df.groupBy(group).agg(F.to_json(F.struct(F.lit(REVIEW_VERSION).alias("version"), rows.alias("questions"))).alias("content"))


def read_review(df: DataFrame, content: str, question: str) -> DataFrame:
    """Questions of review texts, each as a struct ``q`` of the type ``question``; another version or a damaged text is an error."""
    parsed = F.from_json(content, f"struct<version:int,questions:array<{question}>>", {"mode": "FAILFAST"})
    whole = df.withColumn("__r", parsed)
    version = F.when(F.col("__r.version") == REVIEW_VERSION, F.lit(True)).otherwise(F.raise_error(F.lit("unknown version of a review")).cast("boolean"))
    rest = [c for c in df.columns if c != content]
    return whole.where(version).select(*rest, F.posexplode("__r.questions").alias("ord", "q"))


def packed(entries: list[tuple[str, bytes]]) -> bytes:
    """Stored entries with fixed time stamps: equal contents give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in entries:
            z.writestr(zipfile.ZipInfo(name, _EPOCH), content)
    return out.getvalue()


def archives(df: DataFrame, group: str, name: str, content: str, most_bytes: int = 150 << 20) -> DataFrame:
    """A ZIP for each group, entries by name.  A group over ``most_bytes`` is an error, told before any is packed."""
    size = F.octet_length(F.col(content))
    rows = df.select(F.col(group).alias("g"), F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"), size.alias("size"))
    over = rows.groupBy("g").agg(F.sum("size").alias("s")).where(F.col("s") > most_bytes)
    if not over.isEmpty():
        raise ValueError(f"an archive would exceed {most_bytes} bytes")
    kind = rows.schema["g"].dataType.simpleString()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("name", kind="stable")
        return pd.DataFrame({"g": frame["g"].iloc[:1].to_list(), "content": [packed([(n, bytes(c or b"")) for n, c in zip(ordered["name"], ordered["content"], strict=True)])]})

    return rows.drop("size").groupBy("g").applyInPandas(pack, f"g {kind}, content binary").withColumnRenamed("g", group)


def document(paragraphs: list[str]) -> bytes:
    """A text document; line breaks and tabs inside a paragraph are kept."""
    def run(text: str) -> str:
        lines = ["<w:tab/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in line.split("\t")) for line in text.split("\n")]
        return f"<w:p><w:r>{'<w:br/>'.join(lines)}</w:r></w:p>"

    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document {_WORD}><w:body>{"".join(map(run, paragraphs))}</w:body></w:document>'
    return packed([*((n, x.encode()) for n, x in _PARTS), ("word/document.xml", body.encode())])


def documents(df: DataFrame, group: str, ordinal: str, text: str) -> DataFrame:
    """A text document for each group with a paragraph a row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda r: r["t"])
    rows = df.groupBy(F.col(group).alias("g")).agg(lines.alias("lines"))
    kind = rows.schema["g"].dataType.simpleString()

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"g": frame["g"], "content": [document(list(x)) for x in frame["lines"]]})

    return rows.mapInPandas(write, f"g {kind}, content binary").withColumnRenamed("g", group)


def _draft(to: pd.Series, subject: pd.Series, body: pd.Series, name: pd.Series, attachment: pd.Series) -> pd.Series:
    out = []
    for t, s, b, n, a in zip(to, subject, body, name, attachment, strict=True):
        m = EmailMessage(policy=SMTP)
        m["To"], m["Subject"], m["X-Unsent"] = t, " ".join((s or "").split()), "1"
        m.set_content(b or "")
        if a is not None:
            m.add_attachment(bytes(a), maintype="application", subtype="octet-stream", filename=n or "attachment")
            m.set_boundary(f"part-{len(a)}-{len(b or '')}")
        out.append(m.as_bytes())
    return pd.Series(out)


def draft(to: Column, subject: Column, body: Column, name: Column, attachment: Column) -> Column:
    """An unsent message with one attachment (null: none)."""
    return F.pandas_udf(_draft, "binary")(to, subject, body, name, attachment)
