"""Bold and underlined text: balanced ``<b>`` and ``<u>`` marks (or ``[b]``, ``[u]``) as runs.

Marks that do not balance are no formatting: the whole text is then one plain run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"(<(/?)([bu])>|\[(/?)([bu])\])")


def runs(text: str | None) -> list[tuple[str, bool, bool]]:
    """Text, bold, underline of each run, in order."""
    text = text or ""
    out, open_marks, at = [], [], 0

    def upto(end: int) -> None:
        if end > at:
            out.append((text[at:end], "b" in open_marks, "u" in open_marks))

    for m in _MARK.finditer(text):
        upto(m.start())
        at = m.end()
        name = m[3] or m[5]
        if not (m[2] or m[4]):
            open_marks.append(name)
        elif not open_marks or open_marks.pop() != name:
            return [(text, False, False)]
    if open_marks:
        return [(text, False, False)]
    upto(len(text))
    return out


def plain(text: str | None) -> str:
    """The text without its balanced marks."""
    return "".join(r[0] for r in runs(text))


def split_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, text, bold, underline: a row for each run.  Null and empty texts have none."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("underline", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"text": t, "bold": b, "underline": u} for t, b, u in runs(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], ["id", "runs"])

    listed = source.mapInArrow(run, f"id {kind}, runs array<struct<text:string,bold:boolean,underline:boolean>>")
    return listed.select(F.col("id").alias(id_col), F.posexplode("runs").alias("pos", "r")).select(id_col, "pos", "r.text", "r.bold", "r.underline")
