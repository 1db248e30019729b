"""Readers, parsers and writers against fixed cases and round trips."""

import io
import zipfile
from email import message_from_bytes
from email.policy import default

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioloom.functions import markup
from folioloom.sources import keytext, outputs, package


def entries(text):
    return [(e["number"], e["value"], e.get("subject"), e.get("section")) for e in keytext.parse_key(text) if "warning" not in e]


def values(text):
    return [(n, v) for n, v, *_ in entries(text)]


def warnings(text):
    return [(e["line"], e["warning"]) for e in keytext.parse_key(text) if "warning" in e]


COMPACT = st.one_of(
    st.sampled_from("①②③④⑤ㄱㄴㄷABCabOX○×"), st.integers(-999, 999).map(str), st.tuples(st.integers(1, 99), st.integers(1, 99)).map(lambda x: f"{x[0]}/{x[1]}"),
    st.lists(st.sampled_from("①②③④⑤"), min_size=2, max_size=4).map(", ".join), st.decimals(0, 99, places=2).map(str),
)
KEY = st.lists(st.tuples(st.integers(1, 999_999), COMPACT), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(KEY, st.sampled_from(["{} {}", "{}. {}", "{}) {}", "{}번 {}", "문항{}: {}", "{} 정답: {}", "문제{} [정답] {}"]), st.sampled_from(["\n", "\r\n", "\n\n"]))
def test_key_lines_come_back(key, shape, end):
    assert values(end.join(shape.format(n, v) for n, v in key)) == [(n, v) for n, v in key]
    assert [x[2:] for x in entries("영어\n" + end.join(shape.format(n, v) for n, v in key))] == [("영어", None)] * len(key)


@settings(max_examples=100, deadline=None)
@given(KEY, st.sampled_from(["\t", " | "]))
def test_key_tables_come_back(key, bar):
    across = bar.join(["번호", *(str(n) for n, _ in key)]) + "\n" + bar.join(["답안", *(v for _, v in key)])
    down = bar.join(["subject", "question", "answer"]) + "\n" + "\n".join(bar.join(["화학", str(n), v]) for n, v in key)
    assert values(across) == list(key) and entries(down) == [(n, v, "화학", None) for n, v in key]
    short = across.rsplit(bar.strip(" ") if bar == "\t" else bar, 1)[0]
    if len(key) > 1:
        assert [w for _, w in warnings(short)] == ["numbers and answers differ in count"] and values(short) == []


@pytest.mark.parametrize("line", ["7", "12 / 30", "페이지 3", "3.25", "4. 옳은 것을 모두 고르면?", "2.75 m 떨어진 곳에서", "0 ③", "1234567 ②", "- 14 -"])
def test_key_lines_that_hold_no_answer(line):
    assert keytext.parse_key(line) == []


def test_key_scopes():
    assert entries("선택과목: 기하\n28 3\n생명과학Ⅱ\n2 ④ 3 ①") == [(28, "3", None, "기하"), (2, "④", "생명과학Ⅱ", None), (3, "①", "생명과학Ⅱ", None)]
    assert entries("[국어 영역]\n1 ②\n국어 (언어와 매체) 정답\n36 ⑤") == [(1, "②", "국어", None), (36, "⑤", "국어", "언어와 매체")]
    assert values(None) == values("") == values(" \n\t") == []


def test_key_explanations_hold_labelled_answers_only():
    text = "1 ④\n풀이과정\n2 ③\n3 답: ⑤\n4 정답 ② 풀이: 길다\n빠른 정답\n5 ①"
    assert values(text) == [(1, "④"), (3, "⑤"), (5, "①")]


def test_key_warnings(spark, tmp_path):
    assert warnings("번호 8 9\n\uf000 \uf001\n① ②") == [(2, "unreadable glyph")]
    assert warnings("번호 8 9") == [(1, "numbers without answers")]
    assert warnings("3 정답: " + "가" * 501) == [(1, "no certain answer")] and warnings("3 정답: " + "가" * 500) == []
    (tmp_path / "a.txt").write_text("문항\t6\t7\n정답\t㉠은 산화\t-2")
    (tmp_path / "b.txt").write_text("no key at all")
    assert [(r.line, r.number, r.value, r.warning) for r in keytext.read_keys(spark, str(tmp_path)).orderBy("number").collect()] == [(2, 6, "㉠은 산화", None), (2, 7, "-2", None)]


CELL = st.text(alphabet="ab 1가\\-:", max_size=6).map(lambda x: x.strip().rstrip("\\").strip())


@settings(max_examples=200, deadline=None)
@given(st.lists(CELL, min_size=1, max_size=16))
def test_cells_come_back(row):
    assert markup.cells("| " + " | ".join(row) + " |") == row
    assert markup.cells("  |" + "|".join(f"{c}$p|q$" for c in row) + "|") == [f"{c}$p|q$" for c in row]


def test_cells_of_rows_that_are_none():
    assert markup.cells("| never $closed | x |") is None is markup.cells("|") is markup.cells("a | b")
    assert markup.cells("|" * 17) is not None and markup.cells("|" * 18) is None
    assert markup.cells(r"| \| | one<br>two | $7.50 USD |") == ["|", "one\ntwo", "$7.50 USD"]


LINE = st.sampled_from(["", "word", ":::box", ":::box note", ":::table", ":::table sizes", ":::", "| p | q |", "| r | s |", "|---|:-:|", "| t |", "::: x"])


@settings(max_examples=300, deadline=None)
@given(st.lists(LINE, max_size=12))
def test_blocks_hold_every_line_once(lines):
    found = markup.blocks("\n".join(lines))
    left = list(lines or [""])
    for b in found:
        if b["kind"] == "text":
            part = b["text"].split("\n")
        elif b["kind"] == "box":
            part = [left[0], *b["text"].split("\n"), ":::"]
            assert left[0].split(" ")[0] == ":::box"
        else:
            assert len(set(map(len, b["rows"]))) == 1
            stop = left.index(":::") + 1 if left[0].startswith(":::") else next((k for k, x in enumerate(left) if not x.startswith("|")), len(left))
            part = left[:stop]
        assert left[: len(part)] == part
        del left[: len(part)]
    assert not left


def test_blocks_of_each_kind():
    text = "before\n:::table t\n| p |\n\n| q |\n:::\n:::box outer\n:::box\nx\n:::\n:::\n| k | v |\n|:---|---:|\n| 1 | 2 |\nafter"
    assert [(b["kind"], b["title"], b["rows"], b["header"]) for b in markup.blocks(text)] == [
        ("text", None, None, None), ("table", "t", [["p"], ["q"]], False), ("box", "outer", None, None), ("table", "", [["k", "v"], ["1", "2"]], True), ("text", None, None, None)]
    for whole in (":::box\nopen for ever", ":::table\n| a |\n| a | b |\n:::", "| a | b |\n|---|---|\n| c |", ":::box\n:::table\nno row\n:::\n:::", ":::box\n\n:::"):
        assert [(b["kind"], b["text"]) for b in markup.blocks(whole)] == [("text", whole)]


def test_blocks_as_a_table(spark):
    df = spark.createDataFrame([(1, "a\n| x |\n|---|\n| y |"), (2, None)], "k long, t string")
    rows = {r.k: r.blocks for r in markup.parsed(df, "k", "t").collect()}
    assert [b.kind for b in rows[1]] == ["text", "table"] and rows[1][1].rows == [["x"], ["y"]] and rows[2][0].text == ""


HEADER = '<hh:head xmlns:hh="urn:head"><hh:charPr id="0"><hh:bold/><hh:underline type="BOTTOM"/></hh:charPr></hh:head>'


def section(body):
    return f'<?xml version="1.0" encoding="UTF-8"?><hs:sec xmlns:hs="urn:sec" xmlns:hp="urn:paragraph">{body}</hs:sec>'


def paragraph(text):
    return f'<hp:p id="42"><hp:run charPrIDRef="0"><hp:t>{text}</hp:t></hp:run></hp:p>'


def test_package(spark):
    cell = lambda text, row, column: f'<hp:tc><hp:subList>{paragraph(text)}</hp:subList><hp:cellAddr rowAddr="{row}" colAddr="{column}"/><hp:cellSpan rowSpan="1" colSpan="2"/></hp:tc>'
    table = f"<hp:p><hp:run><hp:tbl><hp:tr>{cell('a', 0, 0)}</hp:tr><hp:tr>{cell('b', 1, 0)}</hp:tr></hp:tbl></hp:run></hp:p>"
    good = outputs.packed([("Contents/header.xml", HEADER.encode()), ("Contents/section10.xml", section(paragraph("last")).encode()), ("Contents/section2.xml", section(paragraph("1. 가 &amp; 나<hp:lineBreak/>둘째 줄<hp:tab/>끝") + table).encode())])
    bad = {"entity": outputs.packed([("Contents/section0.xml", b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')]), "path": outputs.packed([("../x", b"")]), "none": b"", "cut": good[:-30]}
    df = spark.createDataFrame([("good", good), *bad.items()], "name string, content binary")
    rows = package.unpacked(df, "name", "content").collect()
    at = sorted((r for r in rows if r.name == "good"), key=lambda r: r.ord)
    assert [(r.section, r.kind) for r in at] == [(2, "text"), (2, "table"), (10, "text")]
    assert at[0].text == "1. 가 & 나\n둘째 줄\t끝" and at[0].styled == f"<b><u>{at[0].text}</u></b>"
    assert [(c.row, c.column, c.column_span, c.text) for c in at[1].cells] == [(0, 0, 2, "a"), (1, 0, 2, "b")]
    assert {r.name for r in rows if r.error} == set(bad) and len(rows) == 3 + len(bad)


def test_documents_read_back(spark, tmp_path):
    df = spark.createDataFrame([("g", 2, "x\ty\nz & <w>"), ("g", 1, None), ("h", 1, "한글")], "g string, o int, t string")
    for r in outputs.documents(df, "g", "o", "t").collect():
        (tmp_path / f"{r.g}.docx").write_bytes(r.content)
    rows = package.read_packages(spark, str(tmp_path)).orderBy("path", "ord").collect()
    assert [(r.path[-6:-5], r.text) for r in rows] == [("g", ""), ("g", "x\ty\nz & <w>"), ("h", "한글")]


def test_archives_and_csv(spark):
    df = spark.createDataFrame([("g", 2, "=1+1", "b"), ("g", 1, 'say "x"', None), ("h", 1, "plain", "c")], "g string, o int, v string, w string")
    texts = {r.g: r.content for r in outputs.answer_csv(df, "g", "o", ["v", "w"]).collect()}
    assert texts["g"] == '﻿"v","w"\r\n"say ""x""",""\r\n"\'=1+1","b"\r\n'
    made = {r.g: r.content for r in outputs.archives(df, "g", "o", "v").collect()}
    with zipfile.ZipFile(io.BytesIO(made["g"])) as z:
        assert z.namelist() == ["1", "2"] and z.read("2") == b"=1+1" and z.testzip() is None
    with pytest.raises(ValueError, match="exceed"):
        outputs.archives(df, "g", "o", "v", 8)


def test_review_round_trip(spark):
    df = spark.createDataFrame([("s", 2, "b", 1.5), ("s", 1, "a", None)], "s string, n int, text string, score double")
    texts = outputs.review_json(df, "s", "n", ["n", "text", "score"])
    back = outputs.read_review(texts, "content", "struct<n:int,text:string,score:double>")
    assert [(r.s, r.ord, r.q.n, r.q.text, r.q.score) for r in back.orderBy("ord").collect()] == [("s", 0, 1, "a", None), ("s", 1, 2, "b", 1.5)]
    old = texts.selectExpr("s", """replace(content, '"version":1', '"version":9') as content""")
    with pytest.raises(Exception, match="unknown version"):
        outputs.read_review(old, "content", "struct<n:int>").collect()


def test_draft(spark):
    df = spark.createDataFrame([("a@example.org", "제목\r\nBcc: x", "body", "f.bin", b"\x00\x01"), ("a@example.org", "s", None, None, None)], "t string, s string, b string, n string, a binary")
    one, two = [message_from_bytes(r.m, policy=default) for r in df.select(outputs.draft(*map(F.col, "tsbna")).alias("m")).collect()]
    assert one["Subject"] == "제목 Bcc: x" and one["Bcc"] is None
    assert next(one.iter_attachments()).get_content() == b"\x00\x01" and not two.is_multipart()
