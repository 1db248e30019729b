"""Every registered query against its SQL, and what SQL cannot say against brute force."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folioloom.functions import text as fx
from folioloom.operators import bank, graph, interval, joins, rank, records, segment
from folioloom.plans import records as record_plans  # noqa: F401 - adds to the slate
from folioloom.plans import slate
from folioloom.sources import answers
from folioloom.streaming import windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(slate.SQL))
def test_query_matches_sql(spark, duck, name):
    df = slate.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    found = duck.sql(slate.SQL[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert got == Counter(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_longest_chain(spark):
    values = [5, 3, 4, 20, 16, 6, 7, 30, 8, 100, 108, 20]
    df = spark.createDataFrame([(k, i, v) for k in (1, 2) for i, v in enumerate(values)], "k long, o long, v long")

    def brute():
        best = [[1, v] for v in values]
        for i, v in enumerate(values):
            for j in range(i):
                if 1 <= v - values[j] <= 12 and best[j][0] + 1 > best[i][0]:
                    best[i] = [best[j][0] + 1, best[j][1]]
        i = max(range(len(values)), key=lambda i: (best[i][0], -i))
        return best[i][0], best[i][1], values[i]

    assert {(r.k, (r.length, r.first_value, r.last_value)) for r in segment.longest_chain(df, "k", "o", "v").collect()} == {(1, brute()), (2, brute())}


def test_row_clusters_keep_the_first_anchor(spark):
    df = spark.createDataFrame([("p", y, i) for i, y in enumerate([10.0, 12.0, 12.6, 14.9, 15.2])], "page string, y double, i int")
    assert [r.line for r in segment.row_clusters(df, ["page"], "y", ["i"], 2.5).orderBy("y").collect()] == [0, 0, 1, 1, 2]


def test_rows_without_a_place_are_in_no_line(spark):
    df = spark.createDataFrame([("p", y, i) for i, y in enumerate([None, 1.0, 50.0, 99.0, None])] + [("q", None, 9)], "page string, y double, i int")
    assert {r.i: r.line for r in segment.row_clusters(df, ["page"], "y", ["i"], 2.5).collect()} == {0: None, 4: None, 9: None, 1: 0, 2: 1, 3: 2}


def test_cells_that_would_run_as_formulae(spark):
    values = ["=1", " =1", "\u00a0+1", "\u200b@x", "\x00-1", "\t1", "\r=", "1=2", "a -b", " plain", ""]
    got = [r.c for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", fx.csv_cell(F.col("v")).alias("c")).orderBy("k").collect()]
    assert got == [f"\"'{v}\"" for v in values[:7]] + [f'"{v}"' for v in values[7:]]


def test_numbers_are_dense_over_sparse_values(spark):
    values = [-(10**17), 5, 6, 10**12, 10**17, 10**17 + 1]
    got = bank.numbered(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n").orderBy("v").collect()
    assert [(r.v, r.n) for r in got] == [(v, k) for k, v in enumerate(values, 1)]


def test_smallest_container_against_pairs(spark):
    import random

    rng = random.Random(4)
    boxes = [(k, k % 2, low, low + rng.randint(0, 40), rng.randint(0, 5)) for k in range(120) for low in [rng.randint(-30, 30)]]
    want = {}
    for a in boxes:
        over = [(b[4], b[0]) for b in boxes if b[1] == a[1] and b[2] <= a[2] and b[3] >= a[3] and b[4] > a[4]]
        if over:
            want[a[0]] = min(over)[1]
    got = interval.smallest_container(spark.createDataFrame(boxes, "k long, g long, low long, high long, area long"), "k", ["g"], "low", "high", "area")
    assert {r.k: r.parent for r in got.collect()} == want


def test_tokens_drop_particles_and_stop_words(spark):
    df = spark.createDataFrame([("질량과 길이의 측정값을 비교한다. The A-b mass",)], "t string")
    assert df.select(fx.tokens(F.col("t")).alias("x")).first().x == ["질량", "길이", "측정값", "비교한다", "mass"]


def test_ranking_fills_up_with_unrelated_rows(spark):
    q = spark.createDataFrame([(1, ["mass"]), (2, []), (3, None)], "q long, tokens array<string>")
    c = spark.createDataFrame([(0, ["plate"]), (1, ["mass", "length"])], "pos long, tokens array<string>")
    got = {(r.q, r.pos, r.score, r["rank"], r.confidence) for r in rank.rank_catalogue(q, c).collect()}
    assert got == {(1, 1, 9, 1, 66), (1, 0, 0, 2, 35), (2, 0, 0, 1, 35), (2, 1, 0, 2, 35), (3, 0, 0, 1, 35), (3, 1, 0, 2, 35)}


def test_intervals_and_bank_on_empty_tables(spark):
    none = spark.createDataFrame([], "k long, low long, high long")
    assert interval.coverage(none, ["k"], "low", "high").count() == 0
    assert bank.payload_ids(none, "low", "k").count() == 0


def test_clean_knows_document_spaces(spark):
    df = spark.createDataFrame([("﻿ a　 b \n",)], "t string")
    assert df.select(fx.clean(F.col("t")).alias("x")).first().x == "a b"


def test_answer_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('과목,구분,번호,정답,해설\n수학,미적분,23,0,"다른 설명"\n수학,기하,23,"ㄱ, ㄴ",설명\n국어,,1,"백두 산",본문\n')
    (tmp_path / "b.csv").write_text('번호,정답\n1,"0\n')
    (tmp_path / "c.csv").write_text("번호,정답\n1,\n2,0\n-1,③\n3,4,5\n0,2\n")
    rows = answers.read_answers(spark, str(tmp_path)).collect()
    at = {n: [r for r in rows if r.path.endswith(n)] for n in ("a.csv", "b.csv", "c.csv")}
    assert [(r.subject, r.section, r.number, r.value) for r in at["a.csv"]] == [("수학", "미적분", 23, "0"), ("수학", "기하", 23, "ㄱ, ㄴ"), ("국어", None, 1, "백두 산")]
    assert [r.value for r in at["b.csv"]] == [None]
    assert [(r.number, r.value) for r in at["c.csv"] if not r.warning] == [(2, "0")] and sum(bool(r.warning) for r in at["c.csv"]) == 4


def test_bank_replaces_one_source(spark, tmp_path):
    path = str(tmp_path / "bank")
    answers.save_bank(spark.createDataFrame([("a", 1), ("b", 1)], "source_id string, n int"), path)
    answers.save_bank(spark.createDataFrame([("a", 2), ("a", 3)], "source_id string, n int"), path)
    assert sorted((r.source_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 2), ("a", 3), ("b", 1)]


def test_components_against_union_find(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 21), (21, 3), (5, 5), (None, 1)] + [(k, k + 1) for k in range(100, 180)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    got = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert {(r.node, r.component) for r in got.collect()} == {(k, find(k)) for k in top}


def test_connected_components_takes_every_order(spark, tmp_path):
    orders = [(k, k * 7 % 11) for k in range(1, 60, 3)] + [(100, 80), (102, 41), (103, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    top = {k: k for o, c in orders if c % 40 for k in (o, o + c % 40)}
    for _ in top:
        for o, c in orders:
            if c % 40:
                top[o] = top[o + c % 40] = min(top[o], top[o + c % 40])
    got = slate.QUERIES["connected_components"](spark, str(tmp_path)).collect()
    assert {r.node: r.component for r in got} == top and len(got) == len(top)


def test_digests_of_long_urls_match_sql(spark, tmp_path):
    urls = [None, "", "é" * 40, *("http://example.com/" + "x" * n for n in (37, 38, 39, 96, 500))]
    pages = spark.createDataFrame([(k, u, u) for k, u in enumerate(urls)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = slate.QUERIES["digests"](spark, str(tmp_path)).select("page_id", "digest", "url_digest", "coded").collect()
    assert Counter(map(tuple, got)) == Counter(con.sql(slate.SQL["digests"]).fetchall())


def test_request_over_the_limit_is_refused(spark):
    df = spark.range(5)
    assert records.guard(df, 5, "rows").count() == 5 and records.guard(df.where("id > 9"), 5, "rows").count() == 0
    with pytest.raises(Exception, match="more than 4 rows"):
        records.guard(df, 4, "rows").collect()


def test_nearest_without_marks(spark):
    facts = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k long, at long, f string")
    marks = spark.createDataFrame([(1, 7, 70), (1, 3, 30), (1, 3, 29)], "k long, at long, mark long")
    assert {(r.f, r.mark) for r in joins.nearest(facts, marks, ["k"], "at", "mark").collect()} == {("a", 29), ("b", None)}


def test_stream_emits_the_windows_of_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.where("event_id < 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events.where("event_id >= 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.tumbling(stream, "ts", ["event_type"], "value", "1 hour").writeStream.format("parquet").outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    rows = lambda df: {tuple(r) for r in df.collect()}
    closed = rows(spark.read.parquet(str(tmp_path / "out")))
    whole = rows(windows.tumbling(events, "ts", ["event_type"], "value", "1 hour"))
    assert closed <= whole and len(whole) - len(closed) <= 2 * 5 and len(closed) > 500
