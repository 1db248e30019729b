"""Runs of bold and underlined text."""

from folioloom.functions import styled


def test_runs():
    assert styled.runs("a<b>c<u>d</u></b>[u]e[/u]f") == [("a", False, False), ("c", True, False), ("d", True, True), ("e", False, True), ("f", False, False)]
    for broken in ("<b>x", "x</b>", "<b><u>x</b></u>"):
        assert styled.runs(broken) == [(broken, False, False)]
    assert styled.runs(None) == [] == styled.runs("")
    assert styled.plain("a<b>c</b>") == "ac" and styled.plain("a<b>c") == "a<b>c" and styled.plain(None) == ""


def test_split_runs(spark):
    df = spark.createDataFrame([(1, "x<b>y</b>", 0), (None, None, 0), (2, "", 0)], "k int, t string, text int")
    assert sorted(tuple(r) for r in styled.split_runs(df, "k", "t").collect()) == [(1, 0, "x", False, False), (1, 1, "y", True, False)]
    assert styled.split_runs(df.limit(0), "k", "t").count() == 0
