"""Formulae: both equation languages, sizes, prose with formulae, damage."""

import re
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioloom.functions import formula as fm


@pytest.mark.parametrize(
    ("latex", "script"),
    [
        (r"k", "{it k}"),
        (r"7.25", "7.25"),
        (r"\mathrm{kg}", "{rm k} {rm g}"),
        (r"\mathbf{5}", "{rmbold 5}"),
        (r"p_q", "{{it p}} _ {{it q}}"),
        (r"p^{q+1}_r", "{{it p}} _ {{it r}} ^ {{it q} + 1}"),
        (r"f''", "{{it f}} ^ {′ ′}".replace("′", "prime")),
        (r"\dfrac{1}{\sqrt{5}}", "{1} OVER {SQRT {5}}"),
        (r"\sqrt[k]{8}", "ROOT {{it k}} OF {8}"),
        (r"{}_{1}^{3}\mathrm{H}", "{{rm H}} LSUB {1} LSUP {3}"),
        (r"40^\circ", "{40} ^ {CIRC}"),
        (r"^\circ\mathrm{C}", "DEG {rm C}"),
        (r"\prod\limits_k k", "PROD _ {{it k}} {it k}"),
        (r"\prod_k k", "{PROD} _ {{it k}} {it k}"),
        (r"\max\limits_t", "max _ {{it t}}"),
        (r"\left[\theta\right)", "LEFT [ theta RIGHT )"),
        (r"\left\langle u\right|", "LEFT < {it u} RIGHT |"),
        (r"\overrightarrow{OP}", "VEC {{it O} {it P}}"),
        (r"\underline{m}", "UNDER {{it m}}"),
        (r"\boxed{9}", "BOX {9}"),
        (r"\begin{bmatrix}1&2\end{bmatrix}", "LEFT [ MATRIX {{1} & {2}} RIGHT ]"),
        (r"\begin{cases}t&u\\v&w\end{cases}", "CASES {{{it t}} & {{it u}} # {{it v}} & {{it w}}}"),
        (r"\binom{5}{2}", "LEFT ( {{5} ATOP {2}} RIGHT )".replace("{{5} ATOP {2}}", "{5} ATOP {2}")),
        (r"\text{만약 a}\quad\%", '{rm "만약 a"} ```` "%"'),
        (r"\Gamma\varepsilon\lambda", "GAMMA varepsilon lambda"),
    ],
)
def test_native_script(latex, script):
    assert fm.native_script(latex) == script


ATOM = st.sampled_from(["a", "Z", "3", "41", r"\pi", r"\mathrm{mol}", r"\infty"])
LATEX = st.recursive(
    ATOM,
    lambda x: st.one_of(
        st.tuples(x, x).map(lambda p: f"{p[0]}+{p[1]}"), st.tuples(x, x).map(lambda p: rf"\frac{{{p[0]}}}{{{p[1]}}}"), x.map(lambda p: rf"\sqrt{{{p}}}"),
        st.tuples(ATOM, x).map(lambda p: f"{p[0]}^{{{p[1]}}}"), st.tuples(ATOM, x, x).map(lambda p: f"{p[0]}_{{{p[1]}}}^{{{p[2]}}}"), x.map(lambda p: rf"\left({p}\right)"),
        st.tuples(x, x).map(lambda p: rf"\sum\limits_{{{p[0]}}} {p[1]}"), x.map(lambda p: rf"\overline{{{p}}}"), st.tuples(x, x).map(lambda p: rf"\begin{{matrix}}{p[0]}&{p[1]}\end{{matrix}}"),
    ),
    max_leaves=8,
)


@settings(max_examples=200, deadline=None)
@given(LATEX)
def test_both_languages_are_well_formed(latex):
    script = fm.native_script(latex)
    assert script.count("{") == script.count("}") and len(re.findall(r"\bLEFT\b", script)) == len(re.findall(r"\bRIGHT\b", script))
    shown = re.sub(r"\\(begin|end)\{matrix\}|\\(frac|sqrt|left|right|sum|limits|overline|mathrm)|[{}_^&\s]", "", latex).replace(r"\pi", "π").replace(r"\infty", "∞")
    tree = _tree(latex)
    assert sorted(_text(tree)) == sorted(c for c in shown if c not in "()" or False)
    width, height, baseline = fm.measure(latex)
    assert 0 < baseline <= height and width > 0
    assert all(a <= b for a, b in zip(fm.measure(latex), fm.measure(rf"\boxed{{{latex}}}"), strict=True))


@pytest.mark.parametrize("latex", [None, "", " ", r"\frac{1}", r"\noSuch{x}", r"\color{red}{x}", "x^2^3", "{x", r"\left(x", r"\begin{matrix}a&b\\c\end{matrix}", "x" * 20_001, "{" * 100 + "}" * 100])
def test_refused(latex):
    with pytest.raises(fm.FormulaError):
        fm.native_script(latex)


def _tree(latex, **options):
    return ET.fromstring(fm.office_math(latex, **options).replace("<m:oMath>", '<m:oMath xmlns:m="m" xmlns:w="w">'))


def _text(tree):
    return "".join(t.text for t in tree.iter("{m}t"))


@pytest.mark.parametrize(
    ("latex", "text", "tags"),
    [
        (r"\frac{p}{q-1}", "pq−1", {"f": 1}),
        (r"\sqrt[4]{n}", "4n", {"rad": 1}),
        (r"t_0^2", "t02", {"sSubSup": 1}),
        (r"{}_{2}^{4}\mathrm{He}", "24He", {"sPre": 1}),
        (r"\int_0^1(u+v)w", "01(u+v)w", {"nary": 1}),
        (r"\prod_i\prod_j c", "ijc", {"nary": 2}),
        (r"\lim\limits_{h\to0}h", "limh→0h", {"limLow": 1}),
        (r"\underline{z}\hat{z}", "zz", {"bar": 1, "acc": 1}),
        (r"\boxed{\binom{4}{k}}", "4k", {"borderBox": 1, "f": 1, "d": 1}),
        (r"\begin{pmatrix}1\\2\\3\end{pmatrix}", "123", {"mr": 3, "d": 1}),
    ],
)
def test_office_math(latex, text, tags):
    tree = _tree(latex)
    assert _text(tree) == text
    assert {t: len(list(tree.iter("{m}" + t))) for t in tags} == tags


@pytest.mark.parametrize(("latex", "rest"), [(r"\sum_n n+1", ["r", "r"]), (r"\sum_n[(n)n]-2", ["r", "r"]), (r"\sum_n(n)^2=s", ["r", "r"]), (r"\sum_n\,n", [])])
def test_what_a_large_operator_applies_to(latex, rest):
    assert [c.tag.removeprefix("{m}") for c in _tree(latex)] == ["nary", *rest]


def test_measure():
    one, two = fm.measure("8"), fm.measure("88")
    assert two[0] > one[0] and two[1:] == one[1:]
    assert fm.measure("8", 20)[0] == pytest.approx(2 * one[0], abs=2)
    assert fm.measure(r"\frac{8}{8}")[1] > fm.measure("8^8")[1] > one[1]
    for points in (0, 101):
        with pytest.raises(fm.FormulaError):
            fm.measure("8", points)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["$", "$$", "(", "["]), st.sampled_from(["u", r"v^2", r"\frac{1}{w}"]), st.text(alphabet="xyz ,", min_size=1, max_size=5)), max_size=5))
def test_formulae_in_prose_come_back(parts):
    marks = {"$": ("$", "$"), "$$": ("$$", "$$"), "(": (r"\(", r"\)"), "[": (r"\[", r"\]")}
    text = "".join(marks[m][0] + f + marks[m][1] + prose for m, f, prose in parts)
    want = [row for m, f, prose in parts for row in ((f, True, m in ("$$", "[")), (prose, False, False))]
    assert fm.split_math(text) == want and fm.issues(text) == []


def test_what_is_no_formula_in_prose():
    for text in ("② $45", "③ $3,000\n④ $9.50", r"it costs \$5 and \$6", r"\frac{1} 2", r"\unknown{x}", r"left $ open \sqrt{2}"):
        assert fm.split_math(text) == [(text, False, False)]
    assert fm.split_math(r"take \sqrt[3]{8}^2 of it") == [("take ", False, False), (r"\sqrt[3]{8}^2", True, False), (" of it", False, False)]
    assert fm.split_math("a\\begin{cases}x&1\\end{cases}b")[1] == ("\\begin{cases}x&1\\end{cases}", True, True)
    assert fm.split_math(r"price \$1 $z$")[-1] == ("z", True, False) and fm.split_math(None) == [] == fm.issues(None)


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        ("one $ mark", ["latex_unbalanced"]), (r"a \left b", ["latex_outside_math"]), ("z^{k}", ["latex_outside_math"]), ("up\n | | \ndown", ["orphan_absolute_bars"]),
        (":::table\n| |\n| |\n:::", []), (r"$\frac{1}$", ["latex_syntax"]), ("bell\x07", ["invalid_control_character"]), ("<b>$q$</b>\ttab", []), (r"① $12", []),
    ],
)
def test_issues(text, codes):
    assert fm.issues(text) == codes


def test_columns(spark):
    df = spark.createDataFrame([(1, r"\frac12", "x"), (2, None, "y"), (None, "{", "z")], "k bigint, id string, extra string")
    rows = {r.k: r for r in fm.converted(df, "k", "id").collect()}
    assert rows[1].script == "{1} OVER {2}" and rows[1].error is None
    assert rows[2].script is None and rows[2].error and rows[None].error
    assert [tuple(r) for r in fm.spans(df.where("k = 1").selectExpr("k", "'a $b$' as id"), "k", "id").collect()] == [(1, 0, "a ", False, False), (1, 1, "b", True, False)]
    assert fm.converted(df.limit(0), "k", "id").count() == 0 == fm.spans(df.limit(0), "k", "id").count()
    assert fm.audited(df, "k", "id").where("size(issues) = 0").count() == 2  # of \\frac12, arguments stand bare outside a formula
