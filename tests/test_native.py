"""Native equation scripts read as LaTeX, and back."""

import pytest

from folioloom.functions import formula, native


@pytest.mark.parametrize(
    ("script", "latex"),
    [
        ("{1} over {2} v = {3} over {4}", r"\frac{{1}}{{2}} v = \frac{{3}}{{4}}"),
        ("x^{-1}", "x^{{- 1}}"),
        ("{{a} over {b}}^2", r"{\frac{{a}}{{b}}}^{2}"),
        ("1 over 2", r"\frac{1}{2}"),
        ("rm H LSUB {1} LSUP {2}", r"{}_{{\mathrm{1}}}^{{\mathrm{2}}} \mathrm{H}"),
        ("Y+ _{0}^{1} rm n", r"Y + {}_{{0}}^{{1}} \mathrm{n}"),
        ("rmNaCl", r"\mathrm{NaCl}"),
        ("mgh", "m g h"),
        ("rm In", r"\mathrm{In}"),
        ("sqrt {x}", r"\sqrt{{x}}"),
        ("LEFT ( {a} OVER {b} RIGHT )", r"\left( \frac{{a}}{{b}} \right)"),
        ('"값" <= alpha', r"\text{값} \le \alpha"),
    ],
)
def test_latex_of(script, latex):
    assert native.latex_of(script) == latex


@pytest.mark.parametrize("script", [None, "", " ", "a+b over c", "E _{max}", "x^-1", "A + ^{2}", "A+_{x}^{y} B", "x LSUB {1} LSUB {2}", "{} LSUB {1}", "+_{0}^{1}", "+_{0}^{1} UNKNOWN", "unknownword", "{x", "x}", "rmMATRIX", "ROOT {3} OF {x}", "x" * 20_001, "{" * 100 + "}" * 100, "x^2^3", "LEFT ( x"])
def test_outside(script):
    assert native.latex_of(script) is None


@pytest.mark.parametrize("latex", [r"\frac{a+\frac{b}{c}}{d}", r"\sqrt{x}+y", r"x_{i_j}^{n^2}", r"{}^{14}_{6}\mathrm{C}", r"\left(\frac12\right)", r"\alpha\le\beta", r"\overline{AB}"])
def test_round_trip(latex):
    script = formula.native_script(latex)
    back = native.latex_of(script)
    assert back is not None
    assert formula.native_script(back).replace("{", "").replace("}", "").split() == script.replace("{", "").replace("}", "").split()


def test_column(spark):
    df = spark.createDataFrame([(1, "x", 0), (None, None, 0), (1, "nope", 0)], "k int, s string, latex int")
    assert sorted((r.k or 0, r.latex or "") for r in native.to_latex(df, "k", "s").collect()) == [(0, ""), (1, ""), (1, "x")]
    assert native.to_latex(df.limit(0), "k", "s").count() == 0
