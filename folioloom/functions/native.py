"""Native equation scripts back to LaTeX: a bounded subset; whatever is unclear gives null, never a guess.

Fractions need braces on both sides (a ratio of two numbers may stand alone), roots and accents
a group or a single operand, scripts a base of their own.  Left scripts come as LSUB and LSUP, or as a
pair of numbers before an upright symbol.  Unknown words, degrees of roots, matrices and layout commands are outside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions import formula

#: Bounds of a script. Fixed values.
MOST_CHARS, MOST_TOKENS, MOST_DEPTH = 20_000, 4_000, 64
_FONTS = {"rm": "mathrm", "it": "mathit", "rmbold": "mathbf", "bold": "boldsymbol"}
_ACCENTS = {"BAR": "overline", "HAT": "hat", "VEC": "vec", "TILDE": "tilde", "DOT": "dot", "DDOT": "ddot", "UNDER": "underline", "CHECK": "check", "ACUTE": "acute", "GRAVE": "grave"}
_FENCES = {word: name for name, (word, _) in formula._DELIMITERS.items()}
#: Signs that are no words. Fixed values.
_SIGNS = {"!=": r"\ne", "+-": r"\pm", "-+": r"\mp", "<=": r"\le", ">=": r"\ge", "<<": r"\ll", ">>": r"\gg", "%": r"\%", "`": r"\,", "~": r"\,", "DEG": r"{}^{\circ}"}
#: What an upright font may join: elements and marks of atoms, then units and labels. Fixed values.
_ELEMENTS = set("""H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd
Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np
Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og A X Z D T""".split())
_LABELS = set("""mol mmol kmol atm Pa kPa MPa hPa mmHg mL dL kg mg cm mm nm km ms min MeV keV eV Hz kHz MHz kJ J W kW N m s g L K V A C cal kcal aq
pH pOH ATP ADP AMP NAD NADP NADH NADPH FAD FADH DNA RNA""".split())
#: Letters that stand for so many variables. Fixed values.
_LETTERS = set("""xy mv mg mgh mgd mgH mgx hc mE kL gh hf kg cm vt kd ct gd at ma Fd kx km al mal vx Ft aL kF eV hv pv He MeV Me Li Ba Kr Hz PQ BC AC
QS BS PV nRT RT nR CV LC gL mgL mr gt ad ab pq dv AB CD AD HA OH CO NH NaCl""".split())
_LAYOUT = set("BOX ROOT MATRIX PMATRIX BMATRIX DMATRIX CASES PILE LPILE RPILE EQALIGN ATOP CHOOSE COLOR PHANTOM".split())


_ATOMS = re.compile("(?:" + "|".join(sorted(_ELEMENTS, key=len, reverse=True)) + "){1,6}")


def _upright(token: str) -> bool:
    """What stands upright as one symbol: a letter, a unit or label, a compound of few atoms; never a layout word."""
    if len(token) == 1:
        return token.isascii() and token.isalpha()
    return (token in _LABELS or _ATOMS.fullmatch(token) is not None) and token.upper() not in _LAYOUT


def _vocabulary() -> dict[str, str]:
    words = {word: "\\" + name for name, (_, word) in reversed(formula._COMMANDS.items()) if word.isalpha()}
    return words | {name: "\\" + name for name in formula._FUNCTIONS}


_WORDS = _vocabulary()
_EXACT = set(_WORDS) | set(_ACCENTS) | set(_FONTS) | {"OVER", "SQRT", "LEFT", "RIGHT", "LSUB", "LSUP", "DEG", "DLINE", "LCEIL", "RCEIL", "LFLOOR", "RFLOOR"}
#: Words that may be written in any case: those where case makes no difference.
_FOLDED = {w.upper(): w for w in _EXACT if sum(x.upper() == w.upper() for x in _EXACT) == 1}


class _Outside(ValueError):
    pass


@dataclass
class _Item:
    """``kind``: base may carry scripts, number and group as well; sign, space and done may not."""

    latex: str
    kind: str


_LEXEME = re.compile(r"""
    (?P<space>\s+) | (?P<quoted>"[^"\r\n]*") | (?P<word>[A-Za-z]+) | (?P<number>[0-9]+(?:\.[0-9]+)?)
  | (?P<mark>!=|\+-|-\+|<=|>=|<<|>>|[{}_^*%()+\-=/.,:;!?<>|[\]`~]) | (?P<other>[^\x00-\x7f])
""", re.X)  # fmt: skip


def _worded(word: str) -> list[str]:
    """A run of letters as tokens: as it stands, in the case that the language knows, or a font with what it is glued to."""
    if word in _EXACT or _upright(word):
        return [word]
    known = _FOLDED.get(word.upper())
    if known:
        return [known]
    for font in sorted(_FONTS, key=len, reverse=True):
        if word.startswith(font) and _upright(word[len(font) :]):
            return [font, word[len(font) :]]
    return [word]


def _tokens(script: str) -> list[str]:
    out, at = [], 0
    for m in _LEXEME.finditer(script):
        if m.start() != at:
            break
        at = m.end()
        if m.lastgroup != "space":
            out += _worded(m[0]) if m.lastgroup == "word" else [m[0]]
    if at < len(script) or len(out) > MOST_TOKENS + 1:
        raise _Outside
    return out


#: What may follow an operand without braces, so that nothing after it could belong to it. Fixed values.
_ENDERS = {"", ")", "}", "]", "+", "-", "=", ",", "<", ">", "!=", "RIGHT"}
_WHOLE = re.compile(r"(?:[+\-−] ?)?\d+")


class _Grammar:
    """
    row     = { font | left pair | term [ OVER term ] [ scripts ] }
    scripts = { (^ | _ | LSUB | LSUP) operand }
    operand = { row } in braces | one symbol or number
    """

    def __init__(self, tokens: list[str]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    @property
    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def taken(self) -> str:
        if not self.next:
            raise _Outside
        self.at += 1
        return self.tokens[self.at - 1]

    def need(self, token: str) -> None:
        if self.taken() != token:
            raise _Outside

    def row(self, stop: str, font: str) -> str:
        """Items up to ``stop``, joined by spaces; a font holds to the end of its group."""
        if self.depth == MOST_DEPTH:
            raise _Outside
        self.depth += 1
        out: list[_Item] = []
        while self.next != stop:
            if self.next in _FONTS:
                font = _FONTS[self.taken()]
                if self.next == stop:
                    raise _Outside
                continue
            if self.next in ("^", "_"):
                out.append(self.left_pair(font))
                continue
            term = self.term(font)
            if self.next == "OVER":
                term = self.over(term, font, stop, first=not out or len(out) == 2 and out[1].latex == "=")
            out.append(self.with_scripts(term, font))
        self.depth -= 1
        return " ".join(x.latex for x in out)

    def braced(self, font: str) -> str:
        self.need("{")
        inside = self.row("}", font)
        self.need("}")
        return "{" + inside + "}"

    def over(self, top: _Item, font: str, stop: str, first: bool) -> _Item:
        """Groups on both sides, or two numbers that are the whole row or the whole right side of an equation."""
        self.need("OVER")
        if top.kind == "group" and self.next == "{":
            bottom = self.braced(font)
        elif top.kind == "number" and first and self.next[:1].isdigit():
            bottom = self.taken()
            if self.next != stop:
                raise _Outside
        else:
            raise _Outside
        return _Item(f"\\frac{{{top.latex}}}{{{bottom}}}", "done")

    def scripts(self, marks: tuple[str, ...], operand) -> dict[str, str]:
        """Each of the marks at most once, with its operand."""
        found: dict[str, str] = {}
        while self.next in marks:
            mark = self.taken()
            if mark in found:
                raise _Outside
            found[mark] = operand()
        return found

    def with_scripts(self, item: _Item, font: str) -> _Item:
        carries = item.kind in ("base", "number", "group")
        if self.next in ("LSUB", "LSUP"):
            found = self.scripts(("LSUB", "LSUP"), lambda: self.operand(font, braces=True))
            if not carries or item.latex == "{}" or self.next in ("^", "_"):
                raise _Outside
            left = [f"{mark}{{{found[word]}}}" for mark, word in (("_", "LSUB"), ("^", "LSUP")) if word in found]
            return _Item("{}" + "".join(left) + " " + item.latex, "done")
        if self.next not in ("^", "_") or item.kind in ("sign", "space"):
            return item  # after a sign they belong to what follows
        if not carries:
            raise _Outside
        found = self.scripts(("^", "_"), lambda: self.operand(font))
        if self.next in ("LSUB", "LSUP"):
            raise _Outside
        return _Item(item.latex + "".join(f"{mark}{{{x}}}" for mark, x in found.items()), "done")

    def operand(self, font: str, braces: bool = False) -> str:
        if self.next == "{":
            at = self.at
            inside = self.braced(font)
            if self.at == at + 3 and self.tokens[at + 1] in formula._FUNCTIONS:
                raise _Outside  # a function name alone is no script
            return inside
        symbol = len(self.next) == 1 and _upright(self.next) or self.next[:1].isdigit() or self.next in _WORDS and self.next not in formula._FUNCTIONS
        if braces or not symbol:
            raise _Outside
        return self.term(font).latex

    def left_pair(self, font: str) -> _Item:
        """Whole numbers below and above, with nothing before them, and the symbol that follows."""
        found = self.scripts(("^", "_"), lambda: self.braced(""))
        if len(found) < 2 or not all(_WHOLE.fullmatch(x[1:-1]) for x in found.values()):
            raise _Outside
        while self.next in _FONTS:
            font = _FONTS[self.taken()]
        if not (_upright(self.next) and (font or len(self.next) == 1)):
            raise _Outside
        below, above = found["_"], found["^"]
        return _Item(f"{{}}_{{{below}}}^{{{above}}} {self.term(font).latex}", "base")

    def single(self, font: str) -> str:
        """A group, or one operand after which something ends."""
        bare = self.next != "{"
        found = self.operand(font)
        if bare and self.next not in _ENDERS:
            raise _Outside
        return found

    def term(self, font: str) -> _Item:
        if self.next == "{":
            return _Item(self.braced(font), "group")
        token = self.taken()
        styled = (lambda x: f"\\{font}{{{x}}}") if font else (lambda x: x)
        if token == "SQRT" or token in _ACCENTS:
            return _Item(f"\\{_ACCENTS.get(token, 'sqrt')}{{{self.single(font)}}}", "done")
        if token == "LEFT":
            return self.fenced(font)
        if token in _SIGNS:
            return _Item(_SIGNS[token], "space" if token in "`~" else "sign")
        if token in _WORDS:
            return _Item(_WORDS[token], "base" if _carries(token) else "sign")
        if token[0] == '"':
            plain = token[1:-1].replace("\\", "")
            return _Item("\\text{" + "".join("\\" + c if c in "{}%$&#_" else c for c in plain) + "}", "base")
        if token[0].isdigit():
            return _Item(styled(token), "number")
        if len(token) == 1 and _upright(token) or font not in ("", "boldsymbol") and token.isascii() and _upright(token):
            return _Item(styled(token), "base")
        if token in _LETTERS:
            return _Item(" ".join(map(styled, token)), "base")
        if token in _PLAIN:
            return _Item(token, "base" if token in ")]|" else "sign")
        if re.fullmatch(r"[가-힣ㄱ-ㅎㅏ-ㅣ①-⑳㉠-㉿Ⅰ-Ⅻ]", token):
            return _Item(f"\\text{{{token}}}", "base")
        raise _Outside

    def fenced(self, font: str) -> _Item:
        left = _FENCES.get(self.taken())
        inside = self.row("RIGHT", font)
        self.need("RIGHT")
        right = _FENCES.get(self.taken())
        if left is None or right is None:
            raise _Outside
        return _Item(f"\\left{left} {inside} \\right{right}", "base")


#: Signs that stand for themselves.
_PLAIN = set("()+-=/.,:;!?<>|[]*")
#: Words other than letters and functions that carry scripts. Fixed values.
_LARGE = {"SUM", "PROD", "INT", "UNION", "INTER", "INF"}


def _carries(word: str) -> bool:
    """Whether a word may have scripts: functions, letters and large operators."""
    name = _WORDS[word][1:]
    return word in formula._FUNCTIONS or word in _LARGE or name.lower() in _GREEK


_GREEK = set("alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho sigma varsigma tau upsilon phi varphi chi psi omega".split())


def latex_of(script: str | None) -> str | None:
    """LaTeX of a native script; None if it is empty, too long or outside the subset."""
    if not script or not script.strip() or len(script) > MOST_CHARS:
        return None
    try:
        return _Grammar(_tokens(script)).row("", "") or None
    except _Outside:
        return None


def to_latex(df: DataFrame, id_col: str, script_col: str) -> DataFrame:
    """id and latex (null where the script is outside the subset)."""
    source = df.select(F.col(id_col).alias("id"), F.col(script_col).cast("string").alias("script"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(latex_of, batch.column(1).to_pylist()), pa.string())], ["id", "latex"])

    return source.mapInArrow(run, f"id {kind}, latex string").withColumnRenamed("id", id_col)
