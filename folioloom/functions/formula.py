"""LaTeX formulae: a bounded grammar, native equation scripts, Office math, and formulae inside prose.

``parse`` reads a subset of LaTeX into a small tree or raises ``FormulaError``;
nothing unknown passes as literal text.  ``native_script`` and ``office_math``
write the tree in the two equation languages, ``measure`` estimates its size.
``split_math`` cuts prose at its formulae; ``issues`` names what looks damaged.
``converted``, ``spans`` and ``audited`` apply these to a text column in Arrow batches;
null or empty formulae give an error row, null texts no parts and no issues.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import escape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions import markup

#: Bounds of a formula. Fixed values.
MOST_CHARS, MOST_DEPTH, MOST_ROWS, MOST_COLUMNS = 20_000, 64, 64, 32

#: Greek letters by the name that LaTeX and the native language share; the character follows from it. Fixed values.
_GREEK = """alpha beta gamma delta zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon chi psi omega""".split()
_CAPITALS = "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()
#: Letters that stand apart from their Unicode name. Fixed values.
_VARIANTS = {"epsilon": "ϵ", "varepsilon": "ε", "vartheta": "ϑ", "varpi": "ϖ", "varsigma": "ς", "phi": "ϕ", "varphi": "φ"}

#: Signs by LaTeX command: character, native word. Fixed values.
_SIGNS = {
    # arrows
    "Leftarrow": ("⇐", "LARROW"),
    "Leftrightarrow": ("⇔", "LRARROW"),
    "Rightarrow": ("⇒", "RARROW"),
    "downarrow": ("↓", "downarrow"),
    "leftarrow": ("←", "larrow"),
    "leftrightarrow": ("↔", "lrarrow"),
    "mapsto": ("↦", "MAPSTO"),
    "rightarrow": ("→", "rarrow"),
    "to": ("→", "rarrow"),
    "uparrow": ("↑", "uparrow"),
    # relations
    "approx": ("≈", "APPROX"),
    "cong": ("≅", "CONG"),
    "equiv": ("≡", "IDENTICAL"),
    "ge": ("≥", "GEQ"),
    "geq": ("≥", "GEQ"),
    "gg": ("≫", ">>"),
    "le": ("≤", "LEQ"),
    "leq": ("≤", "LEQ"),
    "ll": ("≪", "<<"),
    "mid": ("∣", "|"),
    "ne": ("≠", "!="),
    "neq": ("≠", "!="),
    "perp": ("⊥", "BOT"),
    "propto": ("∝", "PROPTO"),
    "sim": ("∼", "SIM"),
    "simeq": ("≃", "SIMEQ"),
    # sets and logic
    "because": ("∵", "BECAUSE"),
    "cap": ("∩", "SMALLINTER"),
    "cup": ("∪", "CUP"),
    "emptyset": ("∅", "EMPTYSET"),
    "exists": ("∃", "EXIST"),
    "forall": ("∀", "FORALL"),
    "in": ("∈", "IN"),
    "neg": ("¬", "LNOT"),
    "ni": ("∋", "OWNS"),
    "notin": ("∉", "NOTIN"),
    "subset": ("⊂", "SUBSET"),
    "subseteq": ("⊆", "SUBSETEQ"),
    "supset": ("⊃", "SUPERSET"),
    "supseteq": ("⊇", "SUPSETEQ"),
    "therefore": ("∴", "THEREFORE"),
    "vee": ("∨", "LOR"),
    "wedge": ("∧", "WEDGE"),
    # operations
    "ast": ("∗", "AST"),
    "bullet": ("∙", "BULLET"),
    "cdot": ("⋅", "CDOT"),
    "circ": ("∘", "CIRC"),
    "div": ("÷", "DIVIDE"),
    "mp": ("∓", "-+"),
    "odot": ("⊙", "ODOT"),
    "oplus": ("⊕", "OPLUS"),
    "otimes": ("⊗", "OTIMES"),
    "pm": ("±", "+-"),
    "times": ("×", "TIMES"),
    # large operators
    "bigcap": ("⋂", "INTER"),
    "bigcup": ("⋃", "UNION"),
    "coprod": ("∐", "COPROD"),
    "iiint": ("∭", "TINT"),
    "iint": ("∬", "DINT"),
    "int": ("∫", "INT"),
    "oint": ("∮", "OINT"),
    "prod": ("∏", "PROD"),
    "sum": ("∑", "SUM"),
    # others
    "angle": ("∠", "ANGLE"),
    "cdots": ("⋯", "CDOTS"),
    "ddots": ("⋱", "DDOTS"),
    "dots": ("…", "LDOTS"),
    "ell": ("ℓ", "LITER"),
    "hbar": ("ℏ", "hbar"),
    "infty": ("∞", "INF"),
    "ldots": ("…", "LDOTS"),
    "nabla": ("∇", "NABLA"),
    "partial": ("∂", "PARTIAL"),
    "prime": ("′", "prime"),
    "triangle": ("△", "TRIANGLE"),
    "vdots": ("⋮", "VDOTS"),
}


def _greek() -> dict[str, tuple[str, str]]:
    named = {n: unicodedata.lookup(f"GREEK SMALL LETTER {'LAMDA' if n == 'lambda' else n}") for n in _GREEK} | _VARIANTS
    capitals = {n: unicodedata.lookup(f"GREEK CAPITAL LETTER {'LAMDA' if n == 'Lambda' else n}") for n in _CAPITALS}
    return {n: (c, n) for n, c in named.items()} | {n: (c, n.upper()) for n, c in capitals.items()}


_COMMANDS = _SIGNS | _greek()
_WORDS = {char: word for char, word in _COMMANDS.values()} | {"−": "-", "·": "CDOT", "°": "DEG"}
_LARGE = set("∑∏∐∫∬∭∮⋃⋂")
_FUNCTIONS = set("sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth log ln lg exp max min lim det gcd arg dim ker Pr".split())
_STACKING = {"lim", "max", "min"}
#: LaTeX accents: native word, Office character (bar: a line above). Fixed values.
_ACCENTS = {
    "overline": ("BAR", "bar"), "bar": ("BAR", "bar"), "hat": ("HAT", "̂"), "widehat": ("HAT", "̂"), "check": ("CHECK", "̌"),
    "tilde": ("TILDE", "̃"), "widetilde": ("TILDE", "̃"), "acute": ("ACUTE", "́"), "grave": ("GRAVE", "̀"), "dot": ("DOT", "̇"),
    "ddot": ("DDOT", "̈"), "vec": ("VEC", "⃗"), "overrightarrow": ("VEC", "⃗"), "overleftrightarrow": ("DYAD", "⃡"), "underline": ("UNDER", "under"),
}
#: Delimiters after \left and \right: native word, character. Fixed values.
_DELIMITERS = {
    "(": ("(", "("), ")": (")", ")"), "[": ("[", "["), "]": ("]", "]"), "\\{": ("{", "{"), "\\}": ("}", "}"), "|": ("|", "∣"), "\\|": ("DLINE", "∥"),
    "\\langle": ("<", "⟨"), "\\rangle": (">", "⟩"), "\\lceil": ("LCEIL", "⌈"), "\\rceil": ("RCEIL", "⌉"), "\\lfloor": ("LFLOOR", "⌊"), "\\rfloor": ("RFLOOR", "⌋"), ".": (".", ""),
}
_FONTS = {"mathrm": "rm", "operatorname": "rm", "mathit": "it", "mathbf": "rmbold", "boldsymbol": "bold"}
#: Widths of explicit spaces in em. Fixed values.
_SPACES = {",": 1 / 6, ":": 2 / 9, ";": 5 / 18, " ": 1 / 4, "quad": 1.0, "qquad": 2.0}
_MATRICES = {"matrix": None, "array": None, "pmatrix": "()", "bmatrix": "[]", "vmatrix": "||", "cases": "{."}
_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[0-9]+(?:[.,][0-9]+)*|\s+|.", re.S)


class FormulaError(ValueError):
    """A formula that the grammar does not cover."""


@dataclass
class Node:
    """``kind`` says which of the other fields count."""

    kind: str  # row, letter, number, sign, name, text, space, frac, root, script, fence, accent, table, box
    text: str = ""
    parts: list = field(default_factory=list)
    font: str | None = None
    flag: bool = False


class _Reader:
    def __init__(self, latex: str, display: bool):
        self.tokens = _TOKEN.findall(latex)
        self.at, self.depth, self.display = 0, 0, display or bool(re.search(r"\\limits(?![A-Za-z])", latex))

    def peek(self) -> str | None:
        while self.at < len(self.tokens) and self.tokens[self.at].isspace():
            self.at += 1
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if token is None or wanted and token != wanted:
            raise FormulaError(f"expected {wanted or 'more'}")
        self.at += 1
        return token

    def row(self, stops: tuple, font: str | None) -> Node:
        """Items up to one of ``stops``, which stays unread; None among them allows the end."""
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise FormulaError("too deep")
        out: list[Node] = []
        while (token := self.peek()) not in stops:
            if token is None:
                raise FormulaError("unclosed")
            if token in "^_'":
                base = out.pop() if out else Node("row")
                out.append(self.scripts(base, font))
            else:
                out.append(self.item(font))
        self.depth -= 1
        return Node("row", parts=out)

    def scripts(self, base: Node, font: str | None) -> Node:
        found: dict[str, Node] = {}
        while (token := self.peek()) in ("^", "_", "'"):
            self.at += 1
            key = "^" if token == "'" else token
            if key in found:
                raise FormulaError("double script")
            if token == "'":
                marks = 1
                while self.peek() == "'":
                    self.at, marks = self.at + 1, marks + 1
                found[key] = Node("row", parts=[Node("sign", "′")] * marks)
            else:
                found[key] = self.argument(font)
        large = base.kind == "sign" and base.text in _LARGE or base.kind == "name" and base.text in _STACKING
        stacked = large and (base.flag or self.display and base.text not in "∫∬∭∮")
        return Node("script", parts=[base, found.get("_"), found.get("^")], flag=stacked)

    def argument(self, font: str | None) -> Node:
        token = self.peek()
        if token == "{":
            self.at += 1
            inside = self.row(("}",), font)
            self.take("}")
            return inside
        if token and token[0].isdigit() and len(token) > 1:  # one digit only
            self.tokens[self.at] = token[1:]
            return Node("number", token[0], font=font)
        return self.item(font)

    def raw(self) -> str:
        """The characters of a braced group, as they stand."""
        self.take("{")
        start, level = self.at, 1
        while level:
            if self.at >= len(self.tokens):
                raise FormulaError("unclosed text")
            level += {"{": 1, "}": -1}.get(self.tokens[self.at], 0)
            self.at += 1
        return "".join(self.tokens[start : self.at - 1])

    def item(self, font: str | None) -> Node:
        token = self.take()
        if token == "{":
            self.at -= 1
            return self.argument(font)
        if token[0].isdigit():
            return Node("number", token, font=font)
        if token[0] != "\\":
            if token.isascii() and token.isalpha():
                return Node("letter", token, font=font)
            if token == "|":
                return Node("letter", "|", font="rm")
            if token in "+=:;,.!?/()[]<>*" or token in _WORDS:
                return Node("sign", token)
            if token == "-":
                return Node("sign", "−")
            if re.match(r"[ᄀ-ᇿ㄰-㆏가-힯Ⅰ-ⅿ]", token):
                return Node("text", token)
            raise FormulaError(f"character {token}")
        name = token[1:]
        if name in _SPACES:
            return Node("space", name)
        if name in "%&#{}_":
            return Node("text" if name in "%&#_" else "sign", name)
        if name in _COMMANDS:
            node = Node("sign", _COMMANDS[name][0])
            return self.limits(node)
        if name in _FUNCTIONS:
            return self.limits(Node("name", name))
        if name in _FONTS:
            return self.argument(_FONTS[name])
        if name in ("text", "textrm", "mbox"):
            return Node("text", self.raw(), flag=True)
        if name in ("frac", "dfrac", "tfrac", "binom"):
            halves = [self.argument(font), self.argument(font)]
            body = Node("frac", parts=halves, flag=name != "binom")
            return body if body.flag else Node("fence", "()", [body])
        if name == "sqrt":
            degree = None
            if self.peek() == "[":
                self.at += 1
                degree = self.row(("]",), font)
                self.take("]")
            return Node("root", parts=[self.argument(font), degree])
        if name in _ACCENTS:
            return Node("accent", name, [self.argument(font)])
        if name in ("boxed", "fbox"):
            return Node("box", parts=[self.argument(font) if name == "boxed" else Node("text", self.raw(), flag=True)])
        if name == "left":
            left = self.delimiter()
            inside = self.row(("\\right",), font)
            self.take("\\right")
            right = self.delimiter()
            if (left, right) == ("\\{", ".") and len(inside.parts) == 1 and inside.parts[0].kind == "table":
                return self.table_of_cases(inside.parts[0])
            return Node("fence", parts=[inside], font=f"{left} {right}")
        if name == "begin":
            return self.table(self.raw(), font)
        raise FormulaError(f"command {token}")

    def limits(self, node: Node) -> Node:
        while self.peek() in ("\\limits", "\\nolimits"):
            node.flag = self.take() == "\\limits"
        return node

    def delimiter(self) -> str:
        token = self.take()
        if token not in _DELIMITERS:
            raise FormulaError(f"delimiter {token}")
        return token

    @staticmethod
    def table_of_cases(table: Node) -> Node:
        table.flag = True
        return table

    def table(self, name: str, font: str | None) -> Node:
        if name not in _MATRICES:
            raise FormulaError(f"environment {name}")
        if name == "array" and set(self.raw()) - set("c "):
            raise FormulaError("alignment")
        rows: list[list[Node]] = [[]]
        while True:
            rows[-1].append(self.row(("&", "\\\\", "\\end"), font))
            mark = self.take()
            if mark == "\\end":
                break
            if mark == "\\\\":
                rows.append([])
        if self.raw() != name:
            raise FormulaError("environment ends by another name")
        if len(rows) > 1 and len(rows[-1]) == 1 and not rows[-1][0].parts:
            rows.pop()
        width = len(rows[0])
        if len(rows) > MOST_ROWS or width > MOST_COLUMNS or any(len(r) != width for r in rows) or name == "cases" and width != 2:
            raise FormulaError("table shape")
        body = Node("table", parts=rows, flag=name == "cases")
        around = _MATRICES[name]
        return Node("fence", parts=[body], font=" ".join(around)) if around and not body.flag else body


def parse(latex: str | None, display: bool = False) -> Node:
    """The tree of a formula; FormulaError if it is empty, too long or outside the grammar."""
    if not latex or not latex.strip() or len(latex) > MOST_CHARS or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", latex):
        raise FormulaError("empty, too long or damaged")
    tree = _Reader(latex, display).row((None,), None)
    if not tree.parts:
        raise FormulaError("nothing to show")
    return tree


#: Sizes in em. Fixed values.
_EM = {
    "glyph": 0.58, "name letter": 0.56, "narrow": 0.35, "wide": 1.0, "large": 1.0, "relation": 0.95, "degree": 0.4,
    "up": 0.8, "down": 0.2, "large up": 1.05, "large down": 0.35,
    "script scale": 0.7, "raise": 0.5, "lower": 0.35, "limit gap": 0.15,
    "bar": 0.35, "bar up": 0.4, "bar down": 0.2, "root": 0.7, "root up": 0.25, "root degree": 0.4,
    "fence": 0.5, "accent": 0.25, "frame": 0.6, "frame edge": 0.2,
    "row gap": 0.3, "column gap": 0.8, "brace": 0.5, "axis": 0.25,
}


class Out(NamedTuple):
    """A part of a formula in both languages, with its width, and its height above and below the line, in em."""

    script: str
    office: str
    width: float = 0.0
    up: float = 0.0
    down: float = 0.0


_NOTHING = Out("", "")


def _tagged(tag: str, *inside: str) -> str:
    return f"<m:{tag}>{''.join(inside)}</m:{tag}>"


def _looks(tag: str, **values) -> str:
    """Properties of an Office element."""
    return _tagged(f"{tag}Pr", *(f'<m:{k} m:val="{escape(str(v))}"/>' for k, v in values.items()))


@lru_cache(maxsize=50_000)
def _text_run(text: str, upright: bool, plain: bool = False, bold: bool = False) -> str:
    style = "b" if bold else "p" if upright else "i"
    math_look = "<m:nor/>" if plain else f'<m:scr m:val="roman"/><m:sty m:val="{style}"/>'
    word_look = '<w:rFonts w:ascii="Cambria Math" w:hAnsi="Cambria Math"/>' + "<w:b/>" * bold + (f'<w:i w:val="{int(not upright)}"/>' if plain else "")
    return f'<m:r><m:rPr>{math_look}</m:rPr><w:rPr>{word_look}</w:rPr><m:t xml:space="preserve">{escape(text)}</m:t></m:r>'


def _glyphs(script: str, office: str, width: float, kind: str = "") -> Out:
    return Out(script, office, width, _EM[f"{kind}up"], _EM[f"{kind}down"])


def _group(x: str) -> str:
    return "{" + x + "}"


def _letter(node: Node) -> Out:
    upright, bold = node.font in ("rm", "rmbold"), node.font in ("rmbold", "bold")
    return _glyphs(_group(f"{node.font or 'it'} {node.text}"), _text_run(node.text, upright, plain=upright, bold=bold), _EM["glyph"])


def _number(node: Node) -> Out:
    bold = node.font in ("rmbold", "bold")
    return _glyphs(_group(f"{node.font} {node.text}") if bold else node.text, _text_run(node.text, True, bold=bold), _EM["glyph"] * len(node.text))


def _sign(node: Node) -> Out:
    word = f'"{node.text}"' if node.text in "{}" else _WORDS.get(node.text, node.text)
    if node.text in _LARGE:
        return _glyphs(word, _operator(node.text, "", "", False, ""), _EM["large"], "large ")
    return _glyphs(word, _text_run(node.text, True), _EM["relation" if node.text in "=+−→←" else "glyph"])


def _name(node: Node) -> Out:
    return _glyphs(node.text, _text_run(node.text, True, plain=True), _EM["name letter"] * len(node.text))


def _words(node: Node) -> Out:
    office = _text_run(node.text, True, plain=True)
    if not node.flag and node.text in "%&#_":
        return _glyphs(f'"{node.text}"', office, _EM["glyph"])
    if set(node.text) & set('"\\\r\n'):
        raise FormulaError("quotes, backslashes or line ends in text")
    width = sum(_EM["narrow" if c.isspace() else "wide" if "ᄀ" <= c <= "￿" else "glyph"] for c in node.text)
    return _glyphs(_group(f'rm "{node.text}"'), office, width)


def _space(node: Node) -> Out:
    em = _SPACES[node.text]
    return Out("`" * round(em * 4), _text_run(" " * int(em) + " " * round(em % 1 * 6), True, plain=True), em)


def _fraction(node: Node) -> Out:
    top, bottom = map(emit, node.parts)
    office = _tagged("f", "" if node.flag else _looks("f", type="noBar"), _tagged("num", top.office), _tagged("den", bottom.office))
    script = f"{_group(top.script)} {'OVER' if node.flag else 'ATOP'} {_group(bottom.script)}"
    return Out(script, office, max(top.width, bottom.width) + _EM["bar"], top.up + top.down + _EM["bar up"], bottom.up + bottom.down + _EM["bar down"])


def _root(node: Node) -> Out:
    body, degree = emit(node.parts[0]), emit(node.parts[1]) if node.parts[1] else _NOTHING
    head = f"ROOT {_group(degree.script)} OF" if node.parts[1] else "SQRT"
    office = _tagged("rad", _looks("rad", degHide=int(not node.parts[1])), _tagged("deg", degree.office), _tagged("e", body.office))
    return Out(f"{head} {_group(body.script)}", office, body.width + _EM["root"] + _EM["root degree"] * degree.width, body.up + _EM["root up"], body.down)


def _beside(base: Out, low: Out | None, high: Out | None, marks: tuple[str, str], office: str) -> Out:
    """A base with scripts at one of its sides."""
    scale = _EM["script scale"]
    written = [f"{mark} {_group(x.script)}" for mark, x in zip(marks, (low, high), strict=True) if x]
    return Out(
        " ".join([_group(base.script), *written]),
        office,
        base.width + scale * max(x.width for x in (low or _NOTHING, high or _NOTHING)),
        max(base.up, _EM["raise"] + scale * high.up if high else 0),
        max(base.down, _EM["lower"] + scale * low.down if low else 0),
    )


def _stacked(base: Out, low: Out | None, high: Out | None, office: str) -> Out:
    """A base with limits below and above."""

    def room(x: Out | None) -> float:
        return (x.up + x.down) * _EM["script scale"] + _EM["limit gap"] if x else 0

    written = [f"{mark} {_group(x.script)}" for mark, x in (("_", low), ("^", high)) if x]
    return Out(" ".join([base.script, *written]), office, max(x.width for x in (base, low or _NOTHING, high or _NOTHING)), base.up + room(high), base.down + room(low))


def _operator(char: str, low: str, high: str, stacked: bool, operand: str) -> str:
    look = _looks("nary", chr=char, limLoc="undOvr" if stacked else "subSup", subHide=int(not low), supHide=int(not high))
    return _tagged("nary", look, _tagged("sub", low), _tagged("sup", high), _tagged("e", operand))


def _script(node: Node, operand: str = "") -> Out:
    core = node.parts[0]
    base, low, high = (emit(x) if x else None for x in node.parts)
    texts = [x.office if x else "" for x in (low, high)]
    if core.kind == "sign" and core.text in _LARGE:
        office = _operator(core.text, *texts, node.flag, operand)
    elif node.flag:
        office = base.office if low is None else _tagged("limLow", _tagged("e", base.office), _tagged("lim", texts[0]))
        office = office if high is None else _tagged("limUpp", _tagged("e", office), _tagged("lim", texts[1]))
    else:
        parts = [_tagged(tag, x.office) for tag, x in (("e", base), ("sub", low), ("sup", high)) if x]
        office = _tagged("s" + "Sub" * (low is not None) + "Sup" * (high is not None), *parts)
    return _stacked(base, low, high, office) if node.flag else _beside(base, low, high, ("_", "^"), office)


def _fence(node: Node) -> Out:
    left, right = ("\\{" if d == "{" else d for d in (node.font or "( )").split(" "))
    inside = emit(node.parts[0])
    office = _tagged("d", _looks("d", begChr=_DELIMITERS[left][1], endChr=_DELIMITERS[right][1]), _tagged("e", inside.office))
    marks = [_DELIMITERS[d][0] for d in (left, right)]
    return inside._replace(script=f"LEFT {marks[0]} {inside.script} RIGHT {marks[1]}", office=office, width=inside.width + _EM["fence"] * sum(d != "." for d in (left, right)))


def _accent(node: Node) -> Out:
    body, (word, mark) = emit(node.parts[0]), _ACCENTS[node.text]
    inside, below = _tagged("e", body.office), mark == "under"
    office = _tagged("bar", _looks("bar", pos="bot" if below else "top"), inside) if mark in ("bar", "under") else _tagged("acc", _looks("acc", chr=mark), inside)
    return Out(f"{word} {_group(body.script)}", office, body.width, body.up + _EM["accent"] * (not below), body.down + _EM["accent"] * below)


def _frame(node: Node) -> Out:
    body, edge = emit(node.parts[0]), _EM["frame edge"]
    return Out(f"BOX {_group(body.script)}", _tagged("borderBox", _tagged("e", body.office)), body.width + _EM["frame"], body.up + edge, body.down + edge)


def _grid(node: Node) -> Out:
    rows = [[emit(c) for c in r] for r in node.parts]
    columns = _tagged("mc", _looks("mc", count=len(rows[0]), mcJc="left" if node.flag else "center"))
    office = _tagged("m", _tagged("mPr", _tagged("mcs", columns)), *(_tagged("mr", *(_tagged("e", c.office) for c in r)) for r in rows))
    if node.flag:
        office = _tagged("d", _looks("d", begChr="{", endChr=""), _tagged("e", office))
    script = " # ".join(" & ".join(_group(c.script) for c in r) for r in rows)
    half = sum(max(c.up + c.down for c in r) + _EM["row gap"] for r in rows) / 2
    width = sum(max(c.width for c in column) for column in zip(*rows, strict=True)) + _EM["column gap"] * (len(rows[0]) - 1)
    return Out(f"{'CASES' if node.flag else 'MATRIX'} {_group(script)}", office, width + _EM["brace"] * node.flag, half + _EM["axis"], half - _EM["axis"])


def _is_large(node: Node) -> bool:
    core = node.parts[0] if node.kind == "script" else node
    return core.kind == "sign" and core.text in _LARGE


def _is_left_script(node: Node) -> bool:
    """Scripts with nothing before them: they belong to what follows."""
    return node.kind == "script" and node.parts[0].kind == "row" and not node.parts[0].parts


def _is_degree(node: Node) -> bool:
    raised = node.parts[2] if node.parts[1] is None else None
    return raised is not None and [x.text for x in (raised.parts if raised.kind == "row" else [raised])] in (["∘"], ["°"])


def _opens(node: Node) -> int:
    """1 for an opening bracket, -1 for a closing one, 0 for others."""
    core = node.parts[0] if node.kind == "script" else node
    return (core.text in "([") - (core.text in ")]") if core.kind == "sign" else 0


def _reach(parts: list[Node], start: int) -> int:
    """The place after what a large operator before ``start`` applies to: spaces, then one item or a whole bracket; further operators bring their own."""
    at, level, after_spaces = start, 0, False
    while at < len(parts):
        node = parts[at]
        at += 1
        if node.kind == "space" and not after_spaces:
            continue
        after_spaces = True
        level += _opens(node)
        if level <= 0 and not _is_large(node):
            break
    return at


def _row(node: Node) -> Out:
    parts, outs, at = node.parts, [], 0
    while at < len(parts):
        part = parts[at]
        at += 1
        if _is_left_script(part):
            if _is_degree(part):
                outs.append(_glyphs("DEG", _text_run("°", True), _EM["degree"]))
                continue
            if at == len(parts) or parts[at].kind == "sign":
                raise FormulaError("scripts without a base")
            base, low, high = emit(parts[at]), *(emit(x) if x else None for x in part.parts[1:])
            at += 1
            office = _tagged("sPre", _tagged("sub", low.office if low else ""), _tagged("sup", high.office if high else ""), _tagged("e", base.office))
            outs.append(_beside(base, low, high, ("LSUB", "LSUP"), office))
        elif _is_large(part):
            stop = _reach(parts, at)
            operand = _row(Node("row", parts=parts[at:stop]))
            own = _script(part, operand.office) if part.kind == "script" else emit(part)._replace(office=_operator(part.text, "", "", False, operand.office))
            outs += [own, operand._replace(office="")]
            at = stop
        else:
            outs.append(emit(part))
    return Out(" ".join(x.script for x in outs if x.script), "".join(x.office for x in outs), sum(x.width for x in outs), max((x.up for x in outs), default=0), max((x.down for x in outs), default=0))


_EMIT: dict[str, Callable[[Node], Out]] = {
    "row": _row, "letter": _letter, "number": _number, "sign": _sign, "name": _name, "text": _words, "space": _space, "frac": _fraction,
    "root": _root, "script": _script, "fence": _fence, "accent": _accent, "box": _frame, "table": _grid,
}


def emit(node: Node) -> Out:
    """Both languages and the size of a tree, in one walk."""
    return _EMIT[node.kind](node)


def native_script(latex: str | None, display: bool = False) -> str:
    """The formula in the native equation language."""
    return emit(parse(latex, display)).script


def office_math(latex: str | None, display: bool = False) -> str:
    """The formula as one Office math element."""
    return _tagged("oMath", emit(parse(latex, display)).office)


def measure(latex: str | None, points: float = 10, display: bool = False) -> tuple[int, int, int]:
    """Width, height and baseline estimates in hundredths of a point."""
    if not 1 <= points <= 100:
        raise FormulaError("font size")
    return _size(emit(parse(latex, display)), points)


def _size(out: Out, points: float) -> tuple[int, int, int]:
    units = round(points * 100)
    return tuple(math.ceil(em * units * 1.1) for em in (out.width, out.up + out.down, out.up))


#: What may begin or end a formula in prose; an escaped character does neither.
_MARKS = re.compile(r"\\begin\{([a-z]+)\}|\\[\s\S]|\$\$?")
#: The mark that ends a formula, and whether it stands alone. Fixed values.
_ENDS = {"$": ("$", False), "$$": ("$$", True), "\\(": ("\\)", False), "\\[": ("\\]", True)}
_CHOICES = "①②③④⑤"
_AMOUNT = re.compile(r"\d[\d,]*(?:\.\d+)?\s*")
#: Commands that are formulae without marks around them, by the number of their arguments. Fixed values.
_BARE = {"frac": 2, "dfrac": 2, "tfrac": 2, "binom": 2, "sqrt": 1, "vec": 1, "hat": 1, "overline": 1} | dict.fromkeys("lim sum prod int sin cos tan log ln exp min max".split(), 0)


def _is_price(text: str, at: int) -> bool:
    """Whether the dollar at ``at`` is that of an amount that makes up a whole numbered choice."""
    if text[:at].rstrip()[-1:] not in tuple(_CHOICES) or text[at : at + 2] == "$$":
        return False
    amount = _AMOUNT.match(text, at + 1)
    after = amount and text[amount.end() : amount.end() + 1]
    return bool(amount) and (after == "" or after in _CHOICES or "\n" in amount[0])


def _marks(text: str, at: int = 0) -> Iterator[re.Match]:
    """Marks from ``at`` on, without those of prices."""
    while m := _MARKS.search(text, at):
        at = m.end()
        if not (m[0][0] == "$" and _is_price(text, m.start())):
            yield m


def unbalanced(text: str) -> bool:
    """An odd number of formula marks."""
    return sum(len(m[0]) for m in _marks(text) if m[0][0] == "$") % 2 == 1


def _closing(text: str, opened: re.Match) -> tuple[int, int, int, bool] | None:
    """Of the formula that a mark opens: where its inside begins and ends, where it ends itself, whether it stands alone."""
    if opened[1]:
        end = text.find(f"\\end{{{opened[1]}}}", opened.end()) if opened[1] in _MATRICES else -1
        stop = end + len(opened[1]) + 6
        return (opened.start(), stop, stop, True) if end > opened.end() else None
    wanted, alone = _ENDS.get(opened[0], ("", False))
    if not wanted:
        return None
    for m in _MARKS.finditer(text, opened.end()):
        if m[0] == wanted or wanted == "$" and m[0] == "$$":
            inside = text[opened.end() : m.start()]
            if not inside or wanted == "$" and "\n" in inside:
                return None
            return opened.end(), m.start(), m.start() + len(wanted), alone
    return None


def _bare_end(text: str, at: int) -> int | None:
    """The place after a known command at ``at`` with all its arguments, in braces, and scripts; None if it is unknown or incomplete."""
    name = re.compile(r"\\([A-Za-z]+)").match(text, at)
    if not name or name[1] not in _BARE:
        return None
    reader = _Reader(text[at:], False)
    try:
        reader.take()
        if name[1] == "sqrt" and reader.peek() == "[":
            reader.take()
            reader.row(("]",), None)
            reader.take("]")
        for _ in range(_BARE[name[1]]):
            if reader.peek() != "{":
                return None
            reader.argument(None)
        end = reader.at
        if reader.peek() in ("^", "_"):
            scripts = reader.scripts(Node("name", name[1]), None).parts[1:]
            if any(x is not None and x.kind == "row" and not x.parts for x in scripts):
                return None
            end = reader.at
    except FormulaError:
        return None
    return at + len(text[at : len(text) - len("".join(reader.tokens[end:]))].rstrip())


def _prose(text: str) -> Iterator[tuple[str, bool, bool]]:
    """Prose with complete bare commands cut out; left whole while a formula mark in it is open."""
    start = at = 0
    closed = not any(m[0][0] == "$" for m in _marks(text))
    while closed and (at := text.find("\\", at)) >= 0:
        end = _bare_end(text, at)
        if end is None:
            at += 2
            continue
        if at > start:
            yield text[start:at], False, False
        yield text[at:end], True, False
        start = at = end
    if start < len(text):
        yield text[start:], False, False


def split_math(text: str | None) -> list[tuple[str, bool, bool]]:
    """Text, whether it is a formula, whether it stands alone; in order.  Only whole formulae are cut out."""
    text = text or ""
    out, start, at = [], 0, 0
    while True:
        opened = next(_marks(text, at), None)
        if opened is None:
            return out + list(_prose(text[start:]))
        found = _closing(text, opened)
        if found is None:
            at = opened.end()
            continue
        first, last, end, alone = found
        out += _prose(text[start : opened.start()])
        out.append((text[first:last], True, alone))
        start = at = end


#: Commands that make no sense outside a formula. Fixed values.
_STRUCTURE = {f"\\{n}" for n in "left right begin end frac sqrt sum lim".split()}


def _stray(prose: str) -> bool:
    tokens = [t for t in _TOKEN.findall(prose) if not t.isspace()]
    return any(t in _STRUCTURE or t in "^_" and after == "{" for t, after in zip(tokens, [*tokens[1:], ""], strict=False))


def _refused(formula: str, display: bool) -> bool:
    try:
        parse(formula, display)
    except FormulaError:
        return True
    return False


def issues(text: str | None) -> list[str]:
    """Codes of what looks damaged, in a fixed order; latex_syntax is what ``parse`` refuses."""
    text = text or ""
    parts = split_math(re.sub(r"</?[bu]>", "", text))
    lines = [x for b in markup.blocks(text) if b["kind"] != "table" for x in b["text"].split("\n")]
    found = {
        "invalid_control_character": any(unicodedata.category(c) == "Cc" and c not in "\t\n\r" and c <= "\x7f" for c in text),
        "latex_unbalanced": unbalanced(text),
        "latex_outside_math": any(not is_math and _stray(x) for x, is_math, _ in parts),
        "orphan_absolute_bars": any("".join(x.split()) == "||" for x in lines),
        "latex_syntax": any(is_math and _refused(x, alone) for x, is_math, alone in parts),
    }
    return [code for code, holds in found.items() if holds]


def _over(df: DataFrame, id_col: str, text_col: str, columns: str, rows, shape: list[pa.Field]) -> DataFrame:
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(zip(*map(rows, batch.column(1).to_pylist()), strict=True)) or [()] * len(shape)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, f.type) for v, f in zip(values, shape, strict=True))], ["id", *(f.name for f in shape)])

    return source.mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def converted(df: DataFrame, id_col: str, text_col: str, display: bool = False) -> DataFrame:
    """id, script, office, width, height, baseline, error of every formula; where it is refused, error alone."""

    def rows(latex):
        try:
            out = emit(parse(latex, display))
            return out.script, _tagged("oMath", out.office), *_size(out, 10), None
        except FormulaError as e:
            return None, None, None, None, None, str(e)

    text, number = pa.string(), pa.int64()
    shape = [pa.field("script", text), pa.field("office", text), pa.field("width", number), pa.field("height", number), pa.field("baseline", number), pa.field("error", text)]
    return _over(df, id_col, text_col, "script string, office string, width bigint, height bigint, baseline bigint, error string", rows, shape)


def spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, text, is_math, display: a row for each part of each text."""
    shape = [pa.field("parts", pa.list_(pa.struct([("text", pa.string()), ("is_math", pa.bool_()), ("display", pa.bool_())])))]
    named = _over(df, id_col, text_col, "parts array<struct<text:string,is_math:boolean,display:boolean>>", lambda t: ([dict(zip(("text", "is_math", "display"), p, strict=True)) for p in split_math(t)],), shape)
    return named.select(id_col, F.posexplode("parts").alias("pos", "p")).select(id_col, "pos", "p.text", "p.is_math", "p.display")


def audited(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the issues of every text."""
    return _over(df, id_col, text_col, "issues array<string>", lambda t: (issues(t),), [pa.field("issues", pa.list_(pa.string()))])
