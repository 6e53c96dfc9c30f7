"""Equation scripts: tokens and LaTeX. A script nests without bound, so this is an Arrow-batched Python function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Greek names, by spelling; the capitals that LaTeX has none for are words.
GREEK = frozenset(
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()
)
#: Keywords without an argument, with one, and over a limit pair.
PLAIN = {w: "\\" + w for w in "mid sin cos tan log ln exp cdot cdots ldots vdots approx equiv sim infty partial nabla leftarrow leftrightarrow".split()} | {"inf": "\\infty", "from": "\\text{from}", "to": "\\text{to}"}
ACCENTS = {w: "\\" + w for w in "sqrt bar hat tilde dot ddot vec overline underline".split()} | {"rm": "\\mathrm", "bf": "\\mathbf", "it": "\\mathit"}
BIG = {w: "\\" + w for w in ("sum", "prod", "int")}
INFIX = {"over": "over", "sup": "^", "sub": "_", "^": "^", "_": "_"}
#: Operators and symbols.
OPERATORS = {"!=": "\\neq", "<=": "\\leq", ">=": "\\geq", "+-": "\\pm"}
SYMBOLS = {
    "⌊": "\\lfloor", "⌋": "\\rfloor", "⌈": "\\lceil", "⌉": "\\rceil", "∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∞": "\\infty", "∂": "\\partial", "∇": "\\nabla", "∈": "\\in", "∉": "\\notin",
    "⊆": "\\subseteq", "⊂": "\\subset", "∪": "\\cup", "∩": "\\cap", "≠": "\\neq", "≈": "\\approx", "≤": "\\leq", "≥": "\\geq", "→": "\\to", "←": "\\leftarrow", "↔": "\\leftrightarrow", "∅": "\\emptyset",
}
_TOKEN = re.compile(r"\s*(##|!=|<=|>=|\+-|[0-9.]+|[A-Za-z]+|\S)", re.S)
_WORDS = frozenset([*PLAIN, *ACCENTS, *BIG, *INFIX, "root", "frac", "lim", "matrix", "pile", "left", "right"])


def tokens(script: str | None) -> list[str]:
    """The tokens as written; after LEFT and RIGHT any character is a delimiter."""
    out: list[str] = []
    for m in _TOKEN.finditer((script or "").rstrip()):
        out.append(m[1])
    return out


def _bare(x: str) -> str:
    x = x.strip()
    return x[1:-1] if len(x) > 1 and x[0] == "{" and x[-1] == "}" else x


class _Reader:
    """One pass over the tokens; every method takes what it needs from the front."""

    def __init__(self, script: str):
        self.left = tokens(script)[::-1]

    def word(self) -> str:
        """The next token as a keyword, if it is one."""
        t = self.left[-1] if self.left else ""
        return t.lower() if t not in GREEK and t.lower() in _WORDS else t

    def sequence(self) -> str:
        done: list[str] = []
        while self.left and self.left[-1] != "}":
            infix = INFIX.get(self.word())
            if not infix:
                done.append(self.atom())
                continue
            self.left.pop()
            right = _bare(self.atom())
            before = done.pop() if done else ""
            done.append(f"\\frac{{{_bare(before)}}}{{{right}}}" if infix == "over" else f"{before}{infix}{{{right}}}")
        return " ".join(done)

    def group(self) -> str:
        """What is inside the braces whose opening one has been taken."""
        inner = self.sequence()
        if self.left:
            self.left.pop()
        return inner

    def atom(self) -> str:
        if not self.left:
            return ""
        k, t = self.word(), self.left.pop()
        if t == "{":
            return "{" + self.group() + "}"
        if t in GREEK:
            return "\\" + t
        if k in ACCENTS:
            return ACCENTS[k] + self.atom()
        if k in PLAIN:
            return PLAIN[k]
        if k in BIG:
            return self.limits(BIG[k])
        if k in ("frac", "root"):
            a, b = _bare(self.atom()), _bare(self.atom())
            return f"\\frac{{{a}}}{{{b}}}" if k == "frac" else f"\\sqrt[{a}]{{{b}}}"
        if k == "lim":
            if INFIX.get(self.word()) != "_":
                return "\\lim"
            self.left.pop()
            return "\\lim_{" + _bare(self.atom()).replace("->", "\\to ") + "}"
        if k in ("matrix", "pile"):
            name = "pmatrix" if k == "matrix" else "matrix"
            return f"\\begin{{{name}}} {_bare(self.atom())} \\end{{{name}}}" if not self.left or self.left[-1] != "{" else self.matrix(name)
        if k in ("left", "right"):
            return f"\\{k}" + self.delimiter()
        if k in INFIX:
            return "" if t.isalpha() else t
        if t == "##":
            return " \\\\ "
        return OPERATORS.get(t) or SYMBOLS.get(t) or (f"\\mathit{{{t}}}" if t.isalpha() and len(t) > 1 else t)

    def matrix(self, name: str) -> str:
        self.left.pop()
        return f"\\begin{{{name}}} {_bare(self.group())} \\end{{{name}}}"

    def limits(self, sign: str) -> str:
        ends: dict[str, str] = {}
        while (k := self.word()) in ("from", "to"):
            self.left.pop()
            ends[k] = _bare(self.atom())
        return sign + "".join(f"{mark}{{{ends[k]}}}" for k, mark in (("from", "_"), ("to", "^")) if k in ends)

    def delimiter(self) -> str:
        if not self.left or self.left[-1][0].isalnum():
            return "."
        t = self.left.pop()
        if len(t) > 1:
            self.left.append(t[1:])
            t = t[0]
        return "\\" + t if t in "{}" else SYMBOLS.get(t, t)


def latex(script: str | None) -> str:
    """LaTeX of a script; the empty text for a null or blank one. A closing brace too many ends what is read into a group of its own."""
    reader, out = _Reader(script or ""), []
    while reader.left:
        out.append(reader.sequence())
        if reader.left:
            out.append(reader.left.pop())
    return " ".join(x for x in out if x)


@F.pandas_udf(T.StringType())
def to_latex(script: pd.Series) -> pd.Series:
    return script.map(latex, na_action=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def to_tokens(script: pd.Series) -> pd.Series:
    return script.map(tokens, na_action=None)
