"""Constant expressions of C: arithmetic of numbers, without names or calls."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(0[xX][0-9a-fA-F]+[uUlL]*|0[bB][01]+[uUlL]*|\d+\.\d*(?:[eE][+-]?\d+)?[fFlL]?|\.\d+[fF]?|\d+(?:[eE][+-]?\d+)?[uUlLfF]*|<<|>>|[-+*/%&|^~()])")
LEVELS = (("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
#: Larger numbers than these are not returned, and larger shifts not tried.
LARGEST, SHIFT = 2**63 - 1, 200


class _Bad(Exception):
    pass


def _number(text: str) -> int | float:
    low = text.lower()
    if low.startswith(("0x", "0b")):
        return int(low.rstrip("ul"), 0)
    low = low.rstrip("ulf")
    if not low.isdigit():
        return float(low)
    return int(low, 8) if len(low) > 1 and low[0] == "0" else int(low)


def _apply(op: str, a, b):
    if op in ("|", "^", "&", "<<", ">>"):
        if not (isinstance(a, int) and isinstance(b, int)) or (op in ("<<", ">>") and not 0 <= b <= SHIFT):
            raise _Bad
        return {"|": a.__or__, "^": a.__xor__, "&": a.__and__, "<<": a.__lshift__, ">>": a.__rshift__}[op](b)
    if op in "/%":
        if b == 0:
            raise _Bad
        if isinstance(a, int) and isinstance(b, int):
            whole = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)  # towards zero, as in C
            return whole if op == "/" else a - whole * b
        if op == "%":
            raise _Bad
        return a / b
    return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__}[op](b) if type(a) is type(b) else {"+": float(a).__add__, "-": float(a).__sub__, "*": float(a).__mul__}[op](float(b))


def value(text: str | None) -> int | None:
    """The value as a whole number, cut off towards zero; None where the text is no constant arithmetic."""
    if text is None:
        return None
    text = text.replace("'", "").strip()
    tokens, at = [], 0
    while at < len(text):
        hit = TOKEN.match(text, at)
        if not hit:
            return None
        tokens.append(hit[1])
        at = hit.end()
    place = 0

    def unary():
        nonlocal place
        if place >= len(tokens):
            raise _Bad
        t = tokens[place]
        place += 1
        if t == "(":
            out = binary(0)
            if place >= len(tokens) or tokens[place] != ")":
                raise _Bad
            place += 1
            return out
        if t in ("+", "-", "~"):
            out = unary()
            if t == "~" and not isinstance(out, int):
                raise _Bad
            return out if t == "+" else -out if t == "-" else ~out
        if not (t[0].isdigit() or t[0] == "."):
            raise _Bad
        return _number(t)

    def binary(level: int):
        nonlocal place
        if level == len(LEVELS):
            return unary()
        out = binary(level + 1)
        while place < len(tokens) and tokens[place] in LEVELS[level]:
            op = tokens[place]
            place += 1
            out = _apply(op, out, binary(level + 1))
        return out

    try:
        out = int(binary(0))
    except (_Bad, ValueError, OverflowError, RecursionError):
        return None
    return out if place == len(tokens) and abs(out) <= LARGEST else None


def _values(texts: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([known.setdefault(t, value(t)) if t not in known else known[t] for t in texts], dtype="Int64")


def evaluate(text: Column) -> Column:
    """A bigint. Plain decimal numbers stay in the JVM; only other text goes through Python."""
    plain = text.rlike(r"^\s*[1-9][0-9]{0,17}\s*$")
    # A plain number is null on its way to Python, so nothing is parsed for it there.
    return F.coalesce(F.when(plain, F.trim(text).try_cast("bigint")), F.pandas_udf(_values, "bigint")(F.when(~plain, text)))
