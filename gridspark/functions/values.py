"""Coercions and comparisons of single values, and criteria, as spreadsheets have them."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import Any

from gridspark.model import GridError, is_blank, number_text, to_serial

VALUE, NA, REF, DIV, NUM, NAME = (GridError(k) for k in ("Value", "Na", "Ref", "Div", "Num", "Name"))
TEMPORAL = (dt.date, dt.time, dt.timedelta)
NUMBER_TEXT = re.compile(r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*(%?)\s*")


def number_of(text: str) -> float | GridError:
    """The number that a text writes, a date in ISO form as its serial, else a Value error."""
    m = NUMBER_TEXT.fullmatch(text)
    if m:
        return float(text.replace("%", "")) / (100 if m[1] else 1)
    try:
        return to_serial(dt.datetime.fromisoformat(text.strip()) if ":" in text else dt.date.fromisoformat(text.strip()))
    except ValueError:
        return VALUE


def to_number(v: Any) -> float | GridError:
    if isinstance(v, GridError):
        return v
    if is_blank(v):
        return 0.0
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return v
    if isinstance(v, str):
        return number_of(v)
    return to_serial(v) if isinstance(v, TEMPORAL) else VALUE


def to_text(v: Any) -> str | GridError:
    if isinstance(v, GridError):
        return v
    if is_blank(v):
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return v
    return number_text(v if isinstance(v, (int, float)) else to_serial(v))


def to_bool(v: Any) -> bool | GridError:
    if isinstance(v, (GridError, bool)):
        return v
    if is_blank(v):
        return False
    if isinstance(v, str):
        return {"TRUE": True, "FALSE": False}.get(v.strip().upper(), VALUE)
    return to_number(v) != 0


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) or isinstance(v, TEMPORAL)


def order_key(v: Any) -> tuple:
    """Numbers before texts before booleans; text without case."""
    if isinstance(v, bool):
        return 2, v
    if isinstance(v, str):
        return 1, v.lower()
    return 0, to_number(v)


def compare(a: Any, b: Any) -> int | GridError:
    for v in (a, b):
        if isinstance(v, GridError):
            return v
    if is_blank(a):
        a = "" if isinstance(b, str) else False if isinstance(b, bool) else 0.0
    if is_blank(b):
        b = "" if isinstance(a, str) else False if isinstance(a, bool) else 0.0
    x, y = order_key(a), order_key(b)
    return (x > y) - (x < y)


def wildcard(pattern: str) -> re.Pattern:
    """'*' any run, '?' any character, '~' takes the next as it is; without case, of the whole text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return re.compile(out, re.I | re.S)


PREFIX = re.compile(r"(>=|<=|<>|=|>|<)?(.*)", re.S)


def split_criterion(c: Any) -> tuple[str, Any]:
    """(operator, operand) of a criterion; the operand is a number, a boolean or a text."""
    if not isinstance(c, str):
        return "=", "" if is_blank(c) else c if isinstance(c, bool) else to_number(c)
    m = PREFIX.fullmatch(c)
    op, rest = m[1] or "=", m[2]
    n = number_of(rest) if rest else rest
    if isinstance(n, float):
        return op, n
    if rest.upper() in ("TRUE", "FALSE"):
        return op, rest.upper() == "TRUE"
    return op, rest


def criterion(c: Any) -> Callable[[Any], bool]:
    """A test of single values."""
    if isinstance(c, GridError):
        return lambda v: v == c
    op, want = split_criterion(c)
    if op in (">", "<", ">=", "<="):
        sign = {">": (1,), "<": (-1,), ">=": (0, 1), "<=": (0, -1)}[op]
        if isinstance(want, str):
            return lambda v: isinstance(v, str) and compare(v, want) in sign
        kind = isinstance(want, bool)
        return lambda v: not isinstance(v, GridError) and (isinstance(v, bool) if kind else is_number(v)) and compare(v, want) in sign
    if isinstance(want, str):
        if want == "":
            same = (lambda v: is_blank(v) or v == "") if not isinstance(c, str) or op == "=" and c == "" else lambda v: is_blank(v)
        else:
            match = wildcard(want).fullmatch
            same = lambda v: isinstance(v, str) and bool(match(v))
    elif isinstance(want, bool):
        same = lambda v: v is want
    else:
        same = lambda v: is_number(v) and to_number(v) == want or isinstance(v, str) and number_of(v) == want
    return same if op == "=" else lambda v: not same(v)
