"""Number formats: which are dates, and TEXT."""

from __future__ import annotations

import datetime as dt
import re
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from gridspark.model import GridError, from_serial

#: Built-in formats of dates and times, and of elapsed time (fixed values of the file format).
DATE_IDS = {"14", "15", "16", "17", "18", "19", "20", "21", "22", "45", "47"}
ELAPSED_IDS = {"46"}


def format_class(code: str) -> str | None:
    """'date', 'elapsed' or None: what unquoted, unescaped letters of the first section say."""
    found, i, code = None, 0, code
    while i < len(code):
        c = code[i]
        if c in "_\\*":
            i += 2
            continue
        if c == '"':
            end = code.find('"', i + 1)
            i = len(code) if end < 0 else end + 1
            continue
        if c == "[":
            end = code.find("]", i)
            if end < 0:
                break
            if re.fullmatch("[hH]+|[mM]+|[sS]+", code[i + 1 : end]):
                return "elapsed"
            i = end + 1
            continue
        if c == ";":
            break
        if code[i : i + 5].upper() == "AM/PM":
            found, i = "date", i + 5
            continue
        if c in "dDmMhHyYsS":
            found = "date"
        i += 1
    return found


def built_in(number_id: str) -> str | None:
    return "date" if number_id in DATE_IDS else "elapsed" if number_id in ELAPSED_IDS else None


#: Parts of date formats (fixed values of the spreadsheet language).
DATE_PARTS = re.compile(r"yyyy|yy|mmmm|mmm|mm|m|dddd|ddd|dd|d|hh|h|ss|s|AM/PM|\"[^\"]*\"|\\.|.", re.I)


def format_text(v: Any, code: str) -> str | GridError:
    """TEXT(v, code) for dates, percents and plain numbers."""
    if isinstance(v, (bool, str)):
        return v if isinstance(v, str) else "TRUE" if v else "FALSE"
    if format_class(code):
        when = v if isinstance(v, dt.date) else from_serial(float(v))
        at = when if isinstance(when, dt.datetime) else dt.datetime.combine(when, dt.time())
        parts = DATE_PARTS.findall(code)
        half = any(p.upper() == "AM/PM" for p in parts)
        out, hours = "", False
        for k, p in enumerate(parts):
            q = p.lower()
            if q in ("m", "mm") and (hours or any(x.lower() in ("s", "ss") for x in parts[k + 1 : k + 3])):
                out += f"{at.minute:0{len(q)}d}"
            elif q == "am/pm":
                out += "AM" if at.hour < 12 else "PM"
            elif q in ("h", "hh"):
                out += f"{(at.hour - 1) % 12 + 1 if half else at.hour:0{len(q)}d}"
            else:
                out += {"yyyy": f"{at.year:04d}", "yy": f"{at.year % 100:02d}", "mmmm": f"{at:%B}", "mmm": f"{at:%b}", "mm": f"{at.month:02d}", "m": str(at.month), "dddd": f"{at:%A}", "ddd": f"{at:%a}", "dd": f"{at.day:02d}", "d": str(at.day), "ss": f"{at.second:02d}", "s": str(at.second)}.get(q, p.strip('"').removeprefix("\\"))
            hours = q in ("h", "hh") or hours and not q[0].isalpha()
        return out
    x = float(v)
    sections = code.split(";")
    if x < 0 and len(sections) > 1:
        code, x = sections[1], -x
    else:
        code = sections[0]
    m = re.search(r"[#0,]*(?:\.[#0]*)?%?", re.sub(r'"[^"]*"', "", code))
    body = next((b for b in re.findall(r"[#0][#0,]*(?:\.[#0]*)?%?|\.[#0]+%?", code)), None)
    if body is None or m is None:
        return code.replace('"', "")
    percent = body.endswith("%")
    whole, _, places = body.rstrip("%").partition(".")
    shown = Decimal(repr(x * 100 if percent else x)).quantize(Decimal(1).scaleb(-len(places)), rounding=ROUND_HALF_UP)
    digits = f"{abs(shown):f}"
    left, _, right = digits.partition(".")
    left = left.lstrip("0").zfill(whole.count("0"))
    if "," in whole and left:
        left = f"{int(left):,}".zfill(len(left))
    least = len(places.rstrip("#"))
    while len(right) > least and right.endswith("0"):
        right = right[:-1]
    text = ("-" if shown < 0 else "") + left + ("." + right if right or places and least else "") + ("%" if percent else "")
    return code.replace(body, text, 1).replace('"', "")
