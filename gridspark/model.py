"""Values of cells: errors, blanks, numbers as text, serial dates, the instant of a run."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field
from typing import Any

#: Kinds of error values and how a sheet writes them (fixed values of the file format).
ERROR_TEXT = {
    "Div": "#DIV/0!",
    "Na": "#N/A",
    "Name": "#NAME?",
    "Null": "#NULL!",
    "Num": "#NUM!",
    "Ref": "#REF!",
    "Value": "#VALUE!",
    "Spill": "#SPILL!",
    "Circ": "#CIRC!",
}
ERROR_KIND = {text: kind for kind, text in ERROR_TEXT.items()}

EPOCH = dt.date(1899, 12, 30)
DAY = 86400


@dataclass(frozen=True)
class GridError:
    """An error as a value. Errors are equal if kind and message are."""

    kind: str
    message: str | None = None

    def to_dict(self) -> dict[str, str]:
        out = {"type": "Error", "kind": self.kind}
        return out if self.message is None else out | {"message": self.message}


def error_of(text: str) -> GridError:
    """The error that a cell's text stands for; unknown text is a Value error."""
    return GridError(ERROR_KIND.get(text.strip().upper(), "Value"))


class Blank:
    """A declared cell without a value. A cell that is not there is None."""

    def __repr__(self) -> str:
        return "BLANK"

    def __reduce__(self) -> str:
        return "BLANK"  # the one instance again, on executors as well


BLANK = Blank()


@dataclass(frozen=True)
class RunClock:
    """The instant and offset that every NOW and TODAY of a run see, in whole seconds."""

    utc: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.UTC).replace(microsecond=0))
    offset_minutes: int = 0

    def now(self) -> dt.datetime:
        return (self.utc.replace(tzinfo=None) + dt.timedelta(minutes=self.offset_minutes)).replace(microsecond=0)

    def today(self) -> dt.date:
        return self.now().date()


def is_blank(v: Any) -> bool:
    return v is None or v is BLANK


def number_text(x: float) -> str:
    """A number as text: up to 15 significant digits, no trailing zeros."""
    if isinstance(x, int) or x == int(x) and abs(x) < 1e15:
        return str(int(x))
    s = f"{x:.15g}"
    if "e" in s:
        head, exp = s.split("e")
        return f"{head}E{exp[0]}{exp[1:].lstrip('0').zfill(2)}"
    return s


def to_serial(v: dt.date | dt.datetime | dt.time | dt.timedelta) -> float:
    """Days since the epoch of serial dates; in the first two months of 1900 one less, as that calendar has a 29 February."""
    if isinstance(v, dt.timedelta):
        return v.total_seconds() / DAY
    if isinstance(v, dt.time):
        return (v.hour * 3600 + v.minute * 60 + v.second) / DAY
    day = v.date() if isinstance(v, dt.datetime) else v
    serial = (day - EPOCH).days
    serial -= serial <= 60 and day.year == 1900 and day.month <= 2
    if isinstance(v, dt.datetime):
        return serial + (v.hour * 3600 + v.minute * 60 + v.second + v.microsecond / 1e6) / DAY
    return float(serial)


def from_serial(serial: float) -> dt.date | dt.datetime:
    """A date, or a datetime if the serial has a part of a day."""
    days = math.floor(serial)
    seconds = round((serial - days) * DAY, 6)
    date = EPOCH + dt.timedelta(days=days + (0 < days < 60))
    if seconds == 0:
        return date
    return dt.datetime.combine(date, dt.time()) + dt.timedelta(seconds=seconds)


def same_value(a: Any, b: Any, rel: float = 1e-9) -> bool:
    """Equality between two runs: numbers within rel of the larger, zero only with zero, errors by kind and message,
    blank and missing alike, arrays by element."""
    if is_blank(a) or is_blank(b):
        return is_blank(a) and is_blank(b)
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        if a == b:
            return True
        return a != 0 and b != 0 and abs(a - b) <= rel * max(abs(a), abs(b))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(same_value(x, y, rel) for x, y in zip(a, b, strict=True))
    return type(a) is type(b) and a == b
