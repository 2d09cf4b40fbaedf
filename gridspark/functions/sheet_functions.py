"""The worksheet functions of the interpreter. Where nothing pins a meaning, the public convention of spreadsheets holds."""

from __future__ import annotations

import datetime as dt
import math
import statistics
from collections import Counter
from collections.abc import Callable
from typing import Any

from gridspark import grammar as g
from gridspark.functions.text_format import format_text
from gridspark.functions.values import DIV, NA, NAME, NUM, REF, VALUE, compare, criterion, is_number, order_key, to_bool, to_number, to_text, wildcard
from gridspark.interp import Area, Run, function
from gridspark.model import BLANK, GridError, from_serial, is_blank, to_serial

# aggregates


def over_numbers(*names: str, loose: bool = False) -> Callable:
    def put(f: Callable) -> Callable:
        def call(run: Run, *args: g.Node) -> Any:
            xs = run.numbers(args, loose)
            return xs if isinstance(xs, GridError) else f(xs)

        return function(*names)(call)

    return put


over_numbers("SUM")(lambda xs: float(math.fsum(xs)))
over_numbers("MIN")(lambda xs: min(xs, default=0.0))
over_numbers("MAX")(lambda xs: max(xs, default=0.0))
over_numbers("MINA", loose=True)(lambda xs: min(xs, default=0.0))
over_numbers("MAXA", loose=True)(lambda xs: max(xs, default=0.0))
over_numbers("AVERAGE")(lambda xs: math.fsum(xs) / len(xs) if xs else DIV)
over_numbers("AVERAGEA", loose=True)(lambda xs: math.fsum(xs) / len(xs) if xs else DIV)
over_numbers("PRODUCT")(lambda xs: math.prod(xs) if xs else 0.0)
over_numbers("MEDIAN")(lambda xs: statistics.median(xs) if xs else NUM)
over_numbers("STDEV", "STDEV.S")(lambda xs: statistics.stdev(xs) if len(xs) > 1 else DIV)
over_numbers("VAR", "VAR.S")(lambda xs: statistics.variance(xs) if len(xs) > 1 else DIV)
over_numbers("STDEVA", loose=True)(lambda xs: statistics.stdev(xs) if len(xs) > 1 else DIV)
over_numbers("VARA", loose=True)(lambda xs: statistics.variance(xs) if len(xs) > 1 else DIV)


@over_numbers("MODE", "MODE.SNGL")
def _mode(xs: list[float]) -> Any:
    top = Counter(xs).most_common(1)
    return top[0][0] if top and top[0][1] > 1 else NA


@function("COUNT")
def _count(run: Run, *args: g.Node) -> Any:
    return float(sum(is_number(v) if ranged else not isinstance(to_number(v), GridError) for v, ranged in run.flat(args)))


@function("COUNTA")
def _counta(run: Run, *args: g.Node) -> Any:
    return float(sum(not is_blank(v) for v, _ in run.flat(args)))


@function("COUNTBLANK")
def _countblank(run: Run, *args: g.Node) -> Any:
    return float(sum(is_blank(v) or v == "" for v, _ in run.flat(args)))


def _nth(largest: bool) -> Callable:
    def call(run: Run, xs: g.Node, k: g.Node) -> Any:
        xs, k = run.numbers((xs,)), to_number(run.single(k))
        for v in (xs, k):
            if isinstance(v, GridError):
                return v
        k = math.ceil(k)
        return sorted(xs, reverse=largest)[k - 1] if 1 <= k <= len(xs) else NUM

    return call


function("LARGE")(_nth(True))
function("SMALL")(_nth(False))


@function("SUMPRODUCT")
def _sumproduct(run: Run, *args: g.Node) -> Any:
    grids = [run.grid(a) for a in args]
    for x in grids:
        if isinstance(x, GridError):
            return x
    if len({(len(x), len(x[0])) for x in grids}) > 1:
        return VALUE
    total = []
    for rows in zip(*grids, strict=True):
        for cells in zip(*rows, strict=True):
            if err := next((v for v in cells if isinstance(v, GridError)), None):
                return err
            total.append(math.prod(to_number(v) if is_number(v) else 0.0 for v in cells))
    return float(math.fsum(total))


def _area(run: Run, n: g.Node, like: Area | None = None) -> Any:
    v = run.eval(n)
    if isinstance(v, Area) and like is not None:
        rows, cols = like.shape
        return Area(run, v.sheet, v.top, v.left, v.top + rows - 1, v.left + cols - 1)
    return v


def _chosen(run: Run, pairs: tuple[g.Node, ...]) -> Any:
    """Places that meet all (range, criterion) pairs, and the shape."""
    keep, shape = None, None
    for k in range(0, len(pairs), 2):
        rng = run.eval(pairs[k])
        if isinstance(rng, GridError):
            return rng
        grid = rng.grid() if isinstance(rng, Area) else rng if isinstance(rng, list) else [[rng]]
        if shape not in (None, (len(grid), len(grid[0]))):
            return VALUE
        shape = (len(grid), len(grid[0]))
        test = criterion(run.single(pairs[k + 1]))
        ok = [test(v) for row in grid for v in row]
        keep = ok if keep is None else [a and b for a, b in zip(keep, ok, strict=True)]
    return keep or []


def _picked(run: Run, values: g.Node, keep: list[bool], like: Any) -> Any:
    v = _area(run, values, like if isinstance(like, Area) else None)
    if isinstance(v, GridError):
        return v
    grid = v.grid() if isinstance(v, Area) else v
    out = []
    for x, ok in zip((x for row in grid for x in row), keep, strict=False):
        if ok and isinstance(x, GridError):
            return x
        if ok and is_number(x):
            out.append(to_number(x))
    return out


def _by_criteria(finish: Callable[[list[float]], Any], many: bool) -> Callable:
    def call(run: Run, *args: g.Node) -> Any:
        values, pairs = (args[0], args[1:]) if many else (args[2] if len(args) > 2 and not isinstance(args[2], g.Omit) else args[0], args[:2])
        keep = _chosen(run, pairs)
        if isinstance(keep, GridError):
            return keep
        xs = _picked(run, values, keep, run.eval(pairs[0]))
        return xs if isinstance(xs, GridError) else finish(xs)

    return call


def _mean(xs: list[float]) -> Any:
    return math.fsum(xs) / len(xs) if xs else DIV


function("SUMIF")(_by_criteria(lambda xs: float(math.fsum(xs)), False))
function("SUMIFS")(_by_criteria(lambda xs: float(math.fsum(xs)), True))
function("AVERAGEIF")(_by_criteria(_mean, False))
function("AVERAGEIFS")(_by_criteria(_mean, True))
function("MINIFS")(_by_criteria(lambda xs: min(xs, default=0.0), True))
function("MAXIFS")(_by_criteria(lambda xs: max(xs, default=0.0), True))


@function("COUNTIF", "COUNTIFS")
def _countif(run: Run, *args: g.Node) -> Any:
    keep = _chosen(run, args)
    return keep if isinstance(keep, GridError) else float(sum(keep))


# logic


@function("IF")
def _if(run: Run, test: g.Node, yes: g.Node | None = None, no: g.Node | None = None) -> Any:
    t = run.eval(test)
    if isinstance(t, Area) and t.shape != (1, 1) or isinstance(t, list):
        return run.lift(lambda c, a, b: c if isinstance(c := to_bool(c), GridError) else a if c else b, t, run.eval(yes) if yes else True, run.eval(no) if no else False)
    t = to_bool(t.first() if isinstance(t, Area) else t)
    if isinstance(t, GridError):
        return t
    branch = yes if t else no
    if branch is None:
        return t
    v = run.eval(branch)
    return 0.0 if v is BLANK else v


@function("IFS")
def _ifs(run: Run, *args: g.Node) -> Any:
    for k in range(0, len(args) - 1, 2):
        t = to_bool(run.single(args[k]))
        if isinstance(t, GridError):
            return t
        if t:
            return run.eval(args[k + 1])
    return NA


@function("CHOOSE")
def _choose(run: Run, k: g.Node, *args: g.Node) -> Any:
    k = to_number(run.single(k))
    if isinstance(k, GridError):
        return k
    return run.eval(args[int(k) - 1]) if 1 <= int(k) <= len(args) else VALUE


def _logic(join: Callable) -> Callable:
    def call(run: Run, *args: g.Node) -> Any:
        out = []
        for v, ranged in run.flat(args):
            if isinstance(v, GridError):
                return v
            if ranged and (is_blank(v) or isinstance(v, str)):
                continue
            b = to_bool(v)
            if isinstance(b, GridError):
                return b
            out.append(b)
        return join(out) if out else VALUE

    return call


function("AND")(_logic(all))
function("OR")(_logic(any))
function("XOR")(_logic(lambda xs: sum(xs) % 2 == 1))


def single_value(*names: str) -> Callable:
    """An f of single values, lifted over ranges and arrays; errors among its arguments come first."""

    def put(f: Callable) -> Callable:
        def call(run: Run, *args: g.Node) -> Any:
            def one(*vs: Any) -> Any:
                return next((v for v in vs if isinstance(v, GridError)), None) or f(*vs)

            return run.lift(one, *(run.eval(a) for a in args))

        return function(*names)(call)

    return put


def first_of_range(*names: str) -> Callable:
    """As single_value, but of a range the first cell counts."""

    def put(f: Callable) -> Callable:
        def call(run: Run, *args: g.Node) -> Any:
            vs = [run.single(a) for a in args]
            return next((v for v in vs if isinstance(v, GridError)), None) or f(*vs)

        return function(*names)(call)

    return put


def _numeric(f: Callable) -> Callable:
    def call(*vs: Any) -> Any:
        xs = [to_number(v) for v in vs]
        err = next((x for x in xs if isinstance(x, GridError)), None)
        if err:
            return err
        try:
            return f(*xs)
        except ZeroDivisionError:
            return DIV
        except (ValueError, OverflowError):
            return NUM

    return call


single_value("NOT")(lambda v: b if isinstance(b := to_bool(v), GridError) else not b)


@function("IFERROR")
def _iferror(run: Run, v: g.Node, other: g.Node) -> Any:
    x = run.eval(v)
    if isinstance(x, Area) and x.shape == (1, 1):
        x = x.first()
    if isinstance(x, (Area, list)):
        return run.lift(lambda a, b: b if isinstance(a, GridError) else a, x, run.eval(other))
    return run.eval(other) if isinstance(x, GridError) else x


@function("IFNA")
def _ifna(run: Run, v: g.Node, other: g.Node) -> Any:
    x = run.single(v)
    return run.eval(other) if isinstance(x, GridError) and x.kind == "Na" else x


def _kind(test: Callable[[Any], bool]) -> Callable:
    return lambda run, a: run.lift(test, run.eval(a))


function("ISNUMBER")(_kind(is_number))
function("ISTEXT")(_kind(lambda v: isinstance(v, str)))
function("ISBLANK")(_kind(is_blank))
function("ISERROR")(_kind(lambda v: isinstance(v, GridError)))
function("ISNA")(_kind(lambda v: isinstance(v, GridError) and v.kind == "Na"))
function("ISLOGICAL")(_kind(lambda v: isinstance(v, bool)))


@function("TYPE")
def _type(run: Run, a: g.Node) -> Any:
    v = run.eval(a)
    if isinstance(v, Area):
        v = v.first() if v.shape == (1, 1) else v.grid()
    return 64.0 if isinstance(v, list) else 16.0 if isinstance(v, GridError) else 4.0 if isinstance(v, bool) else 2.0 if isinstance(v, str) else 1.0


@function("TRUE")
def _true(run: Run) -> Any:
    return True


@function("FALSE")
def _false(run: Run) -> Any:
    return False


@function("NA")
def _na(run: Run) -> Any:
    return NA


# numbers

first_of_range("ABS")(_numeric(abs))
single_value("INT")(_numeric(lambda x: float(math.floor(x))))
single_value("SQRT")(_numeric(math.sqrt))
single_value("MOD")(_numeric(lambda n, d: n - d * math.floor(n / d)))
single_value("SIGN")(_numeric(lambda x: float((x > 0) - (x < 0))))
single_value("EXP")(_numeric(math.exp))
single_value("LN")(_numeric(math.log))
single_value("POWER")(_numeric(lambda x, y: x**y))


def rounded(x: float, n: float = 0) -> float:
    """Half away from zero, on the number's shortest decimal form."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-int(n)), rounding=ROUND_HALF_UP)) if abs(x) < 1e15 else float(x)


single_value("ROUND")(_numeric(rounded))
single_value("ROUNDUP")(_numeric(lambda x, n=0: math.copysign(math.ceil(abs(x) * 10 ** int(n)) / 10 ** int(n), x)))
single_value("ROUNDDOWN", "TRUNC")(_numeric(lambda x, n=0: math.copysign(math.floor(abs(x) * 10 ** int(n)) / 10 ** int(n), x)))

# texts

single_value("VALUE")(lambda v: VALUE if isinstance(v, bool) else to_number(v))
first_of_range("LEN")(lambda v: float(len(to_text(v))))
single_value("UPPER")(lambda v: to_text(v).upper())
single_value("LOWER")(lambda v: to_text(v).lower())
single_value("TRIM")(lambda v: " ".join(x for x in to_text(v).split(" ") if x))


@single_value("LEFT")
def _left(v: Any, n: Any = 1.0) -> Any:
    n = to_number(n)
    return n if isinstance(n, GridError) else VALUE if n < 0 else to_text(v)[: int(n)]


@single_value("RIGHT")
def _right(v: Any, n: Any = 1.0) -> Any:
    n = to_number(n)
    return n if isinstance(n, GridError) else VALUE if n < 0 else to_text(v)[-int(n) :] if int(n) else ""


@single_value("MID")
def _mid(v: Any, start: Any, n: Any) -> Any:
    s, n = to_number(start), to_number(n)
    err = next((x for x in (s, n) if isinstance(x, GridError)), None)
    return err or (VALUE if s < 1 or n < 0 else to_text(v)[int(s) - 1 : int(s) - 1 + int(n)])


@function("CONCAT", "CONCATENATE")
def _concat(run: Run, *args: g.Node) -> Any:
    parts = [to_text(v) for v, _ in run.flat(args)]
    return next((p for p in parts if isinstance(p, GridError)), None) or "".join(parts)


@single_value("TEXT")
def _text(v: Any, code: Any) -> Any:
    if isinstance(v, str):
        x = to_number(v)
        v = v if isinstance(x, GridError) else x
    return format_text(0.0 if is_blank(v) else v, to_text(code))


# dates


def _date(v: Any) -> Any:
    if isinstance(v, dt.date):
        return v
    x = to_number(v)
    return x if isinstance(x, GridError) else NUM if x < 0 else from_serial(x)


def _part(of: Callable[[Any], int]) -> Callable:
    return lambda v: d if isinstance(d := _date(v), GridError) else float(of(d))


single_value("YEAR")(_part(lambda d: d.year))
single_value("MONTH")(_part(lambda d: d.month))
single_value("DAY")(_part(lambda d: d.day))


@single_value("EDATE")
def _edate(v: Any, months: Any) -> Any:
    d, m = _date(v), to_number(months)
    for x in (d, m):
        if isinstance(x, GridError):
            return x
    year, month = divmod(d.year * 12 + d.month - 1 + int(m), 12)
    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(d.day, last))


@single_value("DATE")
def _make_date(y: Any, m: Any, d: Any) -> Any:
    y, m, d = (int(to_number(x)) for x in (y, m, d))
    year, month = divmod(y * 12 + m - 1, 12)
    return dt.date(year, month + 1, 1) + dt.timedelta(days=d - 1)


@function("NOW")
def _now(run: Run) -> Any:
    return run.clock.now()


@function("TODAY")
def _today(run: Run) -> Any:
    return run.clock.today()


# lookups


def _vector(run: Run, n: g.Node) -> Any:
    grid = run.grid(n)
    return grid if isinstance(grid, GridError) else [x for row in grid for x in row]


def _exact(key: Any, wild: bool = True) -> Callable[[Any], bool]:
    if isinstance(key, str):
        match = wildcard(key).fullmatch if wild else None
        return lambda v: isinstance(v, str) and (bool(match(v)) if match else v.lower() == key.lower())
    return lambda v: not is_blank(v) and not isinstance(v, GridError) and not isinstance(v, str) and order_key(v) == order_key(0.0 if is_blank(key) else key)


def _below(key: Any, xs: list[Any]) -> int | None:
    """Place of the last value not above key, of its kind, in ascending order."""
    at = None
    for i, v in enumerate(xs):
        if not is_blank(v) and not isinstance(v, GridError) and order_key(v)[0] == order_key(key)[0]:
            if compare(v, key) <= 0:
                at = i
            else:
                break
    return at


def _table(run: Run, key: g.Node, table: g.Node, k: g.Node, near: g.Node | None, rows: bool) -> Any:
    want, grid, k = run.single(key), run.grid(table), to_number(run.single(k))
    approx = True if near is None else to_bool(run.single(near))
    for v in (want, grid, k, approx):
        if isinstance(v, GridError):
            return v
    if not rows:
        grid = [list(c) for c in zip(*grid, strict=True)]
    if k < 1:
        return VALUE
    if k > len(grid[0]):
        return REF
    first = [r[0] for r in grid]
    test = _exact(want)
    at = _below(want, first) if approx else next((i for i, v in enumerate(first) if test(v)), None)
    if at is None:
        return NA
    v = grid[at][int(k) - 1]
    return 0.0 if is_blank(v) else v


@function("VLOOKUP")
def _vlookup(run: Run, key: g.Node, table: g.Node, k: g.Node, near: g.Node | None = None) -> Any:
    return _table(run, key, table, k, near, True)


@function("HLOOKUP")
def _hlookup(run: Run, key: g.Node, table: g.Node, k: g.Node, near: g.Node | None = None) -> Any:
    return _table(run, key, table, k, near, False)


@function("MATCH")
def _match(run: Run, key: g.Node, xs: g.Node, mode: g.Node | None = None) -> Any:
    want, xs, mode = run.single(key), _vector(run, xs), 1.0 if mode is None else to_number(run.single(mode))
    for v in (want, xs, mode):
        if isinstance(v, GridError):
            return v
    if mode == 0:
        test = _exact(want)
        at = next((i for i, v in enumerate(xs) if test(v)), None)
    elif mode > 0:
        at = _below(want, xs)
    else:
        at = None
        for i, v in enumerate(xs):
            if is_blank(v) or isinstance(v, GridError) or compare(v, want) < 0:
                break
            at = i
    return NA if at is None else float(at + 1)


def _xfind(want: Any, xs: list[Any], mode: float, order: float) -> int | None:
    places = range(len(xs)) if order > 0 else range(len(xs) - 1, -1, -1)
    test = _exact(want, mode == 2)
    hit = next((i for i in places if test(xs[i])), None)
    if hit is not None or mode not in (-1, 1):
        return hit
    side = [i for i in places if not is_blank(xs[i]) and not isinstance(xs[i], GridError) and order_key(xs[i])[0] == order_key(want)[0] and compare(xs[i], want) == mode]
    return (max if mode == -1 else min)(side, key=lambda i: order_key(xs[i])) if side else None


@function("XMATCH")
def _xmatch(run: Run, key: g.Node, xs: g.Node, mode: g.Node | None = None, order: g.Node | None = None) -> Any:
    want, xs = run.single(key), _vector(run, xs)
    for v in (want, xs):
        if isinstance(v, GridError):
            return v
    at = _xfind(want, xs, to_number(run.single(mode)) if mode else 0, (to_number(run.single(order)) or 1) if order else 1)
    return NA if at is None else float(at + 1)


@function("XLOOKUP")
def _xlookup(run: Run, key: g.Node, xs: g.Node, values: g.Node, other: g.Node | None = None, mode: g.Node | None = None, order: g.Node | None = None) -> Any:
    want, grid, out = run.single(key), run.grid(xs), run.grid(values)
    for v in (want, grid, out):
        if isinstance(v, GridError):
            return v
    wide = len(grid) == 1 and len(grid[0]) > 1
    flat = [x for row in grid for x in row]
    at = _xfind(want, flat, to_number(run.single(mode)) if mode else 0, (to_number(run.single(order)) or 1) if order else 1)
    if at is None:
        return run.eval(other) if other is not None and not isinstance(other, g.Omit) else NA
    found = [[row[at]] for row in out] if wide else [out[at]]
    return found[0][0] if len(found) == 1 and len(found[0]) == 1 else found


@function("LOOKUP")
def _lookup(run: Run, key: g.Node, xs: g.Node, values: g.Node | None = None) -> Any:
    want, grid = run.single(key), run.grid(xs)
    for v in (want, grid):
        if isinstance(v, GridError):
            return v
    flat = [x for row in grid for x in row] if len(grid) == 1 or len(grid[0]) == 1 or values is not None else [r[0] for r in grid]
    out = _vector(run, values) if values is not None else [r[-1] for r in grid] if len(grid[0]) > 1 and len(grid) > 1 else flat
    numbers = [(i, v) for i, v in enumerate(flat) if not is_blank(v) and not isinstance(v, GridError) and order_key(v)[0] == order_key(want)[0]]
    under = [i for i, v in numbers if compare(v, want) <= 0]
    return out[under[-1]] if under else NA


@function("INDEX")
def _index(run: Run, table: g.Node, row: g.Node | None = None, col: g.Node | None = None) -> Any:
    grid = run.grid(table)
    r = to_number(run.single(row)) if row is not None else 0
    c = to_number(run.single(col)) if col is not None else None
    for v in (grid, r, c):
        if isinstance(v, GridError):
            return v
    if c is None:
        if len(grid) == 1 and len(grid[0]) > 1:
            r, c = 1, r
        else:
            c = 0 if len(grid[0]) > 1 else 1
    if r < 0 or c < 0:
        return VALUE
    if r > len(grid) or c > len(grid[0]):
        return REF
    rows = grid if int(r) == 0 else [grid[int(r) - 1]]
    out = rows if int(c) == 0 else [[x[int(c) - 1]] for x in rows]
    return out[0][0] if len(out) == 1 and len(out[0]) == 1 else out


# positions


@function("ROW")
def _row(run: Run, a: g.Node | None = None) -> Any:
    v = run.eval(a) if a is not None else None
    return [[float(r)] for r in range(v.top, v.bottom + 1)] if isinstance(v, Area) and v.shape[0] > 1 else float(v.top if isinstance(v, Area) else run.here[1])


@function("COLUMN")
def _column(run: Run, a: g.Node | None = None) -> Any:
    v = run.eval(a) if a is not None else None
    return float(v.left if isinstance(v, Area) else run.here[2])


@function("ROWS")
def _rows(run: Run, a: g.Node) -> Any:
    v = run.eval(a)
    return v if isinstance(v, GridError) else float(v.shape[0] if isinstance(v, Area) else len(v) if isinstance(v, list) else 1)


@function("COLUMNS")
def _columns(run: Run, a: g.Node) -> Any:
    v = run.eval(a)
    return v if isinstance(v, GridError) else float(v.shape[1] if isinstance(v, Area) else len(v[0]) if isinstance(v, list) else 1)


@function("ADDRESS")
def _address(run: Run, r: g.Node, c: g.Node, kind: g.Node | None = None) -> Any:
    r, c, k = to_number(run.single(r)), to_number(run.single(c)), int(to_number(run.single(kind))) if kind is not None else 1
    for v in (r, c):
        if isinstance(v, GridError):
            return v
    return f"{'$' if k in (1, 3) else ''}{g.col_letters(int(c))}{'$' if k in (1, 2) else ''}{int(r)}"


@function("CELL")
def _cell(run: Run, what: g.Node, a: g.Node | None = None) -> Any:
    v, want = run.eval(a) if a is not None else None, str(run.single(what)).lower()
    s, r, c = (v.sheet, v.top, v.left) if isinstance(v, Area) else run.here
    return {"row": float(r), "col": float(c), "address": f"${g.col_letters(c)}${r}", "contents": run.value(s, r, c) if isinstance(v, Area) else VALUE}.get(want, VALUE)


@function("INDIRECT")
def _indirect(run: Run, a: g.Node) -> Any:
    text = to_text(run.single(a))
    if isinstance(text, GridError):
        return text
    try:
        return run.eval(g.parse(text))
    except g.ParseError:
        return REF


@function("OFFSET")
def _offset(run: Run, a: g.Node, dr: g.Node, dc: g.Node, h: g.Node | None = None, w: g.Node | None = None) -> Any:
    v = run.eval(a)
    if not isinstance(v, Area):
        return v if isinstance(v, GridError) else VALUE
    n = [to_number(run.single(x)) if x is not None and not isinstance(x, g.Omit) else None for x in (dr, dc, h, w)]
    if err := next((x for x in n if isinstance(x, GridError)), None):
        return err
    top, left = v.top + int(n[0] or 0), v.left + int(n[1] or 0)
    rows, cols = int(n[2] or v.shape[0]), int(n[3] or v.shape[1])
    return REF if top < 1 or left < 1 else Area(run, v.sheet, top, left, top + rows - 1, left + cols - 1)


@function("RAND")
def _rand(run: Run) -> Any:
    return run.rng.random()


@function("RANDBETWEEN")
def _randbetween(run: Run, a: g.Node, b: g.Node) -> Any:
    return float(run.rng.randint(math.ceil(to_number(run.single(a))), math.floor(to_number(run.single(b)))))


@function("INFO")
def _info(run: Run, a: g.Node) -> Any:
    return {"numfile": 1.0, "recalc": "Automatic"}.get(str(run.single(a)).lower(), VALUE)


# arrays


def _int(run: Run, n: g.Node | None, default: int | None) -> Any:
    if n is None or isinstance(n, g.Omit):
        return default
    x = to_number(run.single(n))
    return x if isinstance(x, GridError) else int(x)


def arrays(*names: str) -> Callable:
    """f(run, grid, *trees): the first argument as a grid, errors returned."""

    def put(f: Callable) -> Callable:
        def call(run: Run, a: g.Node, *rest: g.Node) -> Any:
            grid = run.grid(a)
            if isinstance(grid, GridError):
                return grid
            out = f(run, grid, *rest)
            return GridError("Value") if isinstance(out, list) and (not out or not out[0]) else out

        return function(*names)(call)

    return put


def _key(v: Any) -> tuple:
    return (3, 0) if is_blank(v) else (4, 0) if isinstance(v, GridError) else order_key(v)


@arrays("SORT")
def _sort(run: Run, grid: list, index: g.Node | None = None, order: g.Node | None = None, by_col: g.Node | None = None) -> Any:
    i, o = _int(run, index, 1), _int(run, order, 1)
    flip = by_col is not None and to_bool(run.single(by_col))
    grid = [list(c) for c in zip(*grid, strict=True)] if flip else grid
    out = sorted(grid, key=lambda r: _key(r[i - 1]), reverse=o < 0)
    return [list(c) for c in zip(*out, strict=True)] if flip else out


@arrays("SORTBY")
def _sortby(run: Run, grid: list, *by: g.Node) -> Any:
    rows = list(range(len(grid)))
    for k in range(len(by) - 1 - (len(by) - 1) % 2, -1, -2):
        keys, o = _vector(run, by[k]), _int(run, by[k + 1] if k + 1 < len(by) else None, 1)
        rows.sort(key=lambda r: _key(keys[r]), reverse=o < 0)
    return [grid[r] for r in rows]


@arrays("UNIQUE")
def _unique(run: Run, grid: list, by_col: g.Node | None = None, once: g.Node | None = None) -> Any:
    flip = by_col is not None and to_bool(run.single(by_col))
    rows = [list(c) for c in zip(*grid, strict=True)] if flip else grid
    n = Counter(tuple(map(_key, r)) for r in rows)
    seen, out, single = set(), [], once is not None and to_bool(run.single(once))
    for r in rows:
        k = tuple(map(_key, r))
        if k not in seen and (not single or n[k] == 1):
            out.append(r)
        seen.add(k)
    return [list(c) for c in zip(*out, strict=True)] if flip and out else out


@arrays("FILTER")
def _filter(run: Run, grid: list, keep: g.Node, empty: g.Node | None = None) -> Any:
    k = run.grid(keep)
    if isinstance(k, GridError):
        return k
    tests = [to_bool(v) for row in k for v in row]
    if err := next((t for t in tests if isinstance(t, GridError)), None):
        return err
    out = [r for r, ok in zip(grid, tests, strict=False) if ok] if len(k) > 1 or len(grid) == 1 else [[v for v, ok in zip(r, tests, strict=False) if ok] for r in grid]
    return out if out and out[0] else run.eval(empty) if empty is not None else VALUE


@arrays("TAKE")
def _take(run: Run, grid: list, rows: g.Node | None = None, cols: g.Node | None = None) -> Any:
    r, c = _int(run, rows, None), _int(run, cols, None)
    cut = lambda xs, n: xs if n is None else xs[:n] if n >= 0 else xs[n:]
    return [cut(row, c) for row in cut(grid, r)]


@arrays("DROP")
def _drop(run: Run, grid: list, rows: g.Node | None = None, cols: g.Node | None = None) -> Any:
    r, c = _int(run, rows, 0), _int(run, cols, 0)
    cut = lambda xs, n: xs[n:] if n >= 0 else xs[:n]
    return [cut(row, c) for row in cut(grid, r)]


@function("SEQUENCE")
def _sequence(run: Run, rows: g.Node, cols: g.Node | None = None, start: g.Node | None = None, step: g.Node | None = None) -> Any:
    r, c = _int(run, rows, 1), _int(run, cols, 1)
    a, d = (to_number(run.single(x)) if x is not None and not isinstance(x, g.Omit) else 1.0 for x in (start, step))
    return [[a + d * (i * c + j) for j in range(c)] for i in range(r)] if r > 0 and c > 0 else VALUE


arrays("TRANSPOSE")(lambda run, grid: [list(c) for c in zip(*grid, strict=True)])


def _places(run: Run, args: tuple[g.Node, ...], n: int) -> Any:
    out = []
    for v, _ in run.flat(args):
        k = int(to_number(v))
        if not 1 <= abs(k) <= n:
            return VALUE
        out.append(k - 1 if k > 0 else n + k)
    return out


@arrays("CHOOSECOLS")
def _choosecols(run: Run, grid: list, *args: g.Node) -> Any:
    at = _places(run, args, len(grid[0]))
    return at if isinstance(at, GridError) else [[r[k] for k in at] for r in grid]


@arrays("CHOOSEROWS")
def _chooserows(run: Run, grid: list, *args: g.Node) -> Any:
    at = _places(run, args, len(grid))
    return at if isinstance(at, GridError) else [grid[k] for k in at]


def _listed(run: Run, grid: list, skip: g.Node | None, by_col: g.Node | None) -> list:
    rows = zip(*grid, strict=True) if by_col is not None and to_bool(run.single(by_col)) else grid
    s = _int(run, skip, 0)
    return [v for r in rows for v in r if not (s in (1, 3) and is_blank(v) or s in (2, 3) and isinstance(v, GridError))]


arrays("TOCOL")(lambda run, grid, skip=None, by_col=None: [[v] for v in _listed(run, grid, skip, by_col)])
arrays("TOROW")(lambda run, grid, skip=None, by_col=None: [_listed(run, grid, skip, by_col)])


def _wrapped(run: Run, grid: list, n: g.Node, pad: g.Node | None = None) -> Any:
    xs, n, fill = [v for r in grid for v in r], _int(run, n, 1), run.single(pad) if pad is not None else NA
    if n < 1:
        return NUM
    return [(xs[i : i + n] + [fill] * n)[:n] for i in range(0, len(xs), n)]


arrays("WRAPROWS")(_wrapped)
arrays("WRAPCOLS")(lambda run, grid, n, pad=None: w if isinstance(w := _wrapped(run, grid, n, pad), GridError) else [list(c) for c in zip(*w, strict=True)])


@arrays("EXPAND")
def _expand(run: Run, grid: list, rows: g.Node, cols: g.Node | None = None, pad: g.Node | None = None) -> Any:
    r, c, fill = _int(run, rows, len(grid)), _int(run, cols, len(grid[0])), run.single(pad) if pad is not None else NA
    if r < len(grid) or c < len(grid[0]):
        return VALUE
    return [(grid[i] + [fill] * c)[:c] if i < len(grid) else [fill] * c for i in range(r)]


@function("MUNIT")
def _munit(run: Run, n: g.Node) -> Any:
    k = _int(run, n, 1)
    return [[float(i == j) for j in range(k)] for i in range(k)] if k > 0 else VALUE


@function("MAKEARRAY")
def _makearray(run: Run, rows: g.Node, cols: g.Node, f: g.Node) -> Any:
    r, c = _int(run, rows, 1), _int(run, cols, 1)
    if r < 1 or c < 1:
        return VALUE
    return [[run.single(g.Invoke(f, (g.Num(float(i + 1)), g.Num(float(j + 1))))) for j in range(c)] for i in range(r)]


@function("LAMBDA")
def _lambda(run: Run, *args: g.Node) -> Any:
    return GridError("Value")


@function("RANDARRAY")
def _randarray(run: Run, rows: g.Node | None = None, cols: g.Node | None = None) -> Any:
    return [[run.rng.random() for _ in range(_int(run, cols, 1))] for _ in range(_int(run, rows, 1))]


@function("TEXTSPLIT")
def _textsplit(run: Run, text: g.Node, by_col: g.Node | None = None, by_row: g.Node | None = None) -> Any:
    t = to_text(run.single(text))
    if isinstance(t, GridError):
        return t
    sep = lambda n: to_text(run.single(n)) if n is not None and not isinstance(n, g.Omit) else ""
    c, r = sep(by_col), sep(by_row)
    rows = [x.split(c) if c else [x] for x in (t.split(r) if r else [t])]
    width = max(map(len, rows))
    return [row + [NA] * (width - len(row)) for row in rows]


def _stack(run: Run, args: tuple[g.Node, ...], down: bool) -> Any:
    grids = [run.grid(a) for a in args]
    if err := next((x for x in grids if isinstance(x, GridError)), None):
        return err
    if not down:
        grids = [[list(c) for c in zip(*x, strict=True)] for x in grids]
    width = max(len(x[0]) for x in grids)
    out = [row + [NA] * (width - len(row)) for x in grids for row in x]
    return out if down else [list(c) for c in zip(*out, strict=True)]


function("VSTACK")(lambda run, *args: _stack(run, args, True))
function("HSTACK")(lambda run, *args: _stack(run, args, False))

__all__ = ["rounded", "NAME", "to_serial"]
