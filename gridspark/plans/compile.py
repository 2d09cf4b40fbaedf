"""Formula columns compiled to Spark columns.

A `Grid` is an ordered table whose columns have letters. A formula filled down from a row is one template; it compiles to
one expression over the row, to window frames over neighbouring rows, to joins for lookups, and to scalars of one shared
aggregate for whole columns. A compiled value carries its kind and, only where it can fail, a column with the error's kind.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark import grammar as g
from gridspark.functions.values import split_criterion
from gridspark.model import RunClock, to_serial
from gridspark.operators import criteria, lookups
from gridspark.operators.frames import BLOCK_ROWS, ROW, block_window, haloed, median_of, running, with_rows


class NotCompilable(ValueError):
    """The formula has no column form; the reason says which strategy is left."""


@dataclass
class Val:
    value: Column
    kind: str  # number, text, bool, date, time or blank
    err: Column | None = None
    constant: Any = None


def no_error() -> Column:
    return F.lit(None).cast("string")


def kind_of(spark_type: str) -> str:
    if spark_type in ("string",) or spark_type.startswith(("char", "varchar")):
        return "text"
    if spark_type == "boolean":
        return "bool"
    if spark_type in ("date",):
        return "date"
    if spark_type.startswith("timestamp"):
        return "time"
    if spark_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or spark_type.startswith("decimal"):
        return "number"
    raise NotCompilable(f"cells of type {spark_type}")


def first_error(*errs: Column | None) -> Column | None:
    have = [e for e in errs if e is not None]
    return None if not have else have[0] if len(have) == 1 else F.coalesce(*have)


def number_text(x: Column) -> Column:
    """A number as text: up to 15 significant digits, no trailing zeros."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,14)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(whole, x.cast("bigint").cast("string")).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e15), plain).otherwise(x.cast("string"))


@dataclass
class Grid:
    """columns: letters to names of df's columns. order: names that order the rows (dense: one, of consecutive numbers); without
    any, formulas that ask for neighbouring rows cannot run, and nothing is sorted or numbered. others: further sheets by name. names: workbook names to absolute cells or ranges. decimals: sums of numbers are exact at so many
    places (None: sums of doubles, whose last digits depend on how rows are dealt out)."""

    df: DataFrame
    columns: dict[str, str]
    order: Sequence[str]
    dense: bool = False
    others: dict[str, Grid] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    decimals: int | None = None
    clock: RunClock = field(default_factory=RunClock)
    block_rows: int = BLOCK_ROWS
    minus_first: bool = False

    def __post_init__(self):
        self.formulas: dict[str, tuple[g.Node, int]] = {}
        self.report: list[dict[str, Any]] = []
        self._numbered: DataFrame | None = None
        self._count: int | None = None

    def fill(self, letter: str, formula: str, *, at: int = 1, name: str | None = None) -> Grid:
        """Puts the formula into this column from row `at` down; earlier rows keep what the column has, or are blank."""
        self.formulas[letter.upper()] = (g.parse(formula, self.minus_first), at)
        self.columns.setdefault(letter.upper(), name or letter.upper())
        return self

    def numbered(self) -> DataFrame:
        if self._numbered is None:
            self._numbered = self.df if ROW in self.df.columns or not self.order else with_rows(self.df, self.order, dense=self.dense)
        return self._numbered

    def count(self) -> int:
        """Number of rows."""
        if self._count is None:
            self._count = self.df.count()
        return self._count

    def kinds(self) -> dict[str, str]:
        return {l: kind_of(t) for l, n in self.columns.items() for c, t in self.df.dtypes if c == n}

    def run(self) -> DataFrame:
        """All columns of df, `_row`, each formula column and, where it may fail, `<name>_err` with the kind of error."""
        return Compiler(self).run()

    def explain(self) -> list[dict[str, Any]]:
        """Column, strategy and what it needs, without evaluating anything."""
        return Compiler(self).plan()


AGGREGATES = {"SUM", "COUNT", "COUNTA", "MIN", "MAX", "AVERAGE", "COUNTBLANK", "MEDIAN", "MODE", "PRODUCT", "STDEV", "VAR", "LARGE", "SMALL", "SUMPRODUCT", "MINA", "MAXA", "AVERAGEA", "STDEVA", "VARA", "COUNTIF", "SUMIF", "AVERAGEIF", "COUNTIFS", "SUMIFS", "AVERAGEIFS", "MINIFS", "MAXIFS"}

CRITERIA = {"COUNTIF", "SUMIF", "AVERAGEIF", "COUNTIFS", "SUMIFS", "AVERAGEIFS", "MINIFS", "MAXIFS"}


def criteria_of(n: g.Call) -> tuple[g.Node, ...]:
    """The criteria among the arguments of a function of criteria."""
    return n.args[1:2] if n.name[-1] == "F" else n.args[1::2] if n.name == "COUNTIFS" else n.args[2::2]


class Compiler:
    def __init__(self, grid: Grid):
        self.grid = grid
        self.letters = {g.col_number(l): l for l in grid.columns}
        self.kinds = grid.kinds()
        self.scalars: dict[int | str, list[tuple[str, Column]]] = {}
        self.reads: set[str] = set()  # own columns that the aggregate being compiled reads
        self.sheets: dict[int, Grid] = {}
        self.shifts: set[int] = set()
        self.frames: list[tuple[str, Column, int, int]] = []
        self.runnings: dict[str, tuple[str, Column]] = {}
        self.errs: set[str] = set()
        self.df: DataFrame | None = None
        self.n = 0
        self.own = 0  # the column being compiled: offsets are from here

    # order of columns

    def ordered(self) -> list[str]:
        need = {l: {self.letters[c] for n in g.walk(t) for c in self._columns(n)} & set(self.grid.formulas) - {l} for l, (t, _) in self.grid.formulas.items()}
        out: list[str] = []
        while len(out) < len(need):
            ready = sorted((l for l in need if l not in out and need[l] <= set(out)), key=g.col_number)
            if not ready:
                raise NotCompilable("columns depend on each other in a circle")
            out += ready
        return out

    def arranged(self) -> list[str]:
        """The order of evaluation: columns that move rows and what they read come first, so that rows move without the columns
        that each makes of itself. As written where references are computed, since these do not tell what they read."""
        plain = self.ordered()
        trees = {l: t for l, (t, _) in self.grid.formulas.items()}
        if any(g.calls(t) & g.DYNAMIC for t in trees.values()):
            return plain
        early: set[str] = set()
        for l in reversed(plain):
            tree, at = self.grid.formulas[l]
            if l in early or self.strategy(l, tree, at) != "columnar":
                early |= {l, *(self.letters[c] for n in g.walk(tree) for c in self._columns(n))}
        return [l for l in plain if l in early] + [l for l in plain if l not in early]

    def _columns(self, n: g.Node) -> list[int]:
        if isinstance(n, g.Name) and n.name.lower() in {k.lower() for k in self.grid.names}:
            return [c for x in g.walk(self.target(n.name)) if not isinstance(x, g.Name) for c in self._columns(x)]
        if isinstance(n, g.Ref) and n.sheet is None:
            return [n.col] if n.col in self.letters else []
        if isinstance(n, g.Range) and n.sheet is None:
            return [c for c in self.letters if (n.left or 1) <= c <= (n.right or max(self.letters))]
        return []

    def plan(self) -> list[dict[str, Any]]:
        out = []
        for letter in self.ordered():
            tree, at = self.grid.formulas[letter]
            out.append({"column": letter, "formula": "=" + g.printed(tree), "strategy": self.strategy(letter, tree, at)})
        return out

    def strategy(self, letter: str, tree: g.Node, at: int) -> str:
        t = g.relative(tree, at, g.col_number(letter))
        own = [n for n in g.walk(t) if isinstance(n, g.Ref) and n.sheet is None and not n.abs_row and not n.abs_col and n.col == 0]
        names = g.calls(t)
        if own:
            return "prefix" if self._chain(t) else "ordered_fold"
        if names & (g.LOOKUPS | {"INDEX"}) or any(not isinstance(a, (g.Num, g.Str, g.Bool, g.Unary)) for n in g.walk(t) if isinstance(n, g.Call) and n.name in CRITERIA for a in criteria_of(n)):
            return "join"
        if any(isinstance(n, g.Ref) and not n.abs_row and n.row for n in g.walk(t)) or any(isinstance(n, g.Range) and (n.top is not None and not n.flags[0] or n.bottom is not None and not n.flags[2]) and (n.top, n.bottom) != (0, 0) for n in g.walk(t)):
            return "window"
        return "columnar"

    def run(self) -> DataFrame:
        self.df = self.grid.numbered()
        for letter in self.arranged():
            tree, at = self.grid.formulas[letter]
            self.column(letter, g.relative(tree, at, g.col_number(letter)), at)
        made = [c for l in self.ordered() for c in (self.grid.columns[l], f"{self.grid.columns[l]}_err")]
        asked = list(dict.fromkeys(c for c in [*self.grid.numbered().columns, *made] if c in self.df.columns))
        return self.df if asked == self.df.columns else self.df.select(*("`" + c.replace("`", "``") + "`" for c in asked))

    def fresh(self, stem: str) -> str:
        self.n += 1
        return f"_{stem}{self.n}"

    def column(self, letter: str, t: g.Node, at: int) -> None:
        name, self.own = self.grid.columns[letter], g.col_number(letter)
        old = F.col(name) if name in self.df.columns else None
        chain = self._chain(t)
        if chain:
            return self.prefix(letter, name, chain, at, old)
        if any(isinstance(n, g.Ref) and n.sheet is None and not n.abs_col and n.col == 0 for n in g.walk(t)):
            raise NotCompilable("a recurrence that is not linear: use ordered_fold")
        self.scalars, self.frames, self.runnings = {}, [], {}
        val = self.expr(t)
        self.settle()
        value, err = val.value, val.err
        if val.kind == "number":
            value = value.cast("double")
        if err is not None:
            value = F.when(err.isNull(), value)
        if at > 1:
            value = F.when(F.col(ROW) >= at, value).otherwise(old) if old is not None else F.when(F.col(ROW) >= at, value)
            err = None if err is None else F.when(F.col(ROW) >= at, err)
        self.df = self.df.withColumn(name, value)
        if err is not None:
            self.df = self.df.withColumn(f"{name}_err", err)
            self.errs.add(letter)
        self.kinds[letter] = val.kind
        self.df = self.df.drop(*[c for c in self.df.columns if c[0] == "_" and c != ROW])

    # what an expression asked for, before it is used

    def settle(self) -> None:
        for key, wanted in self.scalars.items():
            source = self.df if key == "made" else self.grid.numbered() if key == "given" else self.sheets[key].numbered()
            self.df = self.df.crossJoin(F.broadcast(source.agg(*(c.alias(a) for a, c in wanted))))  # one row
        if self.runnings:
            self.df = running(self.df, self.runnings, block_rows=self.grid.block_rows)
        if self.frames:
            before = max(0, *(-lo for _, _, lo, _ in self.frames), *(-hi for *_, hi in self.frames))
            after = max(0, *(hi for *_, hi in self.frames), *(lo for _, _, lo, _ in self.frames))
            out = haloed(self.df, before, after, self.grid.block_rows)
            for alias, c, lo, hi in self.frames:
                out = out.withColumn(alias, c.over(block_window().rowsBetween(lo, hi)))
            self.df = out.where("_own").drop("_own", "_block")

    def scalar(self, c: Column, sheet: Grid | None = None, letters: set[str] | None = None) -> Column:
        """An aggregate as one value. letters: the own columns it reads; the table as given answers, where that has them, so
        that no join or frame of other columns is made again for it."""
        made = (self.reads if letters is None else letters) & set(self.grid.formulas)
        key = id(sheet) if sheet is not None else "made" if made else "given"
        if sheet is not None:
            self.sheets[key] = sheet
        alias = self.fresh("s")
        self.scalars.setdefault(key, []).append((alias, c))
        return F.col(alias)

    def framed(self, c: Column, lo: int, hi: int) -> Column:
        alias = self.fresh("w")
        self.frames.append((alias, c, lo, hi))
        return F.col(alias)

    # recurrences

    def _chain(self, t: g.Node) -> tuple[int, g.Node, int] | None:
        """(k, increment, sign) of `own cell k rows above + increment` or `- increment`."""

        def own(n: g.Node) -> int | None:
            return -n.row if isinstance(n, g.Ref) and n.sheet is None and not n.abs_row and not n.abs_col and n.col == 0 and n.row < 0 else None

        if isinstance(t, g.Op) and t.op in "+-":
            for a, b in ((t.left, t.right), (t.right, t.left)):
                k = own(a)
                if k and not any(isinstance(x, g.Ref) and x.col == 0 and not x.abs_col for x in g.walk(b)) and (t.op == "+" or a is t.left):
                    return k, b, -1 if t.op == "-" else 1
        return None

    def prefix(self, letter: str, name: str, chain: tuple[int, g.Node, int], at: int, old: Column | None) -> None:
        """A running total from the rows above the first formula: within each residue of the row number, if the step is deeper."""
        k, more, sign = chain
        self.scalars, self.frames, self.runnings = {}, [], {}
        val = self.number(self.expr(more))
        self.settle()
        start = old if old is not None else F.lit(0.0)
        value = F.when(F.col(ROW) < at, F.coalesce(start.cast("double"), F.lit(0.0)) if old is not None else F.lit(0.0)).otherwise(sign * F.coalesce(val.value, F.lit(0.0)))
        value = F.when(F.col(ROW) >= at - k, value).otherwise(F.lit(0.0))
        total, keys = self.fresh("t"), []
        df = self.df
        if k > 1:
            df, keys = df.withColumn("_residue", F.pmod(F.col(ROW), F.lit(k))), ["_residue"]
        if self.grid.decimals is not None:
            value = value.cast(f"decimal(18,{self.grid.decimals})")
        bad = None if val.err is None else F.when(F.col(ROW) >= at, val.err)
        totals = {total: ("sum", value)}
        if bad is not None:  # once an error, always one
            totals["_bad"] = ("min", F.when(bad.isNotNull(), F.struct(F.col(ROW).alias("r"), bad.alias("e"))))
        df = running(df, totals, keys=keys, block_rows=self.grid.block_rows)
        out = F.when(F.col(ROW) >= at, F.col(total).cast("double")).otherwise(old.cast("double") if old is not None else F.lit(None).cast("double"))
        if bad is not None:
            df = df.withColumn(f"{name}_err", F.col("_bad.e"))
            out = F.when(F.col("_bad.e").isNull() | (F.col(ROW) < at), out)
            self.errs.add(letter)
        self.df = df.withColumn(name, out)
        self.df = self.df.drop(*[c for c in self.df.columns if c[0] == "_" and c != ROW])
        self.kinds[letter] = "number"

    # coercions

    def number(self, v: Val) -> Val:
        if v.kind == "number":
            return Val(F.coalesce(v.value.cast("double"), F.lit(0.0)) if v.constant is None else v.value, "number", v.err, v.constant)
        if v.kind == "blank":
            return Val(F.lit(0.0), "number", v.err)
        if v.kind == "bool":
            return Val(F.coalesce(v.value.cast("double"), F.lit(0.0)), "number", v.err)
        if v.kind == "date":
            days = F.datediff(v.value, F.lit("1899-12-30").cast("date"))
            return Val(F.coalesce(days - F.when(days <= 60, 1).otherwise(0), F.lit(0)).cast("double"), "number", v.err)
        if v.kind == "time":
            seconds = F.unix_micros(v.value.cast("timestamp")) / F.lit(1e6)
            return Val(seconds / 86400 + 25569.0, "number", v.err)
        x = F.trim(v.value).try_cast("double")
        bad = F.when(v.value.isNotNull() & x.isNull(), F.lit("Value"))
        return Val(F.coalesce(x, F.lit(0.0)), "number", first_error(v.err, bad))

    def text(self, v: Val) -> Val:
        if v.kind == "text":
            return Val(F.coalesce(v.value, F.lit("")), "text", v.err, v.constant)
        if v.kind == "blank":
            return Val(F.lit(""), "text", v.err)
        if v.kind == "bool":
            return Val(F.coalesce(F.upper(v.value.cast("string")), F.lit("")), "text", v.err)
        return Val(F.coalesce(number_text((v.value if v.kind == "number" else self.number(v).value).cast("double")), F.lit("")), "text", v.err)

    def truth(self, v: Val) -> Val:
        if v.kind == "bool":
            return Val(F.coalesce(v.value, F.lit(False)), "bool", v.err)
        if v.kind == "text":
            up = F.upper(F.trim(v.value))
            bad = F.when(v.value.isNotNull() & ~up.isin("TRUE", "FALSE"), F.lit("Value"))
            return Val(F.coalesce(up == "TRUE", F.lit(False)), "bool", first_error(v.err, bad))
        n = self.number(v)
        return Val(n.value != 0, "bool", n.err)

    # expressions

    def expr(self, n: g.Node) -> Val:
        match n:
            case g.Num(v):
                return Val(F.lit(float(v)), "number", None, v)
            case g.Str(v):
                return Val(F.lit(v), "text", None, v)
            case g.Bool(v):
                return Val(F.lit(v), "bool", None, v)
            case g.Err(kind):
                return Val(F.lit(None).cast("double"), "number", F.lit(kind))
            case g.Omit():
                return Val(F.lit(None).cast("double"), "blank")
            case g.Group(a):
                return self.expr(a)
            case g.Ref():
                return self.cell(n)
            case g.Name(name):
                return self.expr(self.target(name))
            case g.Range() if n.top == n.bottom and n.left == n.right:
                return self.cell(g.Ref(n.sheet, n.top, n.left, n.flags[0], n.flags[1]))
            case g.Unary(op, a):
                x = self.expr(a)
                return x if op == "+" else Val(-self.number(x).value, "number", self.number(x).err, None if x.constant is None else -x.constant)
            case g.Postfix("%", a):
                x = self.number(self.expr(a))
                return Val(x.value / 100, "number", x.err)
            case g.Op(op, a, b):
                return self.operator(op, self.expr(a), self.expr(b))
            case g.Invoke(g.Call("LAMBDA", params), args):
                bound = {p.name.upper(): a for p, a in zip(params[:-1], args, strict=True)}
                return self.expr(g.rebuilt(params[-1], lambda x: bound.get(x.name.upper(), x) if isinstance(x, g.Name) else x))
            case g.Call(name, args):
                if name in AGGREGATES:
                    return self.aggregate(name, args)
                f = getattr(self, f"f_{name.lower().replace('.', '_')}", None)
                if f is None:
                    from gridspark.interp import FUNCTIONS

                    if name in FUNCTIONS or name in g.ARRAY_CAPABLE | g.DYNAMIC | g.NONDETERMINISTIC:
                        raise NotCompilable(f"{name} has no column form here")
                    return Val(F.lit(None).cast("double"), "number", F.lit("Name"))
                return f(*args)
        raise NotCompilable(g.printed(n))

    def target(self, name: str) -> g.Node:
        for k, text in self.grid.names.items():
            if k.lower() == name.lower():
                return g.parse(text)
        return g.Err("Name")

    def sheet(self, name: str | None) -> Grid | None:
        if name is None:
            return None
        for k, grid in self.grid.others.items():
            if k.lower() == name.lower():
                return grid
        raise KeyError(name)

    def source(self, letter: str, sheet: Grid | None = None) -> Val:
        if sheet is not None:
            return Val(F.col(sheet.columns[letter]), sheet.kinds()[letter])
        name = self.grid.columns[letter]
        self.reads.add(letter)
        return Val(F.col(name), self.kinds[letter], F.col(f"{name}_err") if letter in self.errs else None)

    def column_of(self, col: int, fixed: bool) -> int:
        return col if fixed else col + self.own

    def cell(self, n: g.Ref) -> Val:
        try:
            sheet = self.sheet(n.sheet)
        except KeyError:
            return Val(F.lit(None).cast("double"), "number", F.lit("Ref"))
        letter = g.col_letters(self.column_of(n.col, n.abs_col))
        where = self.grid if sheet is None else sheet
        if letter not in where.columns:
            return Val(F.lit(None).cast("double"), "blank")
        v = self.source(letter, sheet)
        if n.abs_row:
            here = F.col(ROW) == n.row
            err = None if v.err is None else self.scalar(F.max(F.when(here, v.err)), sheet, {letter})
            return Val(self.scalar(F.max(F.when(here, v.value)), sheet, {letter}), v.kind, err)
        if sheet is not None:
            other = sheet.numbered().select((F.col(ROW) - n.row).alias("_r"), v.value.alias(alias := self.fresh("o")))
            self.df = self.df.join(other, F.col(ROW) == F.col("_r"), "left").drop("_r")
            return Val(F.col(alias), v.kind)
        if n.row == 0:
            return v
        err = None if v.err is None else self.framed(F.first(v.err), n.row, n.row)
        return Val(self.framed(F.first(v.value), n.row, n.row), v.kind, err)

    def operator(self, op: str, a: Val, b: Val) -> Val:
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return self.comparison(op, a, b)
        if op == "&":
            x, y = self.text(a), self.text(b)
            return Val(F.concat(x.value, y.value), "text", first_error(x.err, y.err))
        x, y = self.number(a), self.number(b)
        err = first_error(x.err, y.err)
        if op == "/":
            bad = None if y.constant not in (None, 0, 0.0) else F.when(y.value == 0, F.lit("Div"))
            return Val(F.try_divide(x.value, y.value), "number", first_error(err, bad))
        if op == "^":
            r = F.power(x.value, y.value)
            bad = F.when((x.value == 0) & (y.value < 0), F.lit("Div")).when(((x.value == 0) & (y.value == 0)) | F.isnan(r) | F.abs(r).isin(float("inf")), F.lit("Num"))
            return Val(r, "number", first_error(err, bad))
        r = {"+": x.value + y.value, "-": x.value - y.value, "*": x.value * y.value}[op]
        if op in "+-" and (a.kind == "date") != (b.kind == "date") and not (op == "-" and b.kind == "date"):
            return Val(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(r).cast("int")), "date", err)
        return Val(r, "number", err)

    def comparison(self, op: str, a: Val, b: Val) -> Val:
        rank = {"number": 0, "date": 0, "time": 0, "text": 1, "bool": 2}
        if a.kind == "blank":
            a = Val(F.lit(None).cast({"text": "string", "bool": "boolean"}.get(b.kind, "double")), b.kind if b.kind != "blank" else "number", a.err)
        if b.kind == "blank":
            b = Val(F.lit(None).cast({"text": "string", "bool": "boolean"}.get(a.kind, "double")), a.kind, b.err)
        if rank[a.kind] != rank[b.kind]:
            less = rank[a.kind] < rank[b.kind]
            return Val(F.lit({"=": False, "<>": True, "<": less, "<=": less, ">": not less, ">=": not less}[op]), "bool", first_error(a.err, b.err))
        if a.kind == "text":
            x, y = F.lower(F.coalesce(a.value, F.lit(""))), F.lower(F.coalesce(b.value, F.lit("")))
        elif a.kind == "bool":
            x, y = self.truth(a).value, self.truth(b).value
        else:
            x, y = self.number(a).value, self.number(b).value
        test = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        return Val(test, "bool", first_error(a.err, b.err))

    # aggregates

    def area(self, n: g.Node) -> tuple[Grid | None, list[str], g.Range]:
        if isinstance(n, g.Name):
            n = self.target(n.name)
        if isinstance(n, g.Ref):
            n = g.as_range(n)
        if not isinstance(n, g.Range):
            raise NotCompilable(f"not a range: {g.printed(n)}")
        sheet = self.sheet(n.sheet)
        where = self.grid if sheet is None else sheet
        left = 1 if n.left is None else self.column_of(n.left, n.flags[1])
        right = max(map(g.col_number, where.columns)) if n.right is None else self.column_of(n.right, n.flags[3])
        return sheet, [l for l in map(g.col_letters, range(left, right + 1)) if l in where.columns], n

    def over(self, n: g.Range, sheet: Grid | None):
        """How to put an aggregate over the range: a function of (aggregate of a column, column), and which rows are meant."""
        fixed = lambda v, flag: v is None or flag
        if fixed(n.top, n.flags[0]) and fixed(n.bottom, n.flags[2]):
            inside = F.lit(True)
            if n.top is not None and n.top > 1:
                inside = inside & (F.col(ROW) >= n.top)
            if n.bottom is not None:
                inside = inside & (F.col(ROW) <= n.bottom)
            return "fixed", inside
        if sheet is not None:
            raise NotCompilable("a moving range on another sheet")
        if not fixed(n.top, n.flags[0]) and not fixed(n.bottom, n.flags[2]):
            return "moving", (min(n.top, n.bottom), max(n.top, n.bottom))
        if fixed(n.top, n.flags[0]) and n.bottom == 0:
            return "growing", F.col(ROW) >= (n.top or 1)
        raise NotCompilable("a range with a fixed end below")

    def agg(self, n: g.Node, make, merge) -> Column:
        """make(column, kind, rows meant) is an aggregate of one column; merge joins those of several."""
        sheet, letters, r = self.area(n)
        how, rows = self.over(r, sheet)
        parts = []
        for letter in letters:
            v = self.source(letter, sheet)
            if how == "fixed":
                parts.append(self.scalar(make(v.value, v.kind, rows), sheet))
            elif how == "moving":
                parts.append(self.framed(make(v.value, v.kind, F.lit(True)), *rows))
            else:
                alias = self.fresh("r")
                self.runnings[alias] = self._running_kind(make, v, rows)
                parts.append(F.col(alias))
        return reduce(merge, parts) if parts else F.lit(None).cast("double")

    def _running_kind(self, make, v: Val, rows: Column) -> tuple[str, Column]:
        kind = getattr(make, "running", None)
        if kind is None:
            raise NotCompilable("this aggregate has no running form")
        return kind, make.inner(v.value, v.kind, rows)

    def _exact(self, c: Column) -> Column:
        return c if self.grid.decimals is None else c.cast(f"decimal(18,{self.grid.decimals})")

    def sum_of(self, n: g.Node, where: Column | None = None) -> Column:
        def inner(c: Column, kind: str, rows: Column) -> Column:
            x = c if kind == "number" else self.number(Val(c, kind)).value if kind in ("date", "time") else F.lit(None).cast("double")
            ok = rows if where is None else rows & where
            return F.when(ok & c.isNotNull(), self._exact(x))

        return F.coalesce(self.agg(n, _maker("sum", inner), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("double"), F.lit(0.0))

    def count_of(self, n: g.Node, any_kind: bool = False, blank: bool = False, where: Column | None = None) -> Column:
        def inner(c: Column, kind: str, rows: Column) -> Column:
            counted = c.isNull() | (c == "") if blank and kind == "text" else c.isNull() if blank else c.isNotNull() if any_kind or kind in ("number", "date", "time") else F.lit(False)
            return F.when(counted & (rows if where is None else rows & where), F.lit(1))

        return F.coalesce(self.agg(n, _maker("count", inner), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), F.lit(0)).cast("double")

    def errors_in(self, nodes: tuple[g.Node, ...]) -> Column | None:
        found = []
        for n in nodes:
            if isinstance(n, (g.Ref, g.Range)) and n.sheet is None:
                _, letters, r = self.area(n)
                for letter in letters:
                    if letter in self.errs:
                        err = F.col(f"{self.grid.columns[letter]}_err")
                        how, rows = self.over(r, None)
                        first = F.min(F.when(err.isNotNull() & (rows if how != "moving" else F.lit(True)), F.struct(F.col(ROW).alias("r"), err.alias("e"))))
                        if how == "growing":
                            self.runnings[alias := self.fresh("e")] = ("min", F.when(err.isNotNull() & rows, F.struct(F.col(ROW).alias("r"), err.alias("e"))))
                            found.append(F.col(alias)["e"])
                        else:
                            found.append((self.scalar(first, letters={letter}) if how == "fixed" else self.framed(first, *rows))["e"])
        return first_error(*found)

    def aggregate(self, name: str, args: tuple[g.Node, ...]) -> Val:
        outer, self.reads = self.reads, set()
        try:
            return self._aggregate(name, args)
        finally:
            self.reads |= outer

    def _aggregate(self, name: str, args: tuple[g.Node, ...]) -> Val:
        ranges = tuple(a for a in args if isinstance(a, (g.Range, g.Ref, g.Name)))
        if name in ("COUNTIF", "SUMIF", "AVERAGEIF", "COUNTIFS", "SUMIFS", "AVERAGEIFS", "MINIFS", "MAXIFS"):
            return self.by_criteria(name, args)
        err = self.errors_in(ranges) if name not in ("COUNT", "COUNTA", "COUNTBLANK") else None
        loose = [self.number(self.expr(a)) for a in args if a not in ranges]
        if name == "COUNTBLANK":
            return Val(self.count_of(args[0], blank=True), "number")
        if name in ("COUNT", "COUNTA"):
            total = reduce(lambda a, b: a + b, [self.count_of(r, name == "COUNTA") for r in ranges], F.lit(float(len(loose))))
            return Val(total, "number")
        err = first_error(err, *(x.err for x in loose))
        if name == "SUM":
            return Val(reduce(lambda a, b: a + b, [self.sum_of(r) for r in ranges] + [x.value for x in loose]), "number", err)
        if name == "AVERAGE":
            total = reduce(lambda a, b: a + b, [self.sum_of(r) for r in ranges] + [x.value for x in loose])
            n = reduce(lambda a, b: a + b, [self.count_of(r) for r in ranges], F.lit(float(len(loose))))
            return Val(F.try_divide(total, n), "number", first_error(err, F.when(n == 0, F.lit("Div"))))
        if name in ("MIN", "MAX"):
            pick = F.least if name == "MIN" else F.greatest

            def inner(c: Column, kind: str, rows: Column) -> Column:
                return F.when(rows, c.cast("double") if kind == "number" else self.number(Val(c, kind)).value if kind in ("date", "time") else F.lit(None).cast("double"))

            parts = [self.agg(r, _maker(name.lower(), inner), pick) for r in ranges] + [x.value for x in loose]
            return Val(F.coalesce(pick(*parts) if len(parts) > 1 else parts[0], F.lit(0.0)), "number", err)
        if name == "SUMPRODUCT":
            sides = [self.area(a) for a in args]
            _, rows = self.over(sides[0][2], sides[0][0])
            cols = [[self.source(l, s).value for l in ls] for s, ls, _ in sides]
            terms = [reduce(lambda a, b: a * b, t) for t in zip(*cols, strict=True)]
            total = self.scalar(reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.when(rows, t if self.grid.decimals is None else t.cast(f"decimal(28,{2 * self.grid.decimals})"))), F.lit(0)) for t in terms]), sides[0][0])
            return Val(total.cast("double"), "number", err)
        # of one fixed range: no frame form
        sheet, letters, r = self.area(args[0])
        how, rows = self.over(r, sheet)
        if how != "fixed" or len(letters) != 1:
            raise NotCompilable(f"{name} over a moving range")
        v = self.source(letters[0], sheet)
        x = F.when(rows, v.value.cast("double")) if v.kind == "number" else F.lit(None).cast("double")
        if name.endswith("A"):
            x = F.when(rows & v.value.isNotNull(), F.lit(0.0) if v.kind == "text" else v.value.cast("double"))
        n = self.scalar(F.count(x), sheet)
        if name in ("LARGE", "SMALL"):
            k = self.number(self.expr(args[1]))
            if k.constant is None:
                raise NotCompilable(f"{name} with a moving rank")
            # ties count: the k-th of all values, by counts of distinct values
            return self.ranked(name, x, int(k.constant), n, sheet, err)
        if name == "MODE":
            top = self.mode_of(x, sheet)
            return Val(top[0], "number", first_error(err, F.when(F.coalesce(top[1], F.lit(0)) < 2, F.lit("Na"))))
        if name == "MEDIAN":
            alias = self.fresh("d")
            self.df = self.df.crossJoin(F.broadcast(median_of(self.rows_of({letters[0]}, sheet).select(x), alias)))  # one row
            return Val(F.col(alias), "number", first_error(err, F.when(n < 1, F.lit("Num"))))
        made = {
            "PRODUCT": (F.coalesce(F.product(x), F.lit(0.0)), None, 0), "STDEV": (F.stddev_samp(x), "Div", 2), "VAR": (F.var_samp(x), "Div", 2),
            "MINA": (F.coalesce(F.min(x), F.lit(0.0)), None, 0), "MAXA": (F.coalesce(F.max(x), F.lit(0.0)), None, 0), "AVERAGEA": (F.avg(x), "Div", 1), "STDEVA": (F.stddev_samp(x), "Div", 2), "VARA": (F.var_samp(x), "Div", 2),
        }
        c, kind, least = made[name]
        bad = None if kind is None else F.when(n < least, F.lit(kind))
        return Val(self.scalar(c, sheet), "number", first_error(err, bad))

    def ranked(self, name: str, x: Column, k: int, n: Column, sheet: Grid | None, err: Column | None) -> Val:
        """The k-th largest or smallest: top k of the distinct values with their counts, so a task keeps k values."""
        source = (self.df if sheet is None else sheet.numbered()).select(x.alias("x")).where("x is not null").groupBy("x").count()
        order = F.desc("x") if name == "LARGE" else F.asc("x")
        top = source.orderBy(order).limit(k) if k > 0 else source.limit(0)
        from pyspark.sql import Window

        total = F.sum("count").over(Window.orderBy(order))
        alias = self.fresh("k")
        kth = top.select("x", total.alias("t")).where(F.col("t") >= k).agg((F.max if name == "LARGE" else F.min)("x").alias(alias))
        self.df = self.df.crossJoin(F.broadcast(kth))  # one row
        return Val(F.col(alias), "number", first_error(err, F.when(F.col(alias).isNull(), F.lit("Num"))))

    def mode_of(self, x: Column, sheet: Grid | None) -> tuple[Column, Column]:
        rows = (self.df if sheet is None else sheet.numbered()).select(x.alias("x"), ROW).where("x is not null")
        a, b = self.fresh("m"), self.fresh("m")
        top = rows.groupBy("x").agg(F.count("*").alias("n"), F.min(ROW).alias("r")).agg(F.max_by(F.struct("x", "n"), F.struct("n", -F.col("r"))).alias("t"))
        self.df = self.df.crossJoin(F.broadcast(top.select(F.col("t.x").alias(a), F.col("t.n").alias(b))))  # one row
        return F.col(a), F.col(b)

    def by_criteria(self, name: str, args: tuple[g.Node, ...]) -> Val:
        many = name.endswith("S")
        if name in ("COUNTIF", "COUNTIFS"):
            values, pairs = args[0], args
        elif many:
            values, pairs = args[0], args[1:]
        else:
            values, pairs = (args[2] if len(args) > 2 else args[0]), args[:2]
        where, sheets = None, []
        for rng, crit in zip(pairs[::2], pairs[1::2], strict=True):
            c = self.expr(crit) if isinstance(crit, (g.Num, g.Str, g.Bool, g.Unary)) else None
            if c is None or c.constant is None:
                return self.by_row(name, args, list(zip(pairs[::2], pairs[1::2], strict=True)), values)
            sheet, letters, _ = self.area(rng)
            sheets.append(sheet)
            if len(letters) != 1:
                raise NotCompilable("criteria over several columns")
            v = self.source(letters[0], sheet)
            test = criteria.predicate(v.value, v.kind, c.constant)
            where = test if where is None else where & test
        if name in ("COUNTIF", "COUNTIFS"):
            sheet, _, r = self.area(args[0])
            how, rows = self.over(r, sheet)
            if how == "moving":
                return Val(self.framed(F.count(F.when(where, 1)), *rows).cast("double"), "number")
            if how == "growing":
                self.runnings[alias := self.fresh("r")] = ("count", F.when(rows & where, 1))
                return Val(F.coalesce(F.col(alias), F.lit(0)).cast("double"), "number")
            return Val(self.scalar(F.count(F.when(rows & where, 1)), sheet).cast("double"), "number")
        if name in ("SUMIF", "SUMIFS"):
            return Val(self.sum_of(values, where), "number", self.errors_in((values,)))
        if name in ("AVERAGEIF", "AVERAGEIFS"):
            n = self.count_of(values, where=where)
            return Val(F.try_divide(self.sum_of(values, where), n), "number", first_error(self.errors_in((values,)), F.when(n == 0, F.lit("Div"))))
        kind = "min" if name == "MINIFS" else "max"
        c = self.agg(values, _maker(kind, lambda c, k, rows: F.when(rows & where, c.cast("double"))), F.least if kind == "min" else F.greatest)
        return Val(F.coalesce(c, F.lit(0.0)), "number", self.errors_in((values,)))

    def by_row(self, name: str, args: tuple[g.Node, ...], where: list[tuple[g.Node, g.Node]], values: g.Node) -> Val:
        """A function of criteria of which some follow the row: equal keys are joined, an ordered one is a running measure."""
        sheet, _, r = self.area(where[0][0])
        how, rows = self.over(r, sheet)
        if how != "fixed":
            raise NotCompilable("a criterion that follows the row over a moving range")
        pairs, turned, read, keyed = [], False, set(), set()
        for rng, crit in where:
            other, letters, n = self.area(rng)
            if other is not sheet or len(letters) != 1 or (n.top, n.bottom) != (r.top, r.bottom):
                raise NotCompilable("criteria that follow the row need columns of the same rows")
            v = self.source(letters[0], sheet)
            read.add(letters[0])
            constant = self.expr(crit) if isinstance(crit, (g.Num, g.Str, g.Bool, g.Unary)) else None
            if v.err is not None:
                raise NotCompilable("criteria over a column that holds errors")
            if constant is not None and constant.constant is not None:
                rows = rows & criteria.predicate(v.value, v.kind, constant.constant)
                continue
            joined = isinstance(crit, g.Op) and crit.op == "&" and isinstance(crit.left, g.Str) and crit.left.value in ("<=", "<", "=", ">", ">=", "<>")
            op, cell = (crit.left.value, crit.right) if joined else ("=", crit)
            if not isinstance(cell, g.Ref) or cell.row or cell.abs_row or cell.sheet is not None:
                raise NotCompilable("a criterion that is no cell of the row")
            key = self.cell(cell)
            keyed.add(g.col_letters(self.column_of(cell.col, cell.abs_col)))
            if key.err is not None or key.kind != v.kind or v.kind not in ("number", "text") and (joined or v.kind not in ("date", "bool")) or v.kind == "text" and op[0] in "<>" and op != "<>":
                raise NotCompilable(f"a criterion of kind {key.kind} that follows the row over cells of kind {v.kind}")
            turned = turned or op == "<>"
            pairs.append((*self._keys(v, key, joined, self.rows_of(keyed)), "=" if op == "<>" else op))
        if turned and (len(pairs) > 1 or name.startswith(("MIN", "MAX")) or not name.startswith("COUNT") and self.grid.decimals is None) or sum(op != "=" for *_, op in pairs) > 1:
            raise NotCompilable("criteria of several kinds that follow the row")
        a, b = self.fresh("c"), self.fresh("c")
        if name.startswith("COUNT"):
            measures = {a: ("count", F.lit(1))}
        else:
            other, letters, n = self.area(values)
            v = self.source(letters[0], sheet)
            if other is not sheet or len(letters) != 1 or (n.top, n.bottom) != (r.top, r.bottom) or v.err is not None or v.kind != "number":
                raise NotCompilable(f"{name} needs a column of numbers of the same rows")
            measures = {a: ("sum", self._exact(v.value.cast("double"))), b: ("count", v.value)} if name[:3] not in ("MIN", "MAX") else {a: (name[:3].lower(), v.value.cast("double"))}
        base = self.rows_of({*read, *([letters[0]] if not name.startswith("COUNT") else [])}, sheet).where(rows)
        self.df = criteria.by_row(self.df, base, [(v, op, k) for v, k, op in pairs], measures, asked=self.rows_of(keyed))
        zero = lambda x: F.coalesce(F.col(x), F.lit(0))
        found = {x: zero(x) for x in measures}
        if turned:  # all less those that are equal
            made = {"count": F.count, "sum": F.sum}
            found = {x: F.coalesce(self.scalar_over(base, made[kind](c)), F.lit(0)) - found[x] for x, (kind, c) in measures.items()}
        if name.startswith("AVERAGE"):
            n = found[b].cast("double")
            return Val(F.try_divide(found[a].cast("double"), n), "number", F.when(n == 0, F.lit("Div")))
        return Val(found[a].cast("double"), "number")

    def scalar_over(self, rows: DataFrame, c: Column) -> Column:
        alias = self.fresh("s")
        self.df = self.df.crossJoin(F.broadcast(rows.agg(c.alias(alias))))  # one row
        return F.col(alias)

    def rows_of(self, letters: set[str], sheet: Grid | None = None) -> DataFrame:
        """Rows that hold these columns: the table as given, where that has them, so that plans of many formulas stay short."""
        if sheet is not None:
            return sheet.numbered()
        return self.df if letters & set(self.grid.formulas) else self.grid.numbered()

    def _keys(self, v: Val, key: Val, joined: bool, asked: DataFrame) -> tuple[Column, Column]:
        """Cells and keys as columns that are equal where the criterion is met. Texts compare without case; a blank key after an
        operator meets blanks, alone it meets empty texts too."""
        if v.kind == "number":
            return v.value.cast("double"), key.value.cast("double")
        if v.kind != "text":
            return v.value, key.value
        k = key.value
        written = k.rlike(r"[*?~]") | k.rlike(r"^[<>=]") | k.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*%?\s*$") | k.rlike(r"^\s*[0-9]{4}-?(W|[0-9]{2})") | F.upper(k).isin("TRUE", "FALSE")
        if not asked.where(written).select(F.lit(1)).isEmpty():
            raise NotCompilable("a moving text criterion that is a pattern, a comparison or a number")
        low = F.lower(v.value)
        cells = F.when(v.value.isNull(), F.lit("")).when(v.value != "", low) if joined else F.coalesce(low, F.lit(""))
        return cells, F.coalesce(F.lower(k), F.lit(""))

    # functions

    def f_if(self, test: g.Node, yes: g.Node = g.Bool(True), no: g.Node = g.Bool(False)) -> Val:
        t, a, b = self.truth(self.expr(test)), self.expr(yes), self.expr(no)
        a, b = self.alike(a, b)
        err = None if a.err is None and b.err is None else F.when(t.value, a.err if a.err is not None else no_error()).otherwise(b.err if b.err is not None else no_error())
        return Val(F.when(t.value, a.value).otherwise(b.value), a.kind, first_error(t.err, err))

    def alike(self, a: Val, b: Val) -> tuple[Val, Val]:
        """Two branches as values of one kind; a column cannot hold cells of mixed kinds."""
        if a.kind == "blank":
            a = Val(F.lit(0.0), "number", a.err)
        if b.kind == "blank":
            b = Val(F.lit(0.0), "number", b.err)
        if a.kind == b.kind:
            return (Val(a.value.cast("double"), a.kind, a.err), Val(b.value.cast("double"), b.kind, b.err)) if a.kind == "number" else (a, b)
        raise NotCompilable(f"branches of kinds {a.kind} and {b.kind}")

    def f_ifs(self, *args: g.Node) -> Val:
        out = Val(F.lit(None).cast("double"), "number", F.lit("Na"))
        first = True
        for k in range(len(args) - 2, -1, -2):
            t, a = self.truth(self.expr(args[k])), self.expr(args[k + 1])
            if first:
                out, first = Val(F.lit(None).cast({"text": "string", "bool": "boolean", "date": "date"}.get(a.kind, "double")), a.kind if a.kind != "blank" else "number", F.lit("Na")), False
            a, out = self.alike(a, out)
            err = F.when(t.value, a.err if a.err is not None else no_error()).otherwise(out.err if out.err is not None else no_error())
            out = Val(F.when(t.value, a.value).otherwise(out.value), a.kind, first_error(t.err, err))
        return out

    def f_choose(self, k: g.Node, *args: g.Node) -> Val:
        i = self.number(self.expr(k))
        at = F.floor(i.value)
        vals = [self.expr(a) for a in args]
        for j in range(1, len(vals)):
            vals[0], vals[j] = self.alike(vals[0], vals[j])
        vals = [self.alike(v, vals[0])[0] for v in vals]
        value, err = F.lit(None), F.when((at < 1) | (at > len(vals)), F.lit("Value"))
        for j, v in enumerate(vals):
            value = F.when(at == j + 1, v.value).otherwise(value)
            if v.err is not None:
                err = F.coalesce(err, F.when(at == j + 1, v.err))
        return Val(value, vals[0].kind, first_error(i.err, err))

    def logic(self, args: tuple[g.Node, ...], join) -> Val:
        ts = [self.truth(self.expr(a)) for a in args]
        return Val(reduce(join, [t.value for t in ts]), "bool", first_error(*(t.err for t in ts)))

    def f_and(self, *args: g.Node) -> Val:
        return self.logic(args, lambda a, b: a & b)

    def f_or(self, *args: g.Node) -> Val:
        return self.logic(args, lambda a, b: a | b)

    def f_not(self, a: g.Node) -> Val:
        t = self.truth(self.expr(a))
        return Val(~t.value, "bool", t.err)

    def f_iferror(self, a: g.Node, b: g.Node) -> Val:
        x, y = self.expr(a), self.expr(b)
        if x.err is None:
            return x
        p, q = self.alike(x, y)
        err = None if y.err is None else F.when(x.err.isNotNull(), y.err)
        return Val(F.when(x.err.isNotNull(), q.value).otherwise(p.value), p.kind, err)

    def f_isnumber(self, a: g.Node) -> Val:
        x = self.expr(a)
        ok = x.value.isNotNull() if x.kind in ("number", "date", "time") else F.lit(False)
        return Val(ok if x.err is None else ok & x.err.isNull(), "bool")

    def f_iserror(self, a: g.Node) -> Val:
        x = self.expr(a)
        return Val(F.lit(False) if x.err is None else x.err.isNotNull(), "bool")

    def f_type(self, a: g.Node) -> Val:
        x = self.expr(a)
        code = F.lit({"text": 2.0, "bool": 4.0}.get(x.kind, 1.0))
        code = F.when(x.value.isNull(), F.lit(1.0)).otherwise(code)
        return Val(code if x.err is None else F.when(x.err.isNotNull(), F.lit(16.0)).otherwise(code), "number")

    def numeric(self, a: g.Node, f, bad=None) -> Val:
        x = self.number(self.expr(a))
        return Val(f(x.value), "number", first_error(x.err, bad(x.value) if bad else None))

    def f_abs(self, a: g.Node) -> Val:
        return self.numeric(a, F.abs)

    def f_int(self, a: g.Node) -> Val:
        return self.numeric(a, lambda x: F.floor(x).cast("double"))

    def f_sqrt(self, a: g.Node) -> Val:
        return self.numeric(a, lambda x: F.sqrt(x), lambda x: F.when(x < 0, F.lit("Num")))

    def f_mod(self, a: g.Node, b: g.Node) -> Val:
        x, y = self.number(self.expr(a)), self.number(self.expr(b))
        return Val(x.value - y.value * F.floor(F.try_divide(x.value, y.value)), "number", first_error(x.err, y.err, F.when(y.value == 0, F.lit("Div"))))

    def f_round(self, a: g.Node, n: g.Node = g.Num(0.0)) -> Val:
        x, k = self.number(self.expr(a)), self.expr(n)
        if k.constant is None:
            raise NotCompilable("ROUND to a moving number of places")
        return Val(F.round(x.value, int(k.constant)), "number", x.err)

    def f_value(self, a: g.Node) -> Val:
        return self.number(self.expr(a))

    def f_len(self, a: g.Node) -> Val:
        t = self.text(self.expr(a))
        return Val(F.length(t.value).cast("double"), "number", t.err)

    def f_upper(self, a: g.Node) -> Val:
        t = self.text(self.expr(a))
        return Val(F.upper(t.value), "text", t.err)

    def f_lower(self, a: g.Node) -> Val:
        t = self.text(self.expr(a))
        return Val(F.lower(t.value), "text", t.err)

    def f_left(self, a: g.Node, n: g.Node = g.Num(1.0)) -> Val:
        t, k = self.text(self.expr(a)), self.number(self.expr(n))
        return Val(F.substring(t.value, F.lit(1), k.value.cast("int")), "text", first_error(t.err, k.err, F.when(k.value < 0, F.lit("Value"))))

    def f_right(self, a: g.Node, n: g.Node = g.Num(1.0)) -> Val:
        t, k = self.text(self.expr(a)), self.number(self.expr(n))
        return Val(F.right(t.value, k.value.cast("int")), "text", first_error(t.err, k.err, F.when(k.value < 0, F.lit("Value"))))

    def f_mid(self, a: g.Node, s: g.Node, n: g.Node) -> Val:
        t, i, k = self.text(self.expr(a)), self.number(self.expr(s)), self.number(self.expr(n))
        bad = F.when((i.value < 1) | (k.value < 0), F.lit("Value"))
        return Val(F.substring(t.value, F.greatest(i.value, F.lit(1.0)).cast("int"), k.value.cast("int")), "text", first_error(t.err, i.err, k.err, bad))

    def f_concat(self, *args: g.Node) -> Val:
        ts = [self.text(self.expr(a)) for a in args]
        return Val(F.concat(*(t.value for t in ts)), "text", first_error(*(t.err for t in ts)))

    f_concatenate = f_concat

    def f_text(self, a: g.Node, code: g.Node) -> Val:
        """Formats of fixed decimals (with or without thousands) and of day, month and year."""
        import re

        x, fmt = self.expr(a), self.expr(code).constant
        if not isinstance(fmt, str):
            raise NotCompilable("TEXT with a moving format")
        if re.fullmatch(r"(#,##)?0(\.0+)?", fmt):
            v, places = self.number(x), len(fmt.partition(".")[2])
            shown = F.format_number(F.round(v.value, places), places)
            return Val(shown if "," in fmt else F.regexp_replace(shown, ",", ""), "text", v.err)
        parts = {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d"}
        found = re.findall(r"[ymd]+|[^ymd]", fmt.lower())
        if all(p in parts or re.fullmatch(r"[-/. ]", p) for p in found):
            day = self.as_date(x)
            return Val(F.date_format(day.value, "".join(parts.get(p, p) for p in found)), "text", day.err)
        raise NotCompilable(f"TEXT with the format {fmt}")

    def as_date(self, x: Val) -> Val:
        if x.kind == "date":
            return x
        if x.kind == "time":
            return Val(x.value.cast("date"), "date", x.err)
        n = self.number(x)
        days = F.floor(n.value).cast("int")
        return Val(F.date_add(F.lit("1899-12-30").cast("date"), days + F.when((days > 0) & (days < 60), 1).otherwise(0)), "date", first_error(n.err, F.when(n.value < 0, F.lit("Num"))))

    def f_year(self, a: g.Node) -> Val:
        d = self.as_date(self.expr(a))
        return Val(F.year(d.value).cast("double"), "number", d.err)

    def f_month(self, a: g.Node) -> Val:
        d = self.as_date(self.expr(a))
        return Val(F.month(d.value).cast("double"), "number", d.err)

    def f_day(self, a: g.Node) -> Val:
        d = self.as_date(self.expr(a))
        return Val(F.dayofmonth(d.value).cast("double"), "number", d.err)

    def f_edate(self, a: g.Node, n: g.Node) -> Val:
        d, k = self.as_date(self.expr(a)), self.number(self.expr(n))
        return Val(F.add_months(d.value, k.value.cast("int")), "date", first_error(d.err, k.err))

    def f_today(self) -> Val:
        return Val(F.lit(self.grid.clock.today()), "date")

    def f_now(self) -> Val:
        return Val(F.lit(to_serial(self.grid.clock.now())), "number")

    def f_rand(self) -> Val:
        return Val(F.rand(seed=int(self.grid.clock.utc.timestamp())), "number")

    def f_randbetween(self, a: g.Node, b: g.Node) -> Val:
        x, y = self.number(self.expr(a)), self.number(self.expr(b))
        return Val(F.floor(F.rand(seed=int(self.grid.clock.utc.timestamp())) * (F.floor(y.value) - F.ceil(x.value) + 1)) + F.ceil(x.value), "number", first_error(x.err, y.err))

    def f_row(self, a: g.Node | None = None) -> Val:
        if a is None:
            return Val(F.col(ROW).cast("double"), "number")
        if isinstance(a, g.Ref):
            return Val(F.lit(float(a.row)) if a.abs_row else (F.col(ROW) + a.row).cast("double"), "number")
        raise NotCompilable("ROW of a range")

    def f_rows(self, a: g.Node) -> Val:
        sheet, _, r = self.area(a)
        if r.top is None:
            return Val(F.lit(float(g.MAX_ROW)), "number")
        if (r.flags[0], r.flags[2]) == (True, False):
            return Val((F.col(ROW) + r.bottom - r.top + 1).cast("double"), "number")
        return Val(F.lit(float(r.bottom - r.top + 1)), "number")

    def f_columns(self, a: g.Node) -> Val:
        _, _, r = self.area(a)
        return Val(F.lit(float(r.right - r.left + 1)) if r.left is not None else F.lit(float(g.MAX_COL)), "number")

    def f_address(self, r: g.Node, c: g.Node) -> Val:
        x, y = self.number(self.expr(r)), self.expr(c)
        if y.constant is None:
            raise NotCompilable("ADDRESS of a moving column")
        return Val(F.concat(F.lit(f"${g.col_letters(int(y.constant))}$"), x.value.cast("long").cast("string")), "text", x.err)

    # lookups

    def comparable(self, want: Val, where: Grid, letter: str, near: bool, wild: bool = False) -> None:
        """Refuses lookups that cells of one kind cannot answer: text among numbers, order of text, patterns."""
        texts = {want.kind == "text", (where.kinds() if where is not self.grid else self.kinds)[letter] == "text"}
        if len(texts) > 1:
            raise NotCompilable("a lookup of text among numbers, or of a number among text")
        if True in texts and (near or wild and re.search(r"[*?~]", str(want.constant or ""))):
            raise NotCompilable("a lookup of text by its order or by a pattern")

    def keyed(self, v: Val, n: g.Node | None = None) -> str:
        """The column that holds the key n. A cell of the row is its own column, so that joins by one key share one shuffle."""
        self.settle_now()
        if isinstance(n, g.Ref) and n.sheet is None and not n.row and not n.abs_row:
            letter = g.col_letters(self.column_of(n.col, n.abs_col))
            if letter in self.grid.columns:
                return self.grid.columns[letter]
        alias = self.fresh("q")
        self.df = self.df.withColumn(alias, v.value)
        return alias

    def settle_now(self) -> None:
        """Puts what has been asked for so far into the table, so a join can follow."""
        self.settle()
        self.scalars, self.frames, self.runnings = {}, [], {}

    def table(self, n: g.Node) -> tuple[Grid, DataFrame, list[str]]:
        sheet, letters, r = self.area(n)
        how, rows = self.over(r, sheet)
        if how != "fixed":
            raise NotCompilable("a lookup in a moving table")
        where = self.grid if sheet is None else sheet
        base = (self.df if sheet is None else sheet.numbered()).where(rows)
        return where, base, letters

    def exact(self, key: Val, n: g.Node, xs: g.Node, value: str | None, alias: str, *, last: bool = False) -> None:
        """Adds alias: the value in the first row of xs whose first column equals the key n (value None: the row's place in xs)."""
        where, base, letters = self.table(xs)
        sheet, _, r = self.area(xs)
        q, first = self.keyed(key, n), where.columns[letters[0]]
        given = sheet is not None or not {first, value} & {self.grid.columns[l] for l in self.grid.formulas}
        if given and sheet is None:
            base = self.grid.numbered().where(self.over(r, None)[1])
        slim = base.select(ROW, F.col(first).alias("_tk"), (F.col(value) if value else (F.col(ROW) - ((r.top or 1) - 1)).cast("double")).alias("_tv"))
        many = given and self.rows_in(where, r) > lookups.BROADCAST_ROWS and lookups.many_keys(where.df, first)
        self.df = lookups.exact(self.df, q, slim, "_tk", "_tv", alias, last=last, many=many)

    def rows_in(self, where: Grid, r: g.Range) -> int:
        """How many rows of a fixed range there are at most, counted only where the range itself is long."""
        span = None if r.bottom is None else r.bottom - (r.top or 1) + 1
        return where.count() if span is None else span if span <= lookups.BROADCAST_ROWS else min(span, where.count())

    def found(self, alias: str, kind: str, key: Val) -> Val:
        return Val(F.col(alias), kind, first_error(key.err, F.col(f"{alias}_err")))

    def f_vlookup(self, key: g.Node, table: g.Node, k: g.Node, near: g.Node = g.Bool(True)) -> Val:
        want, i, approx = self.expr(key), self.expr(k).constant, self.expr(near).constant
        if i is None or approx is None:
            raise NotCompilable("VLOOKUP with a moving column or mode")
        where, base, letters = self.table(table)
        if i < 1 or i > len(letters):
            return Val(F.lit(None).cast("double"), "number", F.lit("Value" if i < 1 else "Ref"))
        kinds = where.kinds() if where is not self.grid else self.kinds
        self.comparable(want, where, letters[0], bool(approx), True)
        alias, first, value = self.fresh("v"), where.columns[letters[0]], where.columns[letters[int(i) - 1]]
        if approx:
            q = self.keyed(want)
            self.df = lookups.nearest(self.df, q, base.select(F.col(first).alias("_tk"), F.col(value).alias("_tv")), "_tk", "_tv", alias)
        else:
            self.exact(want, key, table, value, alias)
        return self.found(alias, kinds[letters[int(i) - 1]], want)

    def f_match(self, key: g.Node, xs: g.Node, mode: g.Node = g.Num(1.0)) -> Val:
        want, m = self.expr(key), self.expr(mode).constant
        where, base, letters = self.table(xs)
        if m is None or len(letters) != 1:
            raise NotCompilable("MATCH with a moving mode or several columns")
        self.comparable(want, where, letters[0], m != 0, True)
        alias, (_, _, r) = self.fresh("v"), self.area(xs)
        if m == 0:
            self.exact(want, key, xs, None, alias)
        else:
            q = self.keyed(want)
            slim = base.select(F.col(where.columns[letters[0]]).alias("_tk"), (F.col(ROW) - ((r.top or 1) - 1)).cast("double").alias("_place"))
            self.df = lookups.nearest(self.df, q, slim, "_tk", "_place", alias, above=m < 0)
        return self.found(alias, "number", want)

    def f_xlookup(self, key: g.Node, xs: g.Node, values: g.Node, other: g.Node = g.Omit(), mode: g.Node = g.Num(0.0), order: g.Node = g.Num(1.0)) -> Val:
        want, m, o = self.expr(key), self.expr(mode).constant, self.expr(order).constant
        where, base, letters = self.table(xs)
        _, _, out = self.table(values)
        if len(letters) != 1 or len(out) != 1 or m not in (0, 1, -1) or o not in (1, -1):
            raise NotCompilable("XLOOKUP over several columns, with wildcards or by halves")
        kinds = where.kinds() if where is not self.grid else self.kinds
        self.comparable(want, where, letters[0], m != 0)
        alias = self.fresh("v")
        if m == 0:
            self.exact(want, key, xs, where.columns[out[0]], alias, last=o < 0)
        else:
            q = self.keyed(want)
            slim = base.select(F.col(where.columns[letters[0]]).alias("_tk"), F.col(where.columns[out[0]]).alias("_tv"))
            self.df = lookups.nearest(self.df, q, slim, "_tk", "_tv", alias, above=m > 0)
        hit = self.found(alias, kinds[out[0]], want)
        if isinstance(other, g.Omit):
            return hit
        a, b = self.alike(hit, self.expr(other))
        return Val(F.when(F.col(f"{alias}_err").isNotNull(), b.value).otherwise(a.value), a.kind, first_error(want.err, b.err))

    def f_lookup(self, key: g.Node, xs: g.Node, values: g.Node | None = None) -> Val:
        where, base, letters = self.table(xs)
        _, _, out = self.table(values) if values is not None else (None, None, letters)
        want = self.expr(key)
        kinds = where.kinds() if where is not self.grid else self.kinds
        q, alias = self.keyed(want), self.fresh("v")
        slim = base.select(ROW, F.col(where.columns[letters[0]]).alias("_tk"), F.col(where.columns[out[-1]]).alias("_tv"))
        self.df = lookups.nearest(self.df, q, slim, "_tk", "_tv", alias)
        return self.found(alias, kinds[out[-1]], want)

    def f_index(self, table: g.Node, row: g.Node, col: g.Node = g.Num(1.0)) -> Val:
        where, base, letters = self.table(table)
        c, (_, _, rng) = self.expr(col).constant, self.area(table)
        if c is None or not 1 <= c <= len(letters):
            raise NotCompilable("INDEX with a moving column")
        letter = letters[int(c) - 1]
        kinds = where.kinds() if where is not self.grid else self.kinds
        matched = self._matched(table, row)
        if matched is not None:
            want, alias = self.expr(matched[0]), self.fresh("v")
            self.comparable(want, where, self.area(matched[1])[1][0], False, True)
            self.exact(want, *matched, where.columns[letter], alias)
            return self.found(alias, kinds[letter], want)
        r = self.number(self.expr(row))
        q, alias = self.keyed(Val(F.when(r.err.isNull(), r.value) if r.err is not None else r.value, "number")), self.fresh("v")
        slim = base.select((F.col(ROW) - ((rng.top or 1) - 1)).alias(ROW), F.col(where.columns[letter]).alias("_tv"))
        self.df = lookups.at_row(self.df, q, slim, "_tv", alias, many=self.rows_in(where, rng) > lookups.BROADCAST_ROWS)
        return Val(F.col(alias), kinds[letter], first_error(r.err, F.col(f"{alias}_err")))

    def _matched(self, table: g.Node, row: g.Node) -> tuple[g.Node, g.Node] | None:
        """(key, keys) of INDEX(table, MATCH(key, keys, 0)) over the same rows: the value stands in the row of the match, so one
        lookup finds it and the place is not looked up in turn."""
        while isinstance(row, g.Group):
            row = row.arg
        if not isinstance(row, g.Call) or row.name != "MATCH" or len(row.args) != 3 or row.args[2] not in (g.Num(0.0), g.Bool(False)):
            return None
        (a, _, r), (b, letters, x) = self.area(table), self.area(row.args[1])
        return row.args[:2] if a is b and len(letters) == 1 and (r.top, r.bottom) == (x.top, x.bottom) else None

    def f_offset(self, base: g.Node, dr: g.Node, dc: g.Node = g.Num(0.0)) -> Val:
        """Of a cell by constant steps: the cell there. By a computed number of rows from a fixed cell: INDEX of its column."""
        rows, cols = self.expr(dr), self.expr(dc).constant
        if not isinstance(base, g.Ref) or cols is None:
            raise NotCompilable("OFFSET of a range or to a moving column")
        if rows.constant is not None:
            return self.cell(g.Ref(base.sheet, base.row + int(rows.constant), base.col + int(cols), base.abs_row, base.abs_col))
        if not base.abs_row:
            raise NotCompilable("OFFSET by computed rows from a moving cell")
        col = self.column_of(base.col, base.abs_col) + int(cols)
        return self.f_index(g.Range(base.sheet, None, col, None, col, (True, True, True, True)), g.Op("+", dr, g.Num(float(base.row))))

    def f_indirect(self, text: g.Node) -> Val:
        """Of a constant address, or of a constant column joined to a computed row."""
        if isinstance(text, g.Str):
            return self.expr(g.rebuilt(g.parse(text.value), _pinned))
        if isinstance(text, g.Op) and text.op == "&" and isinstance(text.left, g.Str) and text.left.value.replace("$", "").isalpha():
            c = g.col_number(text.left.value.replace("$", ""))
            return self.f_index(g.Range(None, None, c, None, c, (True, True, True, True)), text.right)
        raise NotCompilable("INDIRECT of a computed address")


def _pinned(n: g.Node) -> g.Node:
    from dataclasses import replace

    if isinstance(n, g.Ref):
        return replace(n, abs_row=True, abs_col=True)
    return replace(n, flags=(True,) * 4) if isinstance(n, g.Range) else n


def _maker(kind: str, inner):
    def make(c: Column, k: str, rows: Column) -> Column:
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](inner(c, k, rows))

    make.running, make.inner = kind, inner
    return make


__all__ = ["Grid", "Compiler", "NotCompilable", "split_criterion"]
