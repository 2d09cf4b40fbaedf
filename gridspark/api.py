"""Workbooks in, values out: rows, grids, plans and component statistics.

Pieces of a workbook are evaluated on Spark: regular formula columns as compiled columns, irregular ones by component in
Arrow-fed Python tasks, what cannot be divided in one task. Every run sees one clock.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession

from gridspark import grammar as g
from gridspark.interp import Book, Run
from gridspark.model import GridError, RunClock, is_blank
from gridspark.plans import planner as P
from gridspark.sources.xlsx import kept_blanks

Values = dict[P.Key, Any]


def to_python(v: Any) -> Any:
    """A value as callers get it: errors as dictionaries, blanks as None, numbers as float."""
    if isinstance(v, GridError):
        return v.to_dict()
    if is_blank(v):
        return None
    if isinstance(v, list):
        return [[to_python(x) for x in row] for row in v]
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def _clock(now: dt.datetime | None) -> RunClock:
    if now is None:
        return RunClock()
    offset = now.utcoffset()
    return RunClock((now if offset is not None else now.replace(tzinfo=dt.UTC)).astimezone(dt.UTC).replace(microsecond=0), int(offset.total_seconds() // 60) if offset else 0)


def book_of(t: P.Topology, keys: list[P.Key] | None = None) -> Book:
    """A book of all formulas, or of those given with the cells that they read."""
    book = Book()
    p = t.package
    book.iterate, book.max_steps, book.max_change = p.iterate, p.steps, p.change
    for s in t.sheets:
        book.add_sheet(s.name)
    wanted = set(t.formulas if keys is None else keys)
    boxes: dict[int, list[tuple[int, int, int, int]]] = {}
    for k in wanted:
        for i, *box in t.reads[k]:
            boxes.setdefault(i, []).append(tuple(box))
    for i, s in enumerate(t.sheets):
        mine = list(dict.fromkeys(boxes.get(i, [])))
        values = kept_blanks(s, mine)
        if keys is not None:
            values = {at: v for at, v in values.items() if any(top <= at[0] <= b and l <= at[1] <= r for top, l, b, r in mine)}
        book.cells[s.name] = values
    for k in wanted:
        book.formulas[t.sheets[k[0]].name][k[1:]] = t.formulas[k]
    for name, scope, text in p.names:
        try:
            book.names[scope if scope is None else scope, name.lower()] = g.parse(text)
        except g.ParseError:
            pass
    return book


def _run(book: Book, clock: RunClock, extents: dict[str, tuple[int, int]]) -> tuple[dict, dict]:
    run = Run(book, clock)
    run.extents.update(extents)
    run.all()
    return run.done, run.spills


def _session(spark: SparkSession | None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no Spark session")
    return spark


def _pieces(t: P.Topology, groups: list[list[P.Key] | None], clock: RunClock, spark: SparkSession) -> Values:
    """Evaluates pieces side by side, one row of the input a piece."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    extents = {s.name: (s.max_row, s.max_col) for s in t.sheets}
    at = {s.name: i for i, s in enumerate(t.sheets)}
    rows = [(n, bytearray(pickle.dumps((book_of(t, keys), clock, extents)))) for n, keys in enumerate(groups)]
    df = spark.createDataFrame(rows, "piece int, book binary").repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "piece")

    def evaluated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for blob in pdf["book"]:
                done, spills = _run(*pickle.loads(blob))
                found = [(s, r, c, pickle.dumps(v), False) for (s, r, c), v in done.items()] + [(s, r, c, pickle.dumps(v), True) for (s, r, c), v in spills.items()]
                yield pd.DataFrame(found, columns=["sheet", "row", "col", "value", "spilled"])

    out: Values = {}
    for r in df.mapInPandas(evaluated, "sheet string, row int, col int, value binary, spilled boolean").toLocalIterator():
        key = (at[r["sheet"]], r["row"], r["col"])
        if not r["spilled"] or key not in out:
            out[key] = pickle.loads(r["value"])
    return out


def _columnar(t: P.Topology, clock: RunClock, spark: SparkSession) -> Values:
    """The formula sheet as an ordered table, its formula columns compiled."""
    from gridspark.plans.compile import Grid, NotCompilable

    i = next(iter(t.formulas))[0]
    s = t.sheets[i]
    columns = P.columns_of(t)
    last = max(k[1] for k in t.formulas)
    data: dict[int, dict[int, Any]] = {}
    for c in s.cells:
        if c.formula is None and c.value is not None:
            data.setdefault(c.col, {})[c.row] = c.value
    kinds = {}
    for c, cells in data.items():
        found = {"boolean" if isinstance(v, bool) else "double" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "date" if type(v) is dt.date else "?" for v in cells.values()}
        if len(found) > 1 or "?" in found:
            raise NotCompilable("a column of several kinds of values")
        kinds[c] = found.pop()
    if any(b[0] != i for bs in t.reads.values() for b in bs):
        raise NotCompilable("references to other sheets")
    rows = max(last, max((r for cells in data.values() for r in cells), default=0))
    letters = {c: g.col_letters(c) for c in sorted(data)}
    table = [(r, *(data[c].get(r) for c in letters)) for r in range(1, rows + 1)]
    df = spark.createDataFrame(table, ", ".join(["_row long", *(f"{l} {kinds[c]}" for c, l in letters.items())]))
    grid = Grid(df, {l: l for l in letters.values()}, ["_row"], clock=clock)
    for (_, c), cells in columns.items():
        first = cells[0]
        if cells[-1][1] != last or c in data and any(r >= first[1] for r in data[c]):
            raise NotCompilable("formula columns of different heights")
        grid.formulas[g.col_letters(c)] = (t.formulas[first], first[1])
        grid.columns.setdefault(g.col_letters(c), g.col_letters(c))
    out: Values = {}
    result = grid.run()
    have = set(result.columns)
    for r in result.toLocalIterator():
        for (_, c), cells in columns.items():
            l = g.col_letters(c)
            if cells[0][1] <= r["_row"] <= cells[-1][1]:
                err = r[f"{l}_err"] if f"{l}_err" in have else None
                v = GridError(err) if err else r[l]
                out[i, r["_row"], c] = 0.0 if v is None else v
    return out


def _evaluate(t: P.Topology, d: P.Decision, clock: RunClock, spark: SparkSession, budget: int) -> tuple[Values, str]:
    if d.strategy == "columnar":
        from gridspark.plans.compile import NotCompilable

        try:
            return _columnar(t, clock, spark), "columnar"
        except NotCompilable as e:
            d.chunk_reason = str(e)
            if t.array_capable:
                return _pieces(t, [None], clock, spark), "whole"
    if d.strategy == "whole":
        return _pieces(t, [None], clock, spark), "whole"
    return _pieces(t, [[k for c in b for k in c.cells] for b in P.batches(t, budget)], clock, spark), "components"


class RowIter:
    """(sheet, row number, values) in sheet order, then row order; strategy and fallback_reason tell how they were made."""

    def __init__(self, t: P.Topology, values: Values, strategy: str, reason: str | None, trim: bool = False):
        self.strategy, self.fallback_reason = strategy, reason
        self._rows = self._iterate(t, values, trim)

    @staticmethod
    def _iterate(t: P.Topology, values: Values, trim: bool) -> Iterator[tuple[str, int, list[Any]]]:
        for i, s in enumerate(t.sheets):
            mine: dict[int, dict[int, Any]] = {}
            for c in s.cells:
                if c.formula is None:
                    mine.setdefault(c.row, {})[c.col] = c.value
            rows, cols = (s.data_row, s.data_col) if trim else (s.max_row, s.max_col)
            for (k, r, c), v in values.items():
                if k == i:
                    if is_blank(mine.get(r, {}).get(c)):
                        mine.setdefault(r, {})[c] = v
                    rows, cols = max(rows, r), max(cols, c)
            for r in range(1, rows + 1):
                row = mine.get(r, {})
                yield s.name, r, [to_python(row.get(c)) for c in range(1, cols + 1)]

    def __iter__(self) -> RowIter:
        return self

    def __next__(self) -> tuple[str, int, list[Any]]:
        return next(self._rows)


def _planned(data: bytes, prelude: bool, **limits: Any) -> tuple[P.Topology, P.Decision]:
    t = P.read(data)
    if prelude and not t.parse_errors:
        P.fold(t)
    return t, P.decide(t, **limits)


def eval_rows(data: bytes, budget_cells: int | None = None, max_ratio: float = P.MAX_RATIO, min_formulas: int = P.MIN_FORMULAS, trim: bool = False, prelude: bool = True, lookup_budget: int = P.LOOKUP_BUDGET, now: dt.datetime | None = None, spark: SparkSession | None = None) -> RowIter:
    """Evaluates a workbook and gives its rows."""
    t, d = _planned(data, prelude, max_ratio=max_ratio, min_formulas=min_formulas, lookup_budget=lookup_budget)
    values, strategy = _evaluate(t, d, _clock(now), _session(spark), budget_cells or P.BUDGET_CELLS)
    return RowIter(t, values, strategy, d.reason, trim)


def _grid(rows: RowIter, t: P.Topology) -> dict[str, list[list[Any]]]:
    out: dict[str, list[list[Any]]] = {s.name: [] for s in t.sheets}
    for name, _, values in rows:
        out[name].append(values)
    return out


def eval_grid(data: bytes, now: dt.datetime | None = None, spark: SparkSession | None = None) -> dict[str, list[list[Any]]]:
    """The whole workbook evaluated as one piece: what all other ways have to equal."""
    t = P.read(data)
    values = _pieces(t, [None], _clock(now), _session(spark))
    return _grid(RowIter(t, values, "whole", None), t)


def eval_partitioned(data: bytes, budget_cells: int | None = None, max_ratio: float = P.MAX_RATIO, min_formulas: int = P.MIN_FORMULAS, prelude: bool = True, lookup_budget: int = P.LOOKUP_BUDGET, now: dt.datetime | None = None, spark: SparkSession | None = None) -> dict[str, list[list[Any]]]:
    """As eval_grid, divided where that is safe."""
    t, d = _planned(data, prelude, max_ratio=max_ratio, min_formulas=min_formulas, lookup_budget=lookup_budget)
    values, strategy = _evaluate(t, d, _clock(now), _session(spark), budget_cells or P.BUDGET_CELLS)
    return _grid(RowIter(t, values, strategy, d.reason), t)


def partition_plan(data: bytes, budget_cells: int | None = None, max_ratio: float = P.MAX_RATIO, min_formulas: int = P.MIN_FORMULAS, prelude: bool = True, lookup_budget: int = P.LOOKUP_BUDGET) -> dict[str, Any]:
    """The decision and what it rests on, without evaluating."""
    t, d = _planned(data, prelude, max_ratio=max_ratio, min_formulas=min_formulas, lookup_budget=lookup_budget)
    return P.report(t, d, budget_cells or P.BUDGET_CELLS, lookup_budget)


def components(data: bytes) -> dict[str, Any]:
    """Component statistics, with the eight largest by extent."""
    t = P.read(data)
    top = sorted(t.components, key=lambda c: -c.extent)[:8]
    return {
        "n_formula_cells": len(t.formulas), "n_components": len(t.components), "full_extent_cells": t.full_extent,
        "largest_cells": max((len(c.cells) for c in t.components), default=0), "top": [{"cells": len(c.cells), "extent": c.extent, "boxes": [(t.sheets[i].name, *b) for i, *b in c.boxes]} for c in top],
    }


def probe_dims(data: bytes, spark: SparkSession | None = None) -> list[tuple[str, int, int]]:
    """(sheet, rows, columns) after evaluation."""
    return [(name, len(rows), len(rows[0]) if rows else 0) for name, rows in eval_grid(data, spark=spark).items()]


def benchmark_rows(data: bytes, mode: str = "auto", budget_cells: int | None = None, now: dt.datetime | None = None, spark: SparkSession | None = None) -> tuple[RowIter, dict[str, Any]]:
    """Rows by one strategy (auto, columnar, components or whole) and the report; an error if the workbook does not qualify."""
    t, d = _planned(data, True, min_formulas=0)
    if mode != "auto":
        if mode == "columnar" and (d.reason or d.chunk_reason):
            raise ValueError(d.reason or d.chunk_reason)
        if mode == "components" and (d.reason or t.array_capable):
            raise ValueError(d.reason or "formulas that may spill")
        d = P.Decision(mode, None, d.chunk_reason, d.carry)
    values, strategy = _evaluate(t, d, _clock(now), _session(spark), budget_cells or P.BUDGET_CELLS)
    return RowIter(t, values, strategy, d.reason), P.report(t, d)
