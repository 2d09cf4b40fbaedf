"""Formula columns over a stream of rows: the last rows of each key are kept as state, and stand above the next batch.

A template that reads at most `carry` rows above gives the same values in any division of the rows into batches. Rows of a
key have to come in ascending order; a row that comes late is an error, as values that depend on it are out already.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridspark import grammar as g
from gridspark.interp import Book, Run
from gridspark.model import GridError


def evaluate_window(rows: list[dict[str, Any]], columns: dict[str, str], formulas: dict[str, tuple[g.Node, int]], first_row: int, known: int) -> list[dict[str, Any]]:
    """Formula values of rows[known:], the first of which is row first_row; rows before it come with their values."""
    book = Book()
    book.add_sheet("S")
    top = first_row - known
    for i, row in enumerate(rows):
        for letter, name in columns.items():
            v = row.get(name)
            if v is not None and v == v:
                book.cells["S"][top + i, g.col_number(letter)] = v
    for letter, (tree, at) in formulas.items():
        for i in range(known, len(rows)):
            if top + i >= at:
                book.cells["S"].pop((top + i, g.col_number(letter)), None)
                book.formulas["S"][top + i, g.col_number(letter)] = g.shifted(tree, top + i - at, 0)
    run = Run(book)
    out = []
    for i in range(known, len(rows)):
        new = dict(rows[i])
        for letter in formulas:
            v = run.value("S", top + i, g.col_number(letter))
            new[columns[letter]] = None if isinstance(v, GridError) else v
        out.append(new)
    return out


def carried(stream: DataFrame, key: str, order: str, columns: dict[str, str], formulas: dict[str, str], carry: int, *, at: int = 1) -> DataFrame:
    """stream with formula columns (double), evaluated down each key's rows. columns: letters to names, formulas by letter,
    written for row `at`. State: the number of rows so far and the last `carry` rows."""
    if carry < 1:
        raise ValueError("carry is at least 1")
    trees = {l: (g.parse(f), at) for l, f in formulas.items()}
    names = [*dict.fromkeys([*stream.columns, *(columns[l] for l in formulas)])]
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        done, tail = pickle.loads(state.get[0]) if state.exists else (0, [])
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        if tail and len(pdf) and pdf[order].iloc[0] < tail[-1][order]:
            raise ValueError(f"rows of {k} are out of order")
        rows = tail + pdf.to_dict("records")
        new = evaluate_window(rows, columns, trees, done + 1, len(tail))
        state.update((pickle.dumps((done + len(new), (tail + new)[-carry:])),))
        yield pd.DataFrame(new, columns=names)

    return stream.groupBy(key).applyInPandasWithState(step, schema, "rows binary", "append", GroupStateTimeout.NoTimeout)
