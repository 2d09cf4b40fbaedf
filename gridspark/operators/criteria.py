"""Criteria as columns: constant ones as predicates, ones that follow the row as grouped counts joined back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.values import split_criterion
from gridspark.operators.frames import bucket_of, ends_of


def like_pattern(text: str) -> str:
    """A wildcard text as an SQL LIKE pattern with '!' as its escape."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "~" and i + 1 < len(text) and text[i + 1] in "*?~":
            i += 1
            c = text[i]
            out += f"!{c}" if c in "%_!" else c
        else:
            out += {"*": "%", "?": "_"}.get(c, f"!{c}" if c in "%_!" else c)
        i += 1
    return out


def predicate(c: Column, kind: str, criterion: Any) -> Column:
    """Whether a cell of a column of the given kind (number, text, bool, date) meets a constant criterion; never null."""
    op, want = split_criterion(criterion)
    no = F.lit(False)
    if op in (">", "<", ">=", "<="):
        if isinstance(want, str):
            test = _ordered(F.lower(c), op, F.lit(want.lower())) if kind == "text" else no
        elif isinstance(want, bool):
            test = _ordered(c, op, F.lit(want)) if kind == "bool" else no
        else:
            test = _ordered(_number(c, kind), op, F.lit(float(want))) if kind in ("number", "date") else no
        return F.coalesce(test, no)
    if isinstance(want, str) and want == "":
        blank = c.isNull() | (c == "") if kind == "text" and op == "=" else c.isNull()
        return blank if op == "=" else ~blank
    if isinstance(want, str):
        same = F.like(F.lower(c), F.lit(like_pattern(want.lower())), F.lit("!")) if kind == "text" and any(x in want for x in "*?~") else F.lower(c) == want.lower() if kind == "text" else no
    elif isinstance(want, bool):
        same = c == F.lit(want) if kind == "bool" else no
    elif kind == "text":
        same = c.try_cast("double") == float(want)
    else:
        same = _number(c, kind) == float(want) if kind in ("number", "date") else no
    same = F.coalesce(same, no)
    return same if op == "=" else ~same


def _number(c: Column, kind: str) -> Column:
    return F.datediff(c, F.lit("1899-12-30").cast("date")).cast("double") if kind == "date" else c


def _ordered(a: Column, op: str, b: Column) -> Column:
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def by_row(df: DataFrame, source: DataFrame, pairs: Sequence[tuple[Column, str, Column]], measures: dict[str, tuple[str, Column]], *, asked: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Adds measures of the rows of source that meet the criteria of each row of df: name to (count, sum, min or max; cells).

    pairs are (column of source, operator, key of df): any number of "=", where blank meets blank, and at most one of <, <=, >
    and >=, whose column is a number or a date and where blanks meet nothing. Rows without any match get null. Cells of
    equal keys are combined before they move; an ordered criterion is a running measure over distinct keys, within runs of
    them and with the measures of the runs before. df joins at the end by all its keys;
    asked, if given, has the keys of all its rows and a shorter plan."""
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    made = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    equal, ordered = [p for p in pairs if p[1] == "="], [p for p in pairs if p[1] != "="]
    if len(ordered) > 1:
        raise ValueError("more than one ordered criterion that follows the row")
    es = [f"_e{i}" for i in range(len(equal))]
    keys = [v.alias(e) for e, (v, _, _) in zip(es, equal, strict=True)]
    on = [k.eqNullSafe(F.col(e)) for e, (_, _, k) in zip(es, equal, strict=True)]
    if ordered:
        values, op, key = ordered[0]
        keys, on = [*keys, values.alias("_k")], [*on, key == F.col("_k")]
    cells = source.groupBy(*keys).agg(*(made[kind](c).alias(n) for n, (kind, c) in measures.items()))
    if ordered:
        cells = _running_cells(cells.where("_k is not null"), (df if asked is None else asked).where(key.isNotNull()).select(*(k.alias(e) for e, (_, _, k) in zip(es, equal, strict=True)), key.alias("_k")).distinct(), es, op, {n: merge[kind] for n, (kind, _) in measures.items()}, buckets)
    return df.join(cells, reduce(lambda a, b: a & b, on), "left").drop(*es, "_k")


def _running_cells(cells: DataFrame, asked: DataFrame, es: list[str], op: str, merge: dict[str, Any], buckets: int | None) -> DataFrame:
    """Measures by es and _k turned into those of all keys up to each (or down to each), for the keys of both."""
    ends = ends_of(cells, "_k", buckets or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = cells.unionByName(asked, allowMissingColumns=True).groupBy(*es, "_k").agg(*(f(n).alias(n) for n, f in merge.items())).withColumn("_b", bucket_of(F.col("_k"), ends))
    way = F.asc if op[0] == "<" else F.desc
    before = Window.partitionBy(*es).orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = both.groupBy(*es, "_b").agg(*(f(n).alias(n) for n, f in merge.items()))
    totals = totals.select(*(F.col(e).alias(f"_t{e}") for e in es), F.col("_b").alias("_t"), *(f(n).over(before).alias(f"_t{n}") for n, f in merge.items()))
    inside = Window.partitionBy(*es, "_b").orderBy(way("_k")).rowsBetween(Window.unboundedPreceding, 0 if op[1:] else -1)
    both = both.select(*es, "_k", "_b", *(f(n).over(inside).alias(n) for n, f in merge.items()))
    same = reduce(lambda a, b: a & b, [F.col(e).eqNullSafe(F.col(f"_t{e}")) for e in es], F.col("_b") == F.col("_t"))
    both = both.join(totals if es else F.broadcast(totals), same)  # without es at most as many rows as buckets
    combined = {n: F.coalesce(F.col(n) + F.col(f"_t{n}") if f is F.sum else F.least(n, f"_t{n}") if f is F.min else F.greatest(n, f"_t{n}"), F.col(n), F.col(f"_t{n}")) for n, f in merge.items()}
    return both.select(*es, "_k", *(c.alias(n) for n, c in combined.items()))
