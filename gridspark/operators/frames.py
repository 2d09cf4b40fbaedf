"""Row order at scale: row numbers, neighbouring rows and running totals without a single-partition window.

A table with dense row numbers `_row` is cut into blocks of BLOCK_ROWS. A frame of bounded reach needs only the rows of its
block and of a halo around it. A running total is the total of the blocks before (one short row each) and a running
total within the block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16
ROW, BLOCK = "_row", "_block"


def ends_of(df: DataFrame, key: str, buckets: int) -> list:
    """Ascending lower ends of runs of a numeric key of about equal rows, from one pass over the key alone."""
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.select(F.percentile_approx(F.col(key), at, 10_000)).first()[0] or []))


def bucket_of(key: Column, ends: Sequence) -> Column:
    """Number of ends not above key: first among every w-th end, then among the w that follow it."""
    ends = [e if isinstance(e, Column) else F.lit(e) for e in ends]
    if not ends:
        return F.lit(0)
    below = lambda a: F.size(F.filter(a, lambda e: e <= key))
    if len(ends) <= 64:
        return below(F.array(*ends))
    w = math.isqrt(len(ends))
    coarse = below(F.array(*ends[::w]))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * w + below(F.slice(F.array(*ends), (coarse - 1) * w + 1, F.lit(w))))


def _sampled_ends(df: DataFrame, order: Sequence[str], buckets: int) -> list[Column]:
    """Lower ends of runs of the whole order, of columns of any kind, from a sample of about 32 keys a run. They only deal out
    rows: any ends give the same row numbers."""
    rows = df.select(*order)
    n = rows.count() if buckets > 1 else 0
    if not n:
        return []
    kinds = {f.name: f.dataType for f in rows.schema}
    found = rows.sample(fraction=min(1.0, 32 * buckets / n), seed=7).collect()
    found.sort(key=lambda r: [(v is not None, v == v, v) if v is not None else (False,) for v in r])
    picked = dict.fromkeys(tuple(found[len(found) * i // buckets]) for i in range(1, buckets)) if found else {}
    return [F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, key, strict=True))) for key in picked]


def with_rows(df: DataFrame, order: Sequence[str], *, dense: bool = False, buckets: int | None = None) -> DataFrame:
    """Adds `_row`, 1 for the first in the order, nulls first. dense: the one order column holds consecutive whole numbers, so
    nothing has to be sorted; else runs of the whole order, whatever the kinds of its columns and however many rows share
    the first, are numbered each and then moved."""
    if dense:
        first = df.select(F.min(order[0]).alias("_first"))
        return df.crossJoin(F.broadcast(first)).withColumn(ROW, (F.col(order[0]) - F.col("_first") + 1).cast("long")).drop("_first")  # one row
    ends = _sampled_ends(df, order, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    run = df.withColumn("_run", bucket_of(F.struct(*order), ends))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = run.groupBy("_run").count().select("_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    placed = run.withColumn(ROW, F.row_number().over(Window.partitionBy("_run").orderBy(*order)))
    return placed.join(F.broadcast(starts), "_run").withColumn(ROW, F.col("_start") + F.col(ROW)).drop("_run", "_start")  # at most n rows


def median_of(values: DataFrame, alias: str) -> DataFrame:
    """One row: the median of the numbers of the first column, null if there are none. Counts by distinct value, in runs with
    the counts of the runs before; only the one or two runs that hold the middle are put in order."""
    counts = values.toDF("x").where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    ends = ends_of(counts, "x", int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = counts.withColumn("b", bucket_of(F.col("x"), ends))
    runs, before = Window.orderBy("b"), Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("b").agg(F.sum("n").alias("t")).select("b", "t", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("s"), F.sum("t").over(runs.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    held = totals.where((F.col("s") < high) & (F.col("s") + F.col("t") >= low))
    inside = Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    at = counts.join(F.broadcast(held), "b").withColumn("to", F.col("s") + F.sum("n").over(inside))  # two rows at most
    of = lambda place: F.max(F.when((F.col("to") >= place) & (F.col("to") - F.col("n") < place), F.col("x")))
    both = at.agg(of(low).alias("l"), of(high).alias("h"))
    return both.select((F.col("l") + (F.col("h") - F.col("l")) * 0.5).alias(alias))


def haloed(df: DataFrame, before: int, after: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows by `_block`, each also in the next block if one of its first `before` rows may ask for it, and in the one before
    likewise; `_own` marks a row's own block. before and after are at most block_rows."""
    if max(before, after) > block_rows:
        raise ValueError(f"a reach of {max(before, after)} rows is more than a block of {block_rows}")
    at = F.col(ROW) - 1
    block, place = F.floor(at / block_rows).cast("long"), F.pmod(at, F.lit(block_rows))
    blocks = [F.lit(0)]
    if before:
        blocks.append(F.when(place >= block_rows - before, F.lit(1)))
    if after:
        blocks.append(F.when(place < after, F.lit(-1)))
    moved = F.explode(F.filter(F.array(*blocks), lambda x: x.isNotNull()))
    return df.withColumn("_move", moved).withColumn(BLOCK, block + F.col("_move")).withColumn("_own", F.col("_move") == 0).drop("_move")


def block_window(*keys: str) -> Window:
    return Window.partitionBy(BLOCK, *keys).orderBy(ROW)


def running(df: DataFrame, totals: dict[str, tuple[str, Column]], *, keys: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds running totals over all rows up to each, by name: (kind, values) with kind sum, count, min or max; within each
    value of keys, if given."""
    blocked = df.withColumn(BLOCK, F.floor((F.col(ROW) - 1) / block_rows).cast("long"))
    of = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    names = list(totals)
    part = blocked.groupBy(BLOCK, *keys).agg(*(of[totals[n][0]](totals[n][1]).alias(f"_p{i}") for i, n in enumerate(names)))
    over = (Window.partitionBy(*keys) if keys else Window).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    part = part.select(BLOCK, *keys, *(merge[totals[n][0]](f"_p{i}").over(over).alias(f"_b{i}") for i, n in enumerate(names)))
    inside = block_window(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.select("*", *(of[totals[n][0]](totals[n][1]).over(inside).alias(f"_i{i}") for i, n in enumerate(names))).join(part, [BLOCK, *keys], "left")
    for i, n in enumerate(names):
        a, b, kind = F.col(f"_b{i}"), F.col(f"_i{i}"), totals[n][0]
        both = a + b if kind in ("sum", "count") else F.least(a, b) if kind == "min" else F.greatest(a, b)
        out = out.withColumn(n, F.coalesce(both, b, a))
    return out.drop(BLOCK, *(f"_{k}{i}" for k in "bi" for i in range(len(names)))).select(*df.columns, *names)


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, start: Column, step) -> DataFrame:
    """A recurrence that no prefix expresses: name = step(previous, value) down each group of keys, from start (before the first
    row). A group's values are one array, folded in the JVM, so a group has to fit a task."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_rows"))
    first = F.array(start)
    folded = F.aggregate("_rows", first, lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x["_v"]))))
    rows = rows.select(*keys, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.slice(folded, F.lit(2), F.size("_rows")).alias("v"))).alias("_x"))
    return rows.select(*keys, *(F.col(f"_x.r.{o}").alias(o) for o in order), F.col("_x.r._v").alias(value), F.col("_x.v").alias(name))
