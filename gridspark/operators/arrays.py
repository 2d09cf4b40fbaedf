"""Dynamic arrays as tables: a block of cells is a DataFrame with `_row` (1, 2, ...) and its columns in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.operators.frames import ROW, with_rows


def cells(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def renumbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows numbered anew in the order, without a single-partition sort."""
    return with_rows(df.drop(ROW) if ROW in df.columns and ROW not in order else df, order)


def sort(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """SORT: rows by a column, ties in their old order, blanks last either way."""
    by = df.withColumn("_old", F.col(ROW)).drop(ROW)
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return by.orderBy(key, "_old").drop("_old")


def sort_by(df: DataFrame, keys: Sequence[tuple[Column, int]]) -> DataFrame:
    """SORTBY: rows by any expressions, 1 ascending, -1 descending; ties in their old order."""
    order = [k.asc_nulls_last() if way > 0 else k.desc_nulls_last() for k, way in keys]
    return df.orderBy(*order, ROW).drop(ROW)


def unique(df: DataFrame, columns: Sequence[str] | None = None, once: bool = False) -> DataFrame:
    """UNIQUE: distinct rows with the place of their first; once: only those that occur once. Counts are combined before the shuffle."""
    by = list(columns or cells(df))
    out = df.groupBy(*by).agg(F.min(ROW).alias(ROW), F.count("*").alias("_n"))
    return (out.where("_n = 1") if once else out).drop("_n")


def keep(df: DataFrame, test: Column) -> DataFrame:
    """FILTER."""
    return df.where(F.coalesce(test, F.lit(False)))


def take(df: DataFrame, n: int) -> DataFrame:
    """TAKE: the first n rows, or the last -n. A comparison with the row number, no sort."""
    if n >= 0:
        return df.where(F.col(ROW) <= n)
    last = df.agg(F.max(ROW).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(ROW) > F.col("_last") + n).drop("_last")  # one row


def drop(df: DataFrame, n: int) -> DataFrame:
    """DROP: all but the first n rows, or but the last -n."""
    if n >= 0:
        return df.where(F.col(ROW) > n)
    last = df.agg(F.max(ROW).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(ROW) <= F.col("_last") + n).drop("_last")  # one row


def sequence(spark: SparkSession, rows: int, cols: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    """SEQUENCE: made where it is needed, on all executors."""
    base = spark.range(1, rows + 1).select(F.col("id").alias(ROW))
    return base.select(ROW, *((F.lit(float(start)) + F.lit(float(step)) * ((F.col(ROW) - 1) * cols + j)).alias(f"c{j + 1}") for j in range(cols)))


def identity(spark: SparkSession, n: int) -> DataFrame:
    """MUNIT."""
    return make_array(spark, n, n, lambda r, c: (r == c).cast("double"))


def make_array(spark: SparkSession, rows: int, cols: int, f) -> DataFrame:
    """MAKEARRAY: f(row, column) as columns."""
    base = spark.range(1, rows + 1).select(F.col("id").alias(ROW))
    return base.select(ROW, *(f(F.col(ROW), F.lit(j)).alias(f"c{j}") for j in range(1, cols + 1)))


def random_array(spark: SparkSession, rows: int, cols: int = 1, seed: int = 0) -> DataFrame:
    """RANDARRAY, with a seed: the same run gives the same numbers."""
    base = spark.range(1, rows + 1).select(F.col("id").alias(ROW))
    return base.select(ROW, *(F.rand(seed + j).alias(f"c{j + 1}") for j in range(cols)))


def long_form(df: DataFrame, kind: str = "string") -> DataFrame:
    """(_row, col, value) of every cell; col counts from 1."""
    cs = cells(df)
    each = F.posexplode(F.array(*(F.col(c).cast(kind) for c in cs)))
    return df.select(ROW, each.alias("col", "value")).withColumn("col", F.col("col") + 1)


def transpose(df: DataFrame, rows: int, kind: str = "string") -> DataFrame:
    """TRANSPOSE of a block of `rows` rows: each column becomes a row of `rows` cells. Cells meet by column, not in one task."""
    long = long_form(df, kind)
    picked = [F.max(F.when(F.col(ROW) == r, F.col("value"))).alias(f"c{r}") for r in range(1, rows + 1)]
    return long.groupBy(F.col("col").cast("long").alias("_to")).agg(*picked).withColumnRenamed("_to", ROW)


def choose_cols(df: DataFrame, places: Sequence[int]) -> DataFrame:
    """CHOOSECOLS: by place, negative from the end."""
    cs = cells(df)
    return df.select(ROW, *(F.col(cs[p - 1 if p > 0 else p]).alias(f"c{k}") for k, p in enumerate(places, 1)))


def choose_rows(df: DataFrame, places: Sequence[int]) -> DataFrame:
    """CHOOSEROWS: by place, in the order asked, negative from the end."""
    spark = df.sparkSession
    want = spark.createDataFrame([(k, int(p)) for k, p in enumerate(places, 1)], "_at long, _place long")
    if any(p < 0 for p in places):
        last = df.agg(F.max(ROW).alias("_last"))
        want = want.crossJoin(last).withColumn("_place", F.when(F.col("_place") < 0, F.col("_last") + 1 + F.col("_place")).otherwise(F.col("_place"))).drop("_last")
    return df.join(F.broadcast(want), F.col(ROW) == F.col("_place")).drop(ROW, "_place").withColumnRenamed("_at", ROW)  # as many rows as places


def to_col(df: DataFrame, by_col: bool = False, skip_blanks: bool = False, kind: str = "string", rows: int | None = None) -> DataFrame:
    """TOCOL: cells row by row (by_col: column by column, which needs the number of rows) as one column."""
    n = len(cells(df))
    long = long_form(df, kind)
    if skip_blanks:
        long = long.where("value is not null")
    if by_col and rows is None:
        rows = df.agg(F.max(ROW)).first()[0] or 0
    place = (F.col("col") - 1) * rows + F.col(ROW) if by_col else (F.col(ROW) - 1) * n + F.col("col")
    out = long.select(place.cast("long").alias(ROW), "value")
    return renumbered(out.withColumnRenamed(ROW, "_at"), ["_at"]).drop("_at") if skip_blanks else out


def wrap_rows(df: DataFrame, n: int, pad=None) -> DataFrame:
    """WRAPROWS of one column: n cells a row; pad fills the last one."""
    (c,) = cells(df)
    kind = dict(df.dtypes)[c]
    at = F.floor((F.col(ROW) - 1) / n) + 1
    cols = [F.max(F.when(F.pmod(F.col(ROW) - 1, F.lit(n)) == k, F.col(c))).alias(f"c{k + 1}") for k in range(n)]
    have = [F.max(F.when(F.pmod(F.col(ROW) - 1, F.lit(n)) == k, F.lit(1))).alias(f"_h{k + 1}") for k in range(n)]
    out = df.groupBy(at.cast("long").alias("_to")).agg(*cols, *have).withColumnRenamed("_to", ROW)
    return out.select(ROW, *(F.when(F.col(f"_h{k}").isNull(), F.lit(pad).cast(kind)).otherwise(F.col(f"c{k}")).alias(f"c{k}") for k in range(1, n + 1)))


def wrap_cols(df: DataFrame, n: int, total: int, pad=None) -> DataFrame:
    """WRAPCOLS of one column of `total` cells: n cells a column."""
    (c,) = cells(df)
    kind, width = dict(df.dtypes)[c], -(-total // n)
    at = F.pmod(F.col(ROW) - 1, F.lit(n)) + 1
    cols = [F.max(F.when(F.floor((F.col(ROW) - 1) / n) == k, F.col(c))).alias(f"c{k + 1}") for k in range(width)]
    out = df.groupBy(at.cast("long").alias("_to")).agg(*cols).withColumnRenamed("_to", ROW)
    full = total - n * (width - 1)
    return out.withColumn(f"c{width}", F.when(F.col(ROW) > full, F.lit(pad).cast(kind)).otherwise(F.col(f"c{width}")))


def expand(df: DataFrame, rows: int, cols: int, pad=None) -> DataFrame:
    """EXPAND to rows by cols, new cells filled with pad."""
    cs = cells(df)
    grid = df.sparkSession.range(1, rows + 1).select(F.col("id").alias(ROW))
    kinds = dict(df.dtypes)
    out = grid.join(df.withColumn("_have", F.lit(True)), ROW, "left")
    old = [F.when(F.col("_have"), F.col(c)).otherwise(F.lit(pad).cast(kinds[c])).alias(c) for c in cs]
    return out.select(ROW, *old, *(F.lit(pad).cast(kinds[cs[-1]]).alias(f"c{j}") for j in range(len(cs) + 1, cols + 1)))


def text_split(df: DataFrame, column: str, by_col: str, by_row: str | None = None) -> DataFrame:
    """TEXTSPLIT of each row's text: (_row, part_row, part_col, value)."""
    import re

    rows = F.split(column, re.escape(by_row)) if by_row else F.array(F.col(column))
    out = df.select(ROW, F.posexplode(rows).alias("part_row", "_t"))
    out = out.select(ROW, (F.col("part_row") + 1).alias("part_row"), F.posexplode(F.split("_t", re.escape(by_col))).alias("part_col", "value"))
    return out.withColumn("part_col", F.col("part_col") + 1)


def vstack(a: DataFrame, b: DataFrame) -> DataFrame:
    """VSTACK: b's rows below a's; missing columns are blank."""
    last = a.agg(F.coalesce(F.max(ROW), F.lit(0)).alias("_last"))
    below = b.crossJoin(F.broadcast(last)).withColumn(ROW, F.col(ROW) + F.col("_last")).drop("_last")  # one row
    names = dict(zip(cells(b), cells(a), strict=False))
    return a.unionByName(below.withColumnsRenamed(names), allowMissingColumns=True)


def hstack(a: DataFrame, b: DataFrame) -> DataFrame:
    """HSTACK: b's columns right of a's, row by row; missing rows are blank."""
    return a.join(b, ROW, "full")


def spilled(spark: SparkSession, anchors: DataFrame, taken: DataFrame) -> DataFrame:
    """Spill placement. anchors: (sheet, row, col, rows, cols, cells array of array); taken: (sheet, row, col) of formulas and
    values that are not blank. Gives (sheet, row, col, value, kind): an anchor whose block meets a taken cell or another
    anchor's block is a Spill error and spills nothing. Blocks meet cells by an equal-position join, not by comparing pairs."""
    place = anchors.select("sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.posexplode("cells").alias("dr", "line")).select("sheet", "r0", "c0", "dr", F.posexplode("line").alias("dc", "value"))
    place = place.select("sheet", "r0", "c0", (F.col("r0") + F.col("dr")).alias("row"), (F.col("c0") + F.col("dc")).alias("col"), "value")
    body = place.where("row != r0 or col != c0")
    hit = body.join(taken.select("sheet", "row", "col").distinct(), ["sheet", "row", "col"], "left_semi").select("sheet", "r0", "c0")
    first = Window.partitionBy("sheet", "row", "col").orderBy("r0", "c0")
    clash = place.withColumn("_k", F.row_number().over(first)).where("_k > 1").select("sheet", "r0", "c0")
    bad = hit.union(clash).distinct().withColumn("_bad", F.lit(True))
    out = place.join(bad, ["sheet", "r0", "c0"], "left")
    own = (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))
    return out.where(own | F.col("_bad").isNull()).select("sheet", "row", "col", F.when(F.col("_bad").isNull(), F.col("value")).alias("value"), F.when(F.col("_bad"), "error").when(own, "anchor").otherwise("spill").alias("kind"))
