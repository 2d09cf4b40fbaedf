"""Lookups as joins: the first match of equal keys, the last key not above, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.frames import ROW, bucket_of, ends_of

BROADCAST_ROWS = 1 << 16


def _folded(c: Column, kind: str) -> Column:
    return F.lower(c) if kind == "string" else c


def many_keys(table: DataFrame, key: str) -> bool:
    """Whether a table has more than about BROADCAST_ROWS distinct keys, from one pass over the key alone."""
    return table.agg(F.approx_count_distinct(key)).first()[0] > BROADCAST_ROWS


def exact(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str | None, name: str, *, order: str = ROW, last: bool = False, many: bool = False) -> DataFrame:
    """VLOOKUP or MATCH with exact keys: adds name, and name_err ('Na' on a miss). The first match by the table's row counts
    (last: the last); text without case; value None: the row's place. One row per key goes into the join, so no key of the
    table multiplies rows, and Spark broadcasts it when its size allows. many: it never does, whatever it takes the size for;
    both sides are dealt out by the key, so what moves grows as the rows do, and lookups by one column share a shuffle."""
    kind = dict(table.dtypes)[table_key]
    pick = F.max_by if last else F.min_by
    of = F.struct(F.lit(1).alias("hit"), (F.col(value) if value else F.col(order).cast("double")).alias("v"))
    one = table.where(F.col(table_key).isNotNull()).groupBy(_folded(F.col(table_key), kind).alias("_k")).agg(pick(of, order).alias("_m"))
    out = df.join(one.hint("merge") if many else one, _folded(F.col(key), dict(df.dtypes)[key]) == F.col("_k"), "left")
    return out.withColumn(name, F.col("_m.v")).withColumn(f"{name}_err", F.when(F.col("_m").isNull(), F.lit("Na"))).drop("_k", "_m")


def nearest(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str, *, above: bool = False, buckets: int = 64) -> DataFrame:
    """VLOOKUP with ascending keys: the value at the greatest table key not above each row's key (above: the least not below),
    and name_err ('Na' where there is none). Both sides are dealt out to runs of keys; the last table row of the runs
    before comes in from a table of one row a run. Distinct keys go through, not rows."""
    sign = -1 if above else 1
    slim = table.where(F.col(table_key).isNotNull()).select((sign * F.col(table_key)).alias("_k"), F.col(value).alias("_v"))
    slim = slim.groupBy("_k").agg(F.first("_v").alias("_v"))
    ends = ends_of(slim, "_k", buckets)
    of = F.struct(F.lit(1).alias("hit"), F.col("_v").alias("v"))
    mine = slim.select(bucket_of(F.col("_k"), ends).alias("_b"), "_k", of.alias("_m"), F.lit(0).alias("_side"))
    asked = df.where(F.col(key).isNotNull()).select((sign * F.col(key)).alias("_k")).distinct()
    asked = asked.select(bucket_of(F.col("_k"), ends).alias("_b"), "_k", F.lit(None).cast(mine.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_side"))
    carry = mine.groupBy("_b").agg(F.max_by("_m", "_k").alias("_m"))
    runs = F.broadcast(carry.select("_b").unionByName(asked.select("_b").distinct()).distinct())
    carry = runs.join(carry, "_b", "left").select("_b", F.last("_m", True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    inside = Window.partitionBy("_b").orderBy("_k", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(asked).withColumn("_m", F.last("_m", True).over(inside)).where("_side = 1").join(F.broadcast(carry), "_b")  # `buckets` rows at most
    both = both.select((sign * F.col("_k")).alias("_key"), F.coalesce("_m", "_c").alias("_m"))
    out = df.join(both, F.col(key) == F.col("_key"), "left")
    return out.withColumn(name, F.col("_m.v")).withColumn(f"{name}_err", F.when(F.col("_m").isNull(), F.lit("Na"))).drop("_key", "_m")


def at_row(df: DataFrame, place: str, table: DataFrame, value: str, name: str, *, many: bool = False) -> DataFrame:
    """INDEX(value, place): the value in the table's row of that number; below 1 a Value error, beyond the end a Ref error.
    many: as in exact."""
    rows = table.select(F.col(ROW).alias("_r"), F.struct(F.lit(1).alias("hit"), F.col(value).alias("v")).alias("_m"))
    out = df.join(rows.hint("merge") if many else rows, F.floor(F.col(place)).cast("long") == F.col("_r"), "left")
    err = F.when(F.col(place).isNull(), F.lit(None)).when(F.col(place) < 1, F.lit("Value")).when(F.col("_m").isNull(), F.lit("Ref"))
    return out.withColumn(name, F.col("_m.v")).withColumn(f"{name}_err", err).drop("_r", "_m")
