"""Connected components of formula cells, on DataFrames: for dependency tables that no driver should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.workspace import shared_dir


def reading(formulas: DataFrame, ranges: DataFrame) -> DataFrame:
    """(reader, source): formula cells inside the ranges that other formulas read. formulas: (id, sheet, row, col); ranges:
    (id, sheet, top, left, bottom, right). Ranges are cut along bands of 256 rows, so the join has an equality on (sheet, band)."""
    band = 256
    r = ranges.select("id", "sheet", "top", "left", "bottom", "right", F.explode(F.sequence(F.floor(F.col("top") / band), F.floor(F.col("bottom") / band))).alias("band"))
    f = formulas.select(F.col("id").alias("source"), F.col("sheet").alias("s"), "row", "col", F.floor(F.col("row") / band).alias("b"))
    on = (F.col("sheet") == F.col("s")) & (F.col("band") == F.col("b")) & F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    return r.join(f, on).select(F.col("id").alias("reader"), "source")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id that can be reached. Large-star and small-star steps alternate until the
    edges are stars around the smallest ids, so chains in any order take few rounds; each round ends in a checkpoint."""
    spark = nodes.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    pairs = edges.toDF("a", "b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct().checkpoint()
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = small.union(least.select("a", "m")).distinct().checkpoint()
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return nodes.join(pairs, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))


def extents(cells: DataFrame) -> DataFrame:
    """Bounding boxes and their sizes by component and sheet. cells: (component, sheet, row, col)."""
    box = cells.groupBy("component", "sheet").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"))
    return box.withColumn("cells", (F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1))
