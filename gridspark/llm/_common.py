"""Helpers shared by the corpus operators: the shared folder, written tables, order-preserving buckets."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters of `[\x20\x09-\x0D]`, the only ones that count as blank between words and around lines.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

SIEVE_BITS, SIEVE_WORDS = 16, 1 << 19

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a new local one where that is unset and all
    run on one machine (tests). On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, dropped when the driver's Python ends or `release` is called."""
    if not _written:
        atexit.register(release)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, reread from a Parquet table in the shared folder: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sieved(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key (a long) may stand in the written table keys, and those whose key surely doesn't.

    The keys' bits, SIEVE_BITS a key up to SIEVE_WORDS words of 64, are broadcast, so that a join need not move the rows
    that it can't match. With very many keys more rows pass, none is ever lost."""
    name = keys.columns[0]
    words = min(SIEVE_WORDS, 1 + keys.count() * SIEVE_BITS // 64)
    word, bit = clear_name(df, "sieve_word"), clear_name(df, "sieve_bits")
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(64 * words))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), place(k).bitwiseAND(F.lit(63)).cast("int"))
    bits = keys.select(F.shiftright(place(F.col(name)), 6).alias(word), one(F.col(name)).alias(bit))
    bits = F.broadcast(bits.groupBy(word).agg(F.bit_or(bit).alias(bit)))  # SIEVE_WORDS rows at most
    hit = (F.shiftright(place(key), 6) == bits[word]) & (bits[bit].bitwiseAND(one(key)) != 0)
    return df.join(bits, hit, "left_semi"), df.join(bits, hit, "left_anti")


def release() -> None:
    """Drops the tables that this driver has written. Call it when no result that reads them is needed any more."""
    for path, spark in list(_written.items()):
        try:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
        _written.pop(path, None)


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it is not installed: from the place that the driver has it from."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, have]))
    return spark


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Ascending, distinct lower ends of at most `buckets` runs of a numeric key, of about as many rows each.

    One pass over the key column alone. A key value is never divided, nulls count for nothing."""
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    found = df.select(F.percentile_approx(F.col(key), at, max(10_000, 4 * buckets)).alias("p")).first()["p"]
    return sorted(set(found or []))


def bucket_of(key: Column, ends: list[int]) -> Column:
    """Number of `ends` not above the key (null: after all others), in two short array scans of about sqrt(n) each."""
    if not ends:
        return F.lit(0)
    step = max(1, int(len(ends) ** 0.5))
    parts = [ends[i : i + step] for i in range(0, len(ends), step)]
    starts = F.array(*[F.lit(p[0]) for p in parts])
    nested = F.array(*[F.array(*[F.lit(x) for x in p]) for p in parts])
    part = F.size(F.filter(starts, lambda e: e <= key))
    inside = F.size(F.filter(F.element_at(nested, part), lambda e: e <= key))
    below = F.when(part == 0, F.lit(0)).otherwise((part - 1) * step + inside)
    return F.when(key.isNull(), F.lit(len(ends))).otherwise(below)


def lower_az(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Number of runs of non-blank characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def field(df: DataFrame, name: str, new: str | None = None) -> T.StructField:
    """The field of a column, for the schema of an Arrow function's result."""
    return T.StructField(new or name, df.schema[name].dataType, True)


def clear_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores put before it until no column of df has it: internal columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
