"""Mixing sources to target weights (operator 5): Sainte-Laguë apportionment of equal-token blocks.

Each source has a target in words. Seats of `block_words` words go to the sources by the highest quotients
target / (2 seats + 1), then each source's seats go to its shards in the same way by their sizes, down a tree of at most
FAN children a node, so no task sees all shards of a source. A shard is a seeded share of a source's documents of bounded
rows, in a seeded order, cut into blocks of equal numbers of words. Its quota is so many passes over all its blocks and
some more blocks, selected by a seeded permutation. Documents are never sorted or gathered beyond a shard, so a source
may hold any part of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm._common import clear_name, count_words, written

BLOCK_WORDS = 128
SHARD_ROWS = 4096
FAN = 1024  # shards, or parts of a source that hold shards, among which one task deals out seats
MAX_REPEAT = 3
MAX_SOURCES = 1_000_000  # the mixture is a table of sources on the driver; more are an error
CYCLE = (5, 2, 1)  # weights of the sources in their order, repeating
STRIDE = 2_654_435_761  # a prime above any number of blocks in a shard


def capped_targets(sizes: Sequence[int], weights: Sequence[float], max_repeat: float = MAX_REPEAT) -> list[Fraction]:
    """Shares of sum(sizes) by weight; what is above max_repeat times a size is shared again among the others, by weight."""
    total, cap = Fraction(sum(sizes)), [Fraction(max_repeat) * s for s in sizes]
    weight = [Fraction(w) for w in weights]
    target, open_ = [Fraction(0)] * len(sizes), [i for i, w in enumerate(weight) if w > 0]
    left = total
    while open_:
        share = left / sum(weight[i] for i in open_)
        over = {i for i in open_ if share * weight[i] > cap[i]}
        if not over:
            for i in open_:
                target[i] = share * weight[i]
            break
        for i in over:
            target[i] = cap[i]
            left -= cap[i]
        open_ = [i for i in open_ if i not in over]
    return target


def sainte_lague(votes: Sequence[float | Fraction], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1); of equal quotients the earlier party's comes first.

    All quotients above a bound that at most `seats` of them pass are given at once; then go one by one the rest, of which
    there are 1.5 a party at most, so the cost does not grow with the seats."""
    import heapq

    votes = [Fraction(v) for v in votes]
    total, n = sum(votes), len(votes)
    if not total or seats <= 0:
        return [0] * n
    won = [0] * n
    if seats > n:  # a party has ceil(x) // 2 quotients above v / x; their sum is at most seats - n / 2 here
        bound = total / (2 * (seats - n))
        won = [-(-v // bound) // 2 for v in votes]
    best = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, won, strict=True)) if v > 0]
    heapq.heapify(best)
    for _ in range(seats - sum(won)):
        _, i = best[0]
        won[i] += 1
        heapq.heapreplace(best, (-votes[i] / (2 * won[i] + 1), i))
    return won


def _source_table(units: DataFrame, weights: dict[str | None, float] | None, max_repeat: float, block_words: int) -> list[tuple]:
    """(source, size, target, seats, rows) of each source, by code point, null last."""
    rows = units.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    by = [CYCLE[i % len(CYCLE)] if weights is None else weights.get(r["source"], 0) for i, r in enumerate(rows)]
    sizes = [int(r["size"]) for r in rows]
    target = capped_targets(sizes, by, max_repeat)
    seats = sainte_lague(target, round(sum(target) / block_words))
    return [(r["source"], size, float(t), seat, int(r["n"])) for r, size, t, seat in zip(rows, sizes, target, seats, strict=True)]


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, fan: int = FAN, seed: int = 0, keep: bool = False) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, and the plan: passes (over the whole document),
    first (place of its first word in its shard), shard_size, blocks, extra (blocks taken once more), turn.

    weights: of the sources by name, null as None, 0 where none is named; without it 5, 2, 1 in turn by code point, null
    last. `keep` adds the document's row as a struct named row. A null or empty text has size 0 and gives nothing; rows
    repeated or with one id are rows of their own; a null id stays; an empty table gives no rows. Columns of docs of
    any other names do no harm. The same rows and seed give the same result, however they are divided or ordered."""
    spark = docs.sparkSession
    named = [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("lot")]
    units = written(docs.select(*named), "units")
    table = _source_table(units, weights, max_repeat, block_words)
    sources = spark.createDataFrame(table, "source string, source_size long, target double, seats long, source_rows long")
    number = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / shard_rows)).cast("long")
    if keep:
        units = docs.select(*named, F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    units = units.join(F.broadcast(sources), units["source"].eqNullSafe(sources["source"])).drop(sources["source"])  # MAX_SOURCES rows at most
    units = units.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "lot"), number))

    def seats_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        won = sainte_lague([int(s) for s in pdf["part_size"]], int(pdf["seats"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"], "part": pdf["part"], "part_size": pdf["part_size"], "won": won})

    shards = written(units.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    most, depth = max((-(-n // shard_rows) for *_, n in table), default=1), 1
    while fan**depth < most:
        depth += 1
    won = sources.select("source", F.lit(0).cast("long").alias("part"), F.col("seats").alias("won"))
    for level in range(depth - 1, -1, -1):
        parts = shards.groupBy("source", F.expr(f"shard div {fan**level}L").alias("part")).agg(F.sum("shard_size").alias("part_size"))
        above = won.select(F.col("source").alias("of"), F.col("part").alias("above"), F.col("won").alias("seats"))
        parts = parts.join(above, F.col("source").eqNullSafe(F.col("of")) & (F.expr(f"part div {fan}L") == F.col("above")))
        won = written(parts.groupBy("source", "above").applyInPandas(seats_of, "source string, part long, part_size long, won long"), "seats")
    shards = won.withColumnsRenamed({"source": "in_source", "part": "in_shard", "part_size": "shard_size"})

    order = Window.partitionBy("source", "shard").orderBy("lot", "id", "size")
    placed = units.withColumn("first", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("shard") == F.col("in_shard")))
    words = F.col("won") * block_words
    size = F.col("shard_size")
    blocks = F.greatest(F.lit(1).cast("long"), F.expr(f"shard_size div {block_words}"))
    passes = F.when(size == 0, F.lit(0)).otherwise(F.least(F.lit(max_repeat), (words / F.greatest(size, F.lit(1))).cast("long")))
    extra = F.when((size == 0) | (F.col("passes") >= max_repeat), F.lit(0)).otherwise(F.least(F.col("blocks"), F.round((words - F.col("passes") * size) * F.col("blocks") / F.greatest(size, F.lit(1)))))
    placed = placed.withColumn("blocks", blocks).withColumn("passes", passes.cast("long")).withColumn("extra", extra.cast("long"))
    placed = placed.withColumn("turn", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks")))
    placed = placed.withColumn("taken", F.col("passes") * F.col("size") + F.when((F.col("size") > 0) & (F.col("extra") > 0), _extra_words()).otherwise(0))
    out = placed.select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "passes", "first", "shard_size", "blocks", "extra", "turn", *(["row"] if keep else []))
    return out


def _selected(block: Column) -> Column:
    return F.pmod(block * F.lit(STRIDE) + F.col("turn"), F.col("blocks")) < F.col("extra")


def _block(place: Column) -> Column:
    """Number of the block that holds the word at this place of the shard: block i begins at i * shard_size div blocks."""
    top = (place + 1) * F.col("blocks") - 1
    return ((top - F.pmod(top, F.col("shard_size"))) / F.col("shard_size")).cast("long")


def _extra_words() -> Column:
    first, last = F.col("first"), F.col("first") + F.col("size")

    def begin(i: Column) -> Column:
        x = i * F.col("shard_size")
        return ((x - F.pmod(x, F.col("blocks"))) / F.col("blocks")).cast("long")

    return F.aggregate(F.sequence(_block(first), _block(last - 1)), F.lit(0).cast("long"), lambda n, i: n + F.when(_selected(i), F.least(last, begin(i + 1)) - F.greatest(first, begin(i))).otherwise(F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixture itself, with the columns of docs: a row for each pass over a document, and a row with the words in
    selected blocks (with the blanks after each) where a part of it is taken once more. chars_col, if docs has it,
    becomes the length of the new text. Documents of which nothing is taken are gone; see `mix` for all other cases."""
    plan = mix(docs, text_col=text_col, keep=True, **options)
    text = F.col("row")[text_col]
    part = F.filter(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)")), lambda w, i: _selected(_block(F.col("first") + i)))
    some = (F.col("taken") > F.col("passes") * F.col("size"))
    texts = F.concat(F.array_repeat(text, F.col("passes").cast("int")), F.when(some, F.array(F.array_join(part, ""))).otherwise(F.array().cast("array<string>")))
    new = clear_name(docs, "mixed_text")
    rows = plan.select("row", F.explode(texts).alias(new))
    cols = [F.col(new).alias(c) if c == text_col else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*cols)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
