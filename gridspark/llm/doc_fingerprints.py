"""Document fingerprints (operator 8, native): a homomorphic multiset hash over paragraphs.

A paragraph (line) hashes to a wide vector of two parts: EQUAL sums of 32 bits, from independent hashes of the
paragraph, and NEAR signs, from hashes of its word pairs (the last word pairs with nothing). A document's vector is the
sum of its paragraphs', modulo 2**32 in both parts. So the order of paragraphs does not matter, a paragraph is added or taken
away by adding or subtracting its vector, and equal multisets have equal sums. The signs also tell how alike two
documents are: the inner product of two sums estimates the word pairs that they share. A sum of signs stays below the
modulus for any text of less than 2**31 words, so long repetitive texts are as alike as they should be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm._common import bounds, bucket_of, partitions

EQUAL = 8  # lanes of 32 bits: even, from EQUAL / 2 hashes
NEAR = 64  # lanes of signs
BUCKET_ROWS = 2048  # rows that are put in order together

_PAIR = (1 << 32) | 1


def _mod(x: Column, power: int) -> Column:
    return F.pmod(x, F.lit(1 << power))


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, equal (array of long), near (array of long), pairs (long): the vector of each row of distinct keys.

    A row's words pass one by one through sums that are combined where they stand; nothing of a text is gathered."""
    lines = rows.select(*keys, F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
    words = F.array_remove(F.split("line", r"[\x20\x09-\x0D]+"), "")
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("b"))
    each = lines.select(*keys, "line", F.posexplode_outer(pairs).alias("pos", "pair"))
    h = F.when(F.col("pos").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("pair.a", "pair.b"))
    each = each.select(*keys, F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("line")).alias("line"), h.alias("h"), F.col("pos").isNotNull().cast("long").alias("one"))
    sums = []
    for k in range(EQUAL // 2):
        full = F.xxhash64(F.lit(k), "line")
        for i, half in enumerate((full.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(full, 32))):
            sums.append(F.sum(F.when(F.col("line").isNotNull(), half).otherwise(F.lit(0).cast("long"))).alias(f"e{2 * k + i}"))
    sums += [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_PAIR))).alias(f"n{i}") for i in range(NEAR // 2)]
    out = each.groupBy(*keys).agg(*sums, F.sum("one").alias("pairs"))
    sign = lambda ones: _mod(2 * ones - F.col("pairs"), 32)
    low = [sign(F.col(f"n{i}").bitwiseAND(F.lit(0xFFFFFFFF))) for i in range(NEAR // 2)]
    high = [sign(F.shiftrightunsigned(f"n{i}", 32)) for i in range(NEAR // 2)]
    return out.select(*keys, F.array(*[_mod(F.col(f"e{i}"), 32) for i in range(EQUAL)]).alias("equal"), F.array(*low, *high).alias("near"), "pairs")


def printed(equal: Column, near: Column) -> Column:
    """A fingerprint as text: 8 hex digits a lane, the first part before the second."""
    return F.array_join(F.transform(F.concat(equal, near), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def parse(fingerprint: Column) -> tuple[Column, Column]:
    """The two parts of a printed fingerprint."""
    part = lambda at, n: F.transform(F.sequence(F.lit(at), F.lit(at + n - 1)), lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return part(0, EQUAL), part(EQUAL, NEAR)


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The printed fingerprint of the paragraphs of both (sign 1), or of a's less b's (sign -1)."""
    (e, n), (f, m) = parse(a), parse(b)
    return printed(F.zip_with(e, f, lambda x, y: _mod(x + sign * y, 32)), F.zip_with(n, m, lambda x, y: _mod(x + sign * y, 32)))


def likeness(equal: Column, near: Column, other_equal: Column, other_near: Column) -> Column:
    """0 to 1: twice the estimated inner product over the sum of squares; 1 for equal vectors."""
    centred = lambda x: (F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    square = lambda a: total(F.transform(a, lambda x: centred(x) * centred(x)))
    inner = total(F.zip_with(near, other_near, lambda x, y: centred(x) * centred(y)))
    sizes = square(near) + square(other_near)
    return F.when((equal == other_equal) & (near == other_near), F.lit(1.0)).when(sizes == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * inner / F.greatest(sizes, F.lit(1.0)))))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) per row of docs. A null text is an empty one: one empty paragraph. Ids may be null or repeat; other
    columns are not read; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = vectors(rows, ["row", "id"], "text")
    return found.select(F.col("id").alias(id_col), printed(F.col("equal"), F.col("near")).alias("fingerprint"))


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form: its last half replaced by the first half (as many code points, or all) of the next.

    One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The order
    is that of the id (a number), nulls last, then of the text; after the last comes the first. A null text is empty. Rows
    with one id stand side by side in order of their texts. An empty table gives no rows.

    Texts are shuffled once, into short runs of consecutive ids. Only the first row of each run goes to the run before."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = bounds(slim, "id", max(partitions(spark), min(10_000, -(-slim.count() // BUCKET_ROWS))))
    slim = slim.withColumn("run", bucket_of(F.col("id"), ends))
    order = [F.col("id").asc_nulls_last(), F.col("text")]
    # the first row of the next run that has any; after the last run, the first run
    first = slim.groupBy("run").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text")).alias("f"))
    first = first.select("run", F.col("f.text").alias("text"))
    runs = Window.orderBy("run")
    follow = first.select("run", F.coalesce(F.lead("run").over(runs), F.first("run").over(runs.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_run"))
    heads = vectors(first, ["run"], "text").withColumnsRenamed({"run": "next_run", "equal": "head_equal", "near": "head_near"}).drop("pairs")
    heads = follow.join(first.select(F.col("run").alias("next_run"), F.col("text").alias("head")), "next_run").join(heads, "next_run").drop("next_run")

    within = Window.partitionBy("run").orderBy(*order)
    rows = slim.select("*", F.row_number().over(within).alias("place"), F.lead("text").over(within).alias("after")).join(heads.select("run", "head"), "run")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("after", "head"), F.lit(1), half))
    rows = rows.select("run", "place", "id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    both = F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("t")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("t")))
    rows = rows.select("run", "place", "id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), F.explode(both).alias("x")).select("run", "place", "id", "n_chars", "sha", F.col("x.form").alias("form"), F.col("x.t").alias("text"))
    found = vectors(rows, ["run", "place", "form", "id", "n_chars", "sha"], "text").drop("pairs")
    forms = Window.partitionBy("run").orderBy("place", "form")
    v = F.struct("equal", "near")
    found = found.select("*", F.lead(v, 1).over(forms).alias("e"), F.lead(v, 2).over(forms).alias("x")).where("form = 0").join(heads.select("run", "head_equal", "head_near"), "run")
    next_equal, next_near = F.coalesce("x.equal", "head_equal"), F.coalesce("x.near", "head_near")
    return found.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        printed(F.col("equal"), F.col("near")).alias("fingerprint"), printed(F.col("e.equal"), F.col("e.near")).alias("edited_fingerprint"),
        likeness(F.col("equal"), F.col("near"), F.col("e.equal"), F.col("e.near")).alias("near_edited"), likeness(F.col("equal"), F.col("near"), next_equal, next_near).alias("near_next"),
    )


def op8_doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
