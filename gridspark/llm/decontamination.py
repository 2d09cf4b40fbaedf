"""Benchmark decontamination (operator 10, native): canonical templates, joined by the hash of their windows.

A text becomes a template of lower-case tokens in which numbers, names (capitalised words inside a sentence) and units
after numbers are typed placeholders. A second template also takes capitalised words elsewhere for names, unless they are
common; a window counts if it matches in either. Windows of WINDOW tokens are hashed on both sides and joined. A window in
which fewer than LITERAL tokens are no placeholders says nothing by its template: it is hashed as it stands, so rows of
numbers only match word for word. Items of fewer than SHORTEST tokens only match documents that hold nothing else. The
benchmark's side is broadcast where a count shows that it has MOST_BROADCAST windows at most; beyond that both sides are shuffled. A document
is contaminated by an item if it holds half of the item's windows, or enough of them for a passage of PASSAGE tokens,
and the values in matched slots are consistent: equal values in the item stand for equal values in the document.
Different ones may coincide there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm._common import written

WINDOW = 8
SHORTEST = 5  # tokens of items that are looked for within documents
PASSAGE = 13
COVERAGE = 0.5
MOST_BROADCAST = 1_000_000

#: Units that may follow a number (fixed list).
UNITS = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|l|ml|s|sec|min|h|hr|hours|minutes|seconds|days|weeks|months|years|miles|mph|kmh|feet|ft|inches|percent|dollars|euros|cents|usd|eur|degrees|points"
NUMBER, NAME, UNIT, MAYBE = "\u0001", "\u0002", "\u0003", "\u0004"  # MAYBE stands before a name of the second template alone
NUMBER_PATTERN = r"[0-9]+(?:[.,:/][0-9]+)*"
NAME_PATTERN = r"(?<=[\p{Ll}\p{Nd},;:]['\x22)]?\x20)\p{Lu}[\p{L}\p{M}]+"
#: Words that begin sentences and are no names (fixed list).
COMMON = "the|an|this|that|these|those|there|here|it|its|he|she|they|we|you|his|her|their|our|your|my|in|on|at|by|for|from|to|of|with|without|as|if|when|while|after|before|during|since|until|because|although|and|or|but|so|then|now|next|later|finally|first|second|how|what|which|who|whom|whose|where|why|is|are|was|were|be|do|does|did|has|have|had|can|could|will|would|should|may|might|must|not|no|yes|each|every|all|both|some|any|most|many|much|more|one|two|three|let|find|given|suppose|calculate|compute|determine|write|give|use|please|der|die|das|ein|eine|und|wie|was|wer|wenn|le|la|les|un|une|et|il|elle|el|los|las|una|por|que|como|si"
ANY_NAME_PATTERN = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{Nd}}])(?!(?i:{COMMON})(?![\p{{L}}\p{{M}}]))\p{{Lu}}[\p{{L}}\p{{M}}]+"
LITERAL = 3  # tokens of a window that are no placeholders, at least, for its template to count
SIGNS = NUMBER + NAME + UNIT + MAYBE
COUNTS = 1 << 16  # more than the tokens of any window
TOKEN_PATTERN = r"\x04?[\p{L}\p{M}]+|[\x01\x02\x03]"


def unsigned(text: Column) -> Column:
    """The text with blanks where it has the characters that stand for placeholders."""
    return F.when(text.rlike(f"[{SIGNS}]"), F.translate(text, SIGNS, " " * len(SIGNS))).otherwise(text)


def marked(text: Column) -> Column:
    """The tokens of a text's templates: placeholders, words, and words after MAYBE, which are names in the second template."""
    named = F.regexp_replace(F.regexp_replace(unsigned(text), NAME_PATTERN, NAME), ANY_NAME_PATTERN, f"{MAYBE}$0")
    numbered = F.lower(F.regexp_replace(named, NUMBER_PATTERN, f" {NUMBER} "))
    united = F.regexp_replace(numbered, f"(?<={NUMBER} ) ?{MAYBE}?(?:{UNITS})(?![\\p{{L}}\\p{{M}}])", UNIT)
    return F.regexp_extract_all(united, F.lit(TOKEN_PATTERN), F.lit(0))


def template(tokens: Column, anywhere: bool = False) -> Column:
    """The template of marked tokens. anywhere: names may also begin texts, sentences, lines and quotations; both templates
    have their tokens at the same places."""
    return F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit(MAYBE)), F.lit(NAME) if anywhere else F.substring(t, 2, 1 << 30)).otherwise(t))


def values(text: Column) -> Column:
    """The tokens themselves, lower case, one for each of the template: what stands in its slots."""
    marked = F.regexp_replace(unsigned(text), f"({NUMBER_PATTERN})", " $1 ")
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"{NUMBER_PATTERN}|[\p{{L}}\p{{M}}]+"), F.lit(0))


def windows(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, at, h: the hash of each window of width tokens, with the place of its first token, and its hash in the second
    template where that differs. rows: keys, marked, text.

    Each token is hashed once. Hashes of runs of 2, 4, 8, ... tokens are those of two halves, step by step on the arrays
    of a document; a window is put together from the runs whose lengths sum up to its width. The tokens as they stand are
    only cut out where a window needs them."""
    hashes, sums = (lambda x, y: F.xxhash64(x, y)), (lambda x, y: x + y)
    shifted = lambda c, by: F.slice(c, F.lit(1 + by), F.greatest(F.size(c) - by, F.lit(0)))
    runs = [1 << k for k in range(width.bit_length())]

    def rolled(df: DataFrame, how: dict) -> DataFrame:
        """Arrays a1 of single tokens become arrays a of their windows."""
        for n in runs[:-1]:
            df = df.select("*", *[F.zip_with(f"{a}{n}", shifted(F.col(f"{a}{n}"), n), f).alias(f"{a}{2 * n}") for a, f in how.items()])
        done, at = {a: F.col(f"{a}{runs[-1]}") for a in how}, runs[-1]
        for n in reversed(runs[:-1]):
            if width & n:
                done, at = {a: F.zip_with(done[a], shifted(F.col(f"{a}{n}"), at), f) for a, f in how.items()}, at + n
        full = {a: F.slice(x, F.lit(1), F.greatest(F.size(x) - (width - 1), F.lit(0))) for a, x in done.items()}
        return df.select(*[c for c in df.columns if c.rstrip("0123456789") not in how], *[x.alias(a) for a, x in full.items()])

    maybe = lambda t: F.startswith(t, F.lit(MAYBE))
    found = rows.select(
        *keys, "text", F.transform("marked", lambda t: F.when(maybe(t), F.xxhash64(F.substring(t, 2, 1 << 30))).otherwise(F.xxhash64(t))).alias("w1"), F.transform("marked", lambda t: F.when(maybe(t), F.xxhash64(F.lit(NAME))).otherwise(F.xxhash64(t))).alias("v1"),
        F.transform("marked", lambda t: F.when(t.isin(NUMBER, NAME, UNIT), 0).when(maybe(t), 1).otherwise(1 + COUNTS)).alias("c1"),  # words in both templates, in one number
    )
    found = rolled(found, {"w": hashes, "v": hashes, "c": sums})
    bare = F.when(F.exists("c", lambda n: n % COUNTS < LITERAL), values(F.col("text"))).otherwise(F.array().cast("array<string>"))
    found = found.select(*keys, "w", "v", "c", F.transform(bare, lambda t: F.xxhash64(t)).alias("x1"))
    found = rolled(found, {"x": hashes}).select(*keys, F.posexplode(F.arrays_zip("w", "v", "c", "x")).alias("at", "z")).select(*keys, "at", "z.*")
    first = F.when(F.col("c") % COUNTS >= LITERAL, F.xxhash64("w", F.lit(0))).otherwise(F.xxhash64("x", F.lit(1)))
    second = F.when(F.col("c") >= LITERAL * COUNTS, F.xxhash64("v", F.lit(0)))
    found = found.select(*keys, "at", first.alias("w"), second.alias("v"))
    return found.select(*keys, "at", F.explode(F.when(F.col("w") != F.col("v"), F.array("w", "v")).otherwise(F.array("w"))).alias("h"))


def _items(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """item, members, tokens, more, vals, n (windows), width: one row for all items of one template and pattern of equal slots,
    and where too few of its tokens are no placeholders, of equal tokens."""
    b = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    b = b.select("item", "text", marked(F.col("text")).alias("marked"), values(F.col("text")).alias("vals")).where(F.size("marked") > 0)
    b = b.select("*", template(F.col("marked")).alias("tokens"), template(F.col("marked"), True).alias("more"))
    slot = F.col("more")
    pattern = F.transform("vals", lambda v, i: F.when(F.element_at(slot, i + 1).isin(NUMBER, NAME, UNIT), F.array_position("vals", v)))
    size = F.size("tokens")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), size - width + 1))
    few = F.exists(starts, lambda i: F.size(F.filter(F.slice("tokens", i, F.lit(width)), lambda t: ~t.isin(NUMBER, NAME, UNIT))) < LITERAL)
    b = b.withColumn("pattern", F.struct(pattern.alias("p"), F.when((size < SHORTEST) | few, F.col("vals")).alias("v")))
    b = b.groupBy("tokens", "more", "pattern").agg(F.min_by(F.struct("item", "vals", "marked", "text"), "item").alias("f"), F.sort_array(F.collect_set("item")).alias("members"))
    return b.select(F.col("f.item").alias("item"), F.col("f.vals").alias("vals"), F.col("f.marked").alias("marked"), F.col("f.text").alias("text"), "members", "tokens", "more", F.least(F.size("tokens"), F.lit(width)).alias("width")).withColumn("n", F.size("tokens") - F.col("width") + 1)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, coverage: float = COVERAGE, passage: int = PASSAGE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(id, text_hash, item_ids, coverage) of the contaminated rows of docs; rows equal in id and text give one.

    item_ids: all items of the matched templates, ascending; coverage: the greatest share of an item's windows. A null text
    or item and one without tokens is no match, items of fewer than SHORTEST tokens match documents of the same tokens and
    no others, items of fewer than width tokens are looked for as one window of their own length. Control characters are
    blanks. Ids may be null. An empty table on either side gives no rows."""
    spark = docs.sparkSession
    all_items = written(_items(benchmark, item_col, item_text_col, width), "items")
    short, items = all_items.where(F.size("tokens") < SHORTEST), all_items.where(F.size("tokens") >= SHORTEST)
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    tokens = slim.select("id", "text_hash", "text", marked(F.col("text")).alias("marked"))
    hits = []
    for w in widths or [width]:
        own = windows(items.where(F.col("width") == w), ["item"], w)
        own = written(own.select("h", "item", F.col("at").alias("item_at")).distinct(), "windows")
        distinct = own.select("h").distinct()
        few = own.count() <= most_broadcast
        found = windows(tokens, ["id", "text_hash"], w)
        found = found.join(F.broadcast(distinct) if few else distinct, "h", "left_semi")
        hits.append(found.join(F.broadcast(own) if few else own, "h").select("id", "text_hash", "item", "at", "item_at"))
    hits = written(reduce(DataFrame.unionByName, hits).distinct(), "hits")
    per = hits.groupBy("id", "text_hash", "item").agg(F.countDistinct("item_at").alias("matched"))
    per = per.join(items.select("item", "members", "n", "width"), "item")
    enough = (F.col("matched") >= F.ceil(F.col("n") * coverage)) | (F.col("matched") >= F.lit(passage) - F.col("width") + 1)
    per = per.where(enough).select("id", "text_hash", "item", "members", (F.col("matched") / F.col("n")).alias("share"))
    key = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))

    # slots of matched windows, each with the document's value at the same place
    near = hits.alias("h").join(per.select("id", "text_hash", "item").alias("p"), key("h", "p") & (F.col("h.item") == F.col("p.item")), "left_semi")
    length = items.select("item", "width")
    spots = near.join(length, "item").select("id", "text_hash", "item", (F.col("at") - F.col("item_at")).alias("shift"), F.explode(F.sequence(F.col("item_at"), F.col("item_at") + F.col("width") - 1)).alias("spot")).distinct()
    slots = items.select("item", F.posexplode(F.arrays_zip("more", "vals")).alias("spot", "x")).select("item", "spot", F.col("x.more").alias("kind"), F.col("x.vals").alias("item_value")).where(F.col("kind").isin(NUMBER, NAME, UNIT))
    spots = written(spots.join(slots, ["item", "spot"]).withColumn("at", F.col("spot") + F.col("shift")), "slots")
    asked = spots.select("id", "text_hash").distinct()
    texts = slim.alias("d").join(asked.alias("a"), key("d", "a"), "left_semi").dropDuplicates(["id", "text_hash"])
    texts = texts.select("id", "text_hash", F.posexplode(values(F.col("text"))).alias("at", "value"))
    pairs = spots.alias("s").join(texts.alias("t"), key("s", "t") & (F.col("s.at") == F.col("t.at"))).select("s.id", "s.text_hash", "s.item", "s.shift", "s.kind", "s.item_value", "t.value")
    by = ["id", "text_hash", "item", "shift", "kind"]
    odd = pairs.groupBy(*by).agg(F.countDistinct("item_value", "value").alias("p"), F.countDistinct("item_value").alias("i"))
    odd = odd.groupBy("id", "text_hash", "item", "shift").agg(F.max((F.col("p") != F.col("i")).cast("int")).alias("bad")).groupBy("id", "text_hash", "item").agg(F.min("bad").alias("bad")).where("bad = 1")
    per = per.alias("p").join(odd.alias("o"), key("p", "o") & (F.col("p.item") == F.col("o.item")), "left_anti")
    per = per.select("id", "text_hash", "members", "share")
    if not short.isEmpty():
        whole = slim.select("id", "text_hash", values(F.col("text")).alias("vals")).where(F.size("vals") < SHORTEST).distinct()
        per = per.unionByName(whole.join(short.select("vals", "members"), "vals").select("id", "text_hash", "members", F.lit(1.0).alias("share")))
    return per.groupBy("id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("item_ids"), F.max("share").alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item. Cases as in `find_contamination`."""
    bad = find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs[text_col]) == bad["__bad_hash"]), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bad = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnsRenamed({"id": "bad_id", "text_hash": "bad_hash"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    rows = rows.join(bad, rows["doc_id"].eqNullSafe(bad["bad_id"]) & (rows["h"] == bad["bad_hash"]), "left")
    return rows.select("doc_id", F.col("bad_hash").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
