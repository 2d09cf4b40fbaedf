"""Line deduplication (operator 3): sharded minimal perfect hashes index fingerprint and count arrays, which lines probe.

1. Each document gives the hashes of its distinct keys (two of 64 bits), written once as a narrow table.
2. Per distinct key: number of documents and smallest id, combined before the shuffle.
3. Per shard of about SHARD_KEYS keys: a minimal perfect hash and its arrays, one record.
4. The few keys with so many documents that they would make a shard hot stand in one small index that every task has
   (at most HOT_KEYS, by the rule that finds them). All other hashes go to their shard's task, which streams them past
   its arrays. No line's text leaves its document and no lines are joined.
5. The hashes to drop come back by document, as a list that is no longer than its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm._common import BLANKS, clear_name, field, lower_az, partitions, written
from gridspark.llm.mph import Index

SHARD_KEYS = 1 << 18
HOT_KEYS = 4096
MIN_CHARS = 10
NO_ID = -(1 << 63)  # stands for a null id


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(BLANKS)))


def _index_of(table: pa.Table) -> Index:
    def col(name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype(np.int64)

    return Index(col("h1").view(np.uint64), col("h2").view(np.uint64), col("docs"), col("first"))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(id, drop): per document with lines to drop, the first hashes of their keys, as array of long."""
    spark = docs.sparkSession
    keys = F.array_distinct(F.filter(F.transform(F.split(F.col(text_col), "\n", -1), line_key), lambda k: F.length(k) >= min_chars))
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(keys).alias("k")).select("id", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))
    pairs = written(pairs, "line-hashes")
    # a null id counts as one document after all others
    lines = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.count("id").alias("n_id"), F.min("id").alias("first"), F.max("id").alias("last"))
    one = F.coalesce((F.col("first") == F.col("last")) & (F.col("n") == F.col("n_id")), F.lit(True))
    lines = written(lines.select("h1", "h2", F.when(one, F.lit(1)).otherwise(F.col("n")).alias("docs"), F.coalesce("first", F.lit(NO_ID)).alias("first"), "n"), "lines")
    n_lines, n_probes = lines.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-n_lines // shard_keys))
    hot_from = max(1000, n_probes // hot_keys)  # so fewer than hot_keys keys have more
    hot = lines.where(F.col("n") > hot_from).limit(hot_keys).toArrow()
    head = spark.sparkContext.broadcast(_index_of(hot).dump())
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int")

    def built(group: pa.Table) -> pa.Table:
        return pa.table({"shard": group.column("shard")[:1], "arrays": pa.array([_index_of(group).dump()], pa.binary())})

    index = lines.where(F.col("n") <= hot_from).select(shard.alias("shard"), "h1", "h2", "docs", "first").groupBy("shard").applyInArrow(built, "shard int, arrays binary")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Index.load(head.value)
        for b in batches:
            h1, h2 = (b.column(i).to_numpy().view(np.uint64) for i in (2, 3))
            found, count, first = top.probe(h1, h2)
            ids = b.column(1)
            same = np.asarray(ids.fill_null(NO_ID)) == first
            state = np.where(found, np.where((count > 1) & ~same, 2, 0), 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(state), ids, b.column(2), b.column(3), pa.nulls(b.num_rows, pa.binary())], ["shard", "state", "id", "h1", "h2", "arrays"]).filter(pa.array(state > 0))

    kinds = "shard int, state int, id long, h1 long, h2 long, arrays binary"
    probes = pairs.select(shard.alias("shard"), "id", "h1", "h2").mapInArrow(routed, kinds)
    probes = probes.withColumn("shard", F.when(F.col("state") == 2, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).otherwise(F.col("shard")))  # decided already: anywhere
    index = index.select("shard", F.lit(0).alias("state"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), "arrays")

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        arrays: dict[int, bytes] = {}
        for b in batches:
            shard, state = np.asarray(b.column(0)), np.asarray(b.column(1))
            for r in np.flatnonzero(state == 0):
                arrays[int(shard[r])] = b.column(5)[int(r)].as_py()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if i == j:
                    continue
                if shard[i] != at:
                    at = int(shard[i])
                    own = Index.load(arrays.pop(at)) if at in arrays else None
                yield from drop(b.slice(i, j - i), own)

    def drop(part: pa.RecordBatch, own: Index | None) -> Iterator[pa.RecordBatch]:
        if not part.num_rows:
            return
        state = np.asarray(part.column(1))
        out = state == 2
        ask = np.flatnonzero(state == 1)
        if len(ask):
            if own is None:
                raise ValueError("hashes came without their shard's arrays")
            h1, h2 = (np.asarray(part.column(i).fill_null(0)).view(np.uint64)[ask] for i in (3, 4))
            found, count, first = own.probe(h1, h2)
            if not found.all():
                raise ValueError("a shard's arrays lack a key")
            out[ask] = (count > 1) & (np.asarray(part.column(2).fill_null(NO_ID))[ask] != first)
        if out.any():
            got = part.filter(pa.array(out))
            yield pa.RecordBatch.from_arrays([got.column(2), got.column(3)], ["id", "h1"])

    both = probes.unionByName(index).repartition(max(partitions(spark), 1), "shard").sortWithinPartitions("shard", "state")
    drops = both.mapInArrow(probed, "id long, h1 long")
    return drops.groupBy("id").agg(F.collect_set("h1").alias("drop"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, with the text that stays in place of text_col, and n_lines, n_dropped.

    A line's key is the line without blanks (`[\\x20\\x09-\\x0D]`) at its ends, A-Z in lower case. Keys of min_chars code
    points or more that stand in two documents or more lose all their lines but those in the document of smallest id.
    Rows with one id are one document, rows with a null id are one document after all others. A null or empty text is
    one empty line. An empty table stays empty. id_col is an integer. If docs has columns n_lines or n_dropped, the new
    ones get underscores before their names."""
    drops = repeated_lines(docs, id_col=id_col, text_col=text_col, **options).withColumnsRenamed({"id": "__drop_id", "drop": "__drop"})
    n_lines, n_dropped = clear_name(docs, "n_lines"), clear_name(docs, "n_dropped")
    rows = docs.join(drops, docs[id_col].cast("long").eqNullSafe(drops["__drop_id"]), "left").select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"), docs[text_col].alias("text"), "__drop")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            texts, drops = b.column(1).cast(pa.binary()), b.column(2)
            out, total, gone = [], [], []
            for t, d in zip(texts, drops, strict=True):
                text = t.as_py() or b""
                n = text.count(b"\n") + 1
                if d.is_valid:
                    bad = {x & 0xFFFFFFFFFFFFFFFF for x in d.as_py()}
                    stay = [x for x in text.split(b"\n") if xxh64_intdigest(x.strip(b" \t\x0b\x0c\r").lower(), 42) not in bad]
                    gone.append(n - len(stay))
                    text = b"\n".join(stay)
                else:
                    gone.append(0)
                out.append(text)
                total.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    long = T.LongType()
    done = rows.mapInArrow(kept, T.StructType([rows.schema["row"], field(docs, text_col, "text"), T.StructField("n_lines", long), T.StructField("n_dropped", long)]))
    cols = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return done.select(*cols, F.col("n_lines").alias(n_lines), F.col("n_dropped").alias(n_dropped))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id <> r.first, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
