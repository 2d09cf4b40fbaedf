"""Token ids as compressed binary files (operator 7): range asymmetric numeral system, see `rans`.

`write_tokens` deals the documents out to runs of ascending id (one shuffle of the texts, bounds from a pass over the
ids alone), encodes them there and writes one record a segment through Spark's own commit protocol, so a lost executor
or a repeated task leaves no half file. `read_tokens` decodes the records side by side.

A record: shard, segment (their order is that of the ids), ids and lengths of its documents, the shared frequency
table, the directory of its blocks with checkpoints and checksums, the words of its blocks, and a checksum of table
and directory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm._common import bounds, bucket_of, field, new_path, partitions

SEGMENT_IDS = 1 << 21
BATCH_BYTES = 2 << 20
TAIL = [("lengths", T.ArrayType(T.LongType())), ("n_ids", T.LongType()), ("freqs", T.BinaryType()), ("blocks", T.BinaryType()), ("words", T.BinaryType()), ("crc", T.LongType())]


def write_tokens(docs: DataFrame, path: str, vocab_path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of all texts, each followed by end_id, in ascending order of id_col (a number).

    A null text is empty (its end_id alone), rows with a null id come last, rows with one id follow each other in
    order of their text, an empty table writes no record. Other columns of docs are not read. A document is never
    divided: a segment is longer than segment_ids only where one document is."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridspark.llm import rans
        from gridspark.llm._vocab import by_bytes, encoder

        enc = encoder(vocab_path)
        end = np.array([end_id], dtype=enc.width)
        shard, number, held, ids, lengths = None, 0, 0, [], []
        parts: list[np.ndarray] = []

        def record() -> pa.RecordBatch:
            freqs, blocks, words = rans.encode(np.concatenate(parts))
            row = {"shard": [shard], "segment": [number], "ids": [ids], "lengths": [lengths], "n_ids": [held], "freqs": [freqs], "blocks": [blocks], "words": [words], "crc": [zlib.crc32(blocks, zlib.crc32(freqs))]}
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in kinds], schema=kinds)

        for b in batches:
            kinds = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("ids", pa.list_(b.schema.field(1).type)), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("freqs", pa.binary()), ("blocks", pa.binary()), ("words", pa.binary()), ("crc", pa.int64())])
            at, keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, j in by_bytes(pc.binary_length(b.column(2)).to_pylist(), BATCH_BYTES):
                for s, k, found in zip(at[i:j], keys[i:j], enc.encode_many([t or "" for t in texts[i:j]]), strict=True):
                    if parts and (s != shard or held + len(found) + 1 > segment_ids):
                        yield record()
                        number, held, ids, lengths, parts = number + 1, 0, [], [], []
                    if s != shard:
                        shard, number = s, 0
                    parts += [found, end]
                    ids.append(k)
                    lengths.append(len(found) + 1)
                    held += len(found) + 1
        if parts:
            yield record()

    spark = docs.sparkSession
    n = shards or partitions(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ends = bounds(slim, "id", n)
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *(T.StructField(k, t) for k, t in TAIL)])
    rows = slim.select(bucket_of(F.col("id"), ends).alias("shard"), "id", "text").repartitionById(len(ends) + 1, F.col("shard"))
    rows = rows.sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "text")
    rows.mapInArrow(encoded, schema).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per written document: id, start (ids of all documents before it), n_tokens (with the end id),
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers) and, if asked for, tokens (array of long).

    A record whose checksum is wrong, or that has other lengths than ids, fails the job."""
    records = spark.read.parquet(path)
    id_type = records.schema["ids"].dataType.elementType

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridspark.llm import rans

        for b in batches:
            for r in range(b.num_rows):
                one = {k: b.column(i)[r].as_py() for i, k in enumerate(b.schema.names) if k != "ids"}
                if zlib.crc32(one["blocks"], zlib.crc32(one["freqs"])) != one["crc"]:
                    raise ValueError(f"shard {one['shard']}, segment {one['segment']}: its checksum is wrong")
                all_ids = rans.decode(one["freqs"], one["blocks"], one["words"]).astype("<u4", copy=False)
                ends = np.cumsum(one["lengths"])
                if len(all_ids) != one["n_ids"] or (len(ends) and ends[-1] != len(all_ids)):
                    raise ValueError(f"shard {one['shard']}, segment {one['segment']}: its lengths are wrong")
                starts = ends - one["lengths"]
                raw = memoryview(all_ids.tobytes())
                sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                keys = b.column(b.schema.names.index("ids"))[r].values
                k = len(ends)
                cols = [pa.array(np.full(k, one["shard"], np.int32)), pa.array(np.full(k, one["segment"], np.int32)), keys, pa.array(starts.astype(np.int64)), pa.array(one["lengths"], pa.int64()), pa.array(sums, pa.int64())]
                names = ["shard", "segment", "id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(all_ids.astype(np.int64))))
                    names.append("tokens")
                yield pa.RecordBatch.from_arrays(cols, names)

    long = T.LongType()
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("id", id_type), T.StructField("inside", long), T.StructField("n_tokens", long), T.StructField("ids_crc32", long)] + ([T.StructField("tokens", T.ArrayType(long))] if with_ids else []))
    docs = records.select("shard", "segment", "ids", "lengths", "n_ids", "freqs", "blocks", "words", "crc").mapInArrow(decoded, schema)
    # where each segment starts: sums within shards, then over the few rows of shards
    sizes = records.select("shard", "segment", "n_ids")
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    starts = sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_shard")).join(shards, "shard").select("shard", "segment", (F.col("before") + F.col("in_shard")).alias("at"))
    return docs.join(starts, ["shard", "segment"]).select(F.col("id").alias(id_col), (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["tokens"] if with_ids else []))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "op7-tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, with_ids=False)
