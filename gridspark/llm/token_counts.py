"""Token counts (operator 1): batch encoding in an Arrow function that returns lengths only.

Batches are balanced by bytes and long texts are cut at safe boundaries, see `_vocab`. There is no shuffle: each
input split is read, counted and left. A worker keeps one encoder and a bounded memo.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm._common import field

BATCH_BYTES = 4 << 20


def count_tokens(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens), a null id stays null, repeated rows are counted each, an empty
    table gives no rows. Other columns of docs, whatever their names, are neither read nor returned. Whole texts are
    encoded, without added special tokens, truncation or padding; special strings in a text are what the library's
    default makes of them. `vocab_path` must be readable on every executor."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridspark.llm._vocab import by_bytes, encoder

        enc = encoder(vocab_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n: list[int] = []
            for i, j in by_bytes(b.column(2).to_pylist(), batch_bytes):
                n += enc.count_many([t or "" for t in texts[i:j]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    schema = T.StructType([field(docs, id_col, "id"), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), n_bytes.alias("n_bytes")).mapInArrow(counted, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
