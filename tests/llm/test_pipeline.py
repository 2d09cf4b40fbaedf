"""The pipeline on a small table: what has to go goes, what is clean stays, the last stage's rows are those of the files."""

import brute
import numpy as np
import public_tokenizers as P
import pytest
from conftest import make_texts

import corpus_pipeline
from gridspark.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    rng = random.Random(6)
    d = str(tmp_path_factory.mktemp("tables"))
    texts = [t for t in dict.fromkeys(make_texts(160, seed=9)) if "changed" not in t and len(t.split()) > 25]
    toxic = [t + " you idiot moron, pathetic " + t[:40] for t in make_texts(60, seed=10)]
    item = "what is the sum of all the numbers from one to ten in base nine"
    all_texts = [*texts, *toxic, texts[0], texts[1] + " x", "start " + item + " end of it " + texts[2][:30], None, ""]
    rows = [(k, t, "en", rng.choice(["a", "b", "c"]), len(t or "")) for k, t in enumerate(all_texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(k, 1, int(len(texts) <= k < len(texts) + len(toxic))) for k in range(len(texts) + len(toxic))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, all_texts, len(texts), len(toxic)


def test_stages(spark, tables, tmp_path):
    d, texts, n, bad = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    toxic, near, clean, mixed, tokens = map(set, kept)
    assert len(toxic & set(range(n, n + bad))) <= 0.2 * bad and len(toxic & set(range(n))) >= 0.95 * n
    first = n + bad
    assert not near & {first, first + 1} and len(near) >= len(toxic) - 5
    assert first + 2 not in clean and near - clean <= {first + 2}
    assert mixed <= clean and tokens == mixed
    again = spark.read.parquet(str(tmp_path / "mixing")).select("doc_id", "text").collect()
    want = brute.op7(sorted(((r["doc_id"], r["text"]) for r in again), key=lambda r: (r[0], r[1] or "")), P.path("byte_bpe_50k.json"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in docs.collect())
    assert [(i, s, c, h) for s, i, c, h in got] == want


def test_run(spark, tables):
    d, *_ = tables
    a, b = (sorted(tuple(r) for r in corpus_pipeline.run(spark, d).collect()) for _ in range(2))
    assert a == b and a


def test_every_query_runs(spark, tables):
    d, texts, *_ = tables
    for name, q in queries().items():
        df = q(spark, d)
        assert df.count() == len(texts) or name == "op4_secret_scan", name
    assert set(oracle_sql()) <= set(queries())


def test_line_dedup_sql(spark, tables):
    import duckdb

    d, *_ = tables
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    res = con.execute(oracle_sql()["op3_line_dedup"])
    want = sorted(res.fetchall())
    got = queries()["op3_line_dedup"](spark, d).select(*[c[0] for c in res.description])
    assert sorted(tuple(r) for r in got.collect()) == want
    assert np.array([w[1] for w in want]).min() >= 1
