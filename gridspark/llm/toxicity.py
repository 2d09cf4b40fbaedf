"""Toxicity (operator 2): a bag of subword vectors averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of itself, hashed into BUCKETS rows, so a
misspelling that was never seen shares most of them. A bag is a run of WINDOW words, in which a word that is
repeated counts once and then as an average word: its mean goes through a linear softmax. A document's score is that of its strongest run, whatever its length, so a few toxic words are not thinned out
by a long text. Labels belong to documents, so training alternates: it picks each toxic document's strongest run and
each clean document's strongest and some random ones, then fits vectors and softmax on these bags.

The softmax of a mean is linear in its words, so a trained model is one number a bucket and a bias: 1 MB for executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm._common import field, written

BUCKETS = 1 << 18
DIMENSIONS = 8
WINDOW = 16
NGRAMS = (3, 4, 5, 6)
#: Bounds of the sample that a model is fitted on, in labelled rows (taken in the order of a hash of the id).
MAX_TOXIC, MAX_CLEAN = 2000, 4000
EPOCHS = 14
LEFT_OUT = 0.2  # of the toxic documents, those with the weakest runs may be mislabelled: a round leaves them out
MEMO = 500_000  # words kept by a worker

WORDS = re.compile(r"[^\W_]+").findall
_CHUNK, _STEP = 24, 20


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of '<word>' and of the word itself, and each word's number of them."""
    chunks, owner = [], []
    for i, w in enumerate(words):
        w = f"<{w}>"
        for at in range(0, max(1, len(w) - (_CHUNK - _STEP)), _STEP):
            chunks.append(w[at : at + _CHUNK])
            owner.append(i)
    own = np.array(owner)
    chars = np.array(chunks, dtype=f"<U{_CHUNK}").view(np.uint32).reshape(len(chunks), _CHUNK).astype(np.uint64)
    length = (chars > 0).sum(axis=1)
    prime = np.uint64(0x9E3779B97F4A7C15)
    found, belongs = [], []
    for n in NGRAMS:
        h = np.full((len(chunks), _CHUNK - n + 1), n, np.uint64)
        for k in range(n):
            h = (h ^ chars[:, k : _CHUNK - n + 1 + k]) * prime
            h ^= h >> np.uint64(29)
        fits = np.arange(_CHUNK - n + 1)[None, :] + n <= length[:, None]
        found.append(h[fits])
        belongs.append(np.broadcast_to(own[:, None], h.shape)[fits])
    whole = np.zeros(len(words), np.uint64)
    weight = (np.arange(_CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * prime
    np.add.at(whole, own, (chars * weight).sum(axis=1) * (np.arange(len(chunks), dtype=np.uint64) - np.searchsorted(own, own).astype(np.uint64) + np.uint64(1)))
    found.append((whole ^ (whole >> np.uint64(31))) * prime)
    belongs.append(np.arange(len(words)))
    bucket, word = np.concatenate(found), np.concatenate(belongs)
    order = np.argsort(word, kind="stable")
    return ((bucket[order] >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), np.bincount(word, minlength=len(words))


@dataclass
class Model:
    weights: np.ndarray  # of the buckets: label 1 less label 0
    bias: float
    plain: float = 0.0  # score of an average word of clean documents

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.float32)
        at, n = subwords(words)
        return np.add.reduceat(self.weights[at], np.concatenate([[0], np.cumsum(n)[:-1]])) / n


def once(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words do not stand among the window - 1 words before them; codes are equal for equal words."""
    order = np.argsort(codes, kind="stable")
    again = (codes[order[1:]] == codes[order[:-1]]) & (np.diff(order) < window)
    new = np.ones(len(codes), bool)
    new[order[1:][again]] = False
    return new


def strongest(scores: np.ndarray, codes: np.ndarray, plain: float = 0.0, window: int = WINDOW) -> tuple[float, int]:
    """Mean of the strongest run of `window` words (of all, if there are fewer), and where it begins."""
    n = len(scores)
    scores = np.where(once(codes, window), scores, min(plain, 0.0))
    if n <= window:
        return (float(scores.mean()) if n else 0.0), 0
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    runs = total[window:] - total[:-window]
    i = int(runs.argmax())
    return float(runs[i]) / window, i


def fit(texts: Iterable[str | None], labels: list[int], check: list[bool], *, seed: int = 0, epochs: int = EPOCHS) -> Model:
    """Fits on the texts not marked as `check`; those set the bias, so that a score of 0.5 parts the classes best."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in WORDS((t or "").lower())], np.int64) for t in texts]
    y, held = np.array(labels, np.int64), np.array(check, bool)
    if not len(number) or len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -4.0 if not len(y) or y.mean() < 0.5 else 4.0)
    known = list(number)
    parts = [subwords(known[i : i + 20_000]) for i in range(0, len(known), 20_000)]  # in parts: bounded memory
    flat, count = np.concatenate([a.astype(np.int32) for a, _ in parts]), np.concatenate([c for _, c in parts])
    del parts, known, number
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    layer[0] = (-0.1, 0.1)
    sum_v, sum_l, sum_b = np.full(BUCKETS, 1e-6, np.float32), np.full_like(layer, 1e-6), np.full_like(bias, 1e-6)

    def scores() -> np.ndarray:
        return np.add.reduceat((vectors @ (layer[:, 1] - layer[:, 0]))[flat], start) / count

    def step(bags: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        nonlocal vectors, layer, bias
        size = np.array([len(b) for b in bags])
        bags = [np.unique(b) for b in bags]
        words, inverse = np.unique(np.concatenate(bags), return_inverse=True)
        row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        n = count[words]
        ends = np.cumsum(n)
        at = flat[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(start[words], n)]
        mean = np.add.reduceat(vectors[at], ends - n) / n[:, None]
        bag = np.zeros((len(bags), DIMENSIONS), np.float32)
        np.add.at(bag, row, mean[inverse])
        bag /= size[:, None]
        z = bag @ layer + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(bags)), target] -= 1
        g = (p * weight[:, None]).astype(np.float32)
        to_bag = (g @ layer.T) / size[:, None]
        to_word = np.zeros((len(words), DIMENSIONS), np.float32)
        np.add.at(to_word, inverse, to_bag[row])
        d_layer, d_bias = bag.T @ g, g.sum(axis=0)
        rows, back = np.unique(at, return_inverse=True)
        d = np.zeros((len(rows), DIMENSIONS), np.float32)
        np.add.at(d, back, np.repeat(to_word / n[:, None], n, axis=0))
        sum_v[rows] += (d * d).mean(axis=1)
        vectors[rows] -= rate * d / np.sqrt(sum_v[rows])[:, None]
        sum_l[:] += d_layer**2
        sum_b[:] += d_bias**2
        layer = layer - 0.3 * rate * d_layer / np.sqrt(sum_l)
        bias = bias - 0.3 * rate * d_bias / np.sqrt(sum_b)

    def average(score: np.ndarray) -> float:
        return float(np.mean([score[docs[i]].mean() for i in clean])) if clean else 0.0

    toxic = [i for i in np.flatnonzero((y == 1) & ~held) if len(docs[i])]
    clean = [i for i in np.flatnonzero((y == 0) & ~held) if len(docs[i])]
    for epoch in range(epochs):
        score = scores()
        bags, target = [], []

        def take(i: int, at: int, label: int) -> None:
            bags.append(docs[i][at : at + WINDOW])
            target.append(label)

        plain = average(score)
        best = {i: strongest(score[docs[i]], docs[i], plain) for i in toxic + clean}
        floor = np.quantile([best[i][0] for i in toxic], LEFT_OUT) if epoch >= 3 and toxic else -np.inf
        for i in toxic:
            if best[i][0] >= floor:
                if epoch >= 2:
                    take(i, best[i][1], 1)
                else:
                    for at in rng.integers(0, max(1, len(docs[i]) - WINDOW + 1), 12):
                        take(i, int(at), 1)
        for i in clean:
            take(i, best[i][1], 0)
            for at in rng.integers(0, max(1, len(docs[i]) - WINDOW + 1), 2 if epoch >= 2 else 6):
                take(i, int(at), 0)
        goal = np.array(target)
        share = np.bincount(goal, minlength=2)
        weight = np.where(goal == 1, min(8.0, max(1.0, share[0] / max(1, share[1]) / 2)), 1.0)
        order = rng.permutation(len(bags))
        for s in range(0, len(order), 256):
            k = order[s : s + 256]
            step([bags[j] for j in k], goal[k], weight[k], 0.25 * (1 - 0.8 * epoch / epochs))
    score = scores()
    model = Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), 0.0, average(score))
    use = held if len(set(y[held].tolist())) == 2 else np.ones(len(y), bool)
    best = np.array([strongest(score[d], d, model.plain)[0] for d in docs])[use]
    model.bias = -_threshold(best, y[use])
    return model


def _threshold(best: np.ndarray, y: np.ndarray) -> float:
    """The middle of the scores that lose least, a clean document that is rejected counting as two toxic ones that are not."""
    cut = np.unique(best)
    cut = np.concatenate([[cut[0] - 1], (cut[1:] + cut[:-1]) / 2, [cut[-1] + 1]])
    toxic, clean = np.sort(best[y == 1]), np.sort(best[y == 0])
    loss = np.searchsorted(toxic, cut) / len(toxic) + 2 * (1 - np.searchsorted(clean, cut) / len(clean))
    good = cut[loss <= loss.min() + 1e-9]
    return float((good.min() + good.max()) / 2)


def fold(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 5


def _sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """id, text, label, check of at most max_toxic + max_clean labelled rows whose fold is not 0; those of fold 1 are the check."""
    slim = labels.select(F.col(id_col).alias("lid"), (F.col(label_col) == 1).cast("int").alias("label")).where("lid is not null and label is not null").where(fold(F.col("lid")) != 0).dropDuplicates(["lid"])
    order = [F.xxhash64("lid"), F.col("lid")]
    some = slim.where("label = 1").orderBy(*order).limit(max_toxic).unionByName(slim.where("label = 0").orderBy(*order).limit(max_clean))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("id") == F.col("lid"))  # of bounded size
    return found.select("id", "text", "label", (fold(F.col("id")) == 1).alias("check"))


def training_sample(docs: DataFrame, labels: DataFrame, **options) -> list[tuple[str, int, bool]]:
    """(text, label, check) of the rows that `train` fits on."""
    rows = _sample(docs, labels, **options).toPandas().sort_values(["id", "text"], kind="stable")
    return list(zip(rows["text"].fillna("").tolist(), rows["label"].astype(int).tolist(), rows["check"].tolist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, *, seed: int = 0, **options) -> Model:
    """A model from the labelled rows of docs whose fold (crc32 of the id as text, mod 5) is not 0. Without any, all is clean.

    One task fits it on the sample, whose size is bounded; the driver gets the model alone, never the texts."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        texts = (t.as_py() for b in held for t in b.column("text"))
        model = fit(texts, [y for b in held for y in b.column("label").to_pylist()], [c for b in held for c in b.column("check").to_pylist()], seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()]), pa.array([float(model.bias)]), pa.array([float(model.plain)])], ["weights", "bias", "plain"])

    sample = written(_sample(docs, labels, **options), "toxicity-sample")
    rows = sample.coalesce(1).sortWithinPartitions("id", F.col("text").asc_nulls_last())
    found = rows.mapInArrow(fitted, "weights binary, bias double, plain double").collect()
    if not found:  # no partition, no row
        return fit([], [], [], seed=seed)
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"], found[0]["plain"])


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1), predicted (1 if score >= 0.5). Only the text is looked at.

    A null or empty text, and one without letters or digits, has the score of a bag of zero, below 0.5. Null ids stay,
    repeated rows are scored each, an empty table gives no rows, other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.plain))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        memo: dict[str, int] = {}  # numbers of words
        scores = np.zeros(0)
        for b in batches:
            out = np.zeros(b.num_rows)
            for at in range(0, b.num_rows, 500):
                if len(memo) > MEMO:
                    memo, scores = {}, np.zeros(0)
                words = [WORDS((t or "").lower()) for t in b.column(1)[at : at + 500].to_pylist()]
                new = list({w for ws in words for w in ws}.difference(memo))
                memo.update(zip(new, range(len(scores), len(scores) + len(new)), strict=True))
                scores = np.concatenate([scores, *(own.word_scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
                for k, ws in enumerate(words):
                    codes = np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))
                    out[at + k] = strongest(scores[codes], codes, own.plain)[0] if ws else min(0.0, -own.bias - 1)
            z = np.clip(out + own.bias, -30, 30)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)))], ["id", "score"])

    schema = T.StructType([field(docs, id_col, "id"), T.StructField("score", T.DoubleType())])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scored, schema)
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text the model does not reject. Cases as in `score_toxicity`."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return score_toxicity(rows, model, id_col="row").where("predicted = 0").select("row.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
