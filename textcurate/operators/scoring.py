"""Model-backed operators (UDF-01/02, ML-01, AUG-05).

Encoders and scorers are pluggable batch callables run inside iterator
pandas UDFs: Arrow batches in, one model load per task, vectorised numpy out.
The offline defaults are small and honest:

* ``HashedBagOfWords`` -- text -> L2-normalised hashed term counts (UDF-01).
* ``NaiveBayesScorer`` -- multinomial naive Bayes over hashed terms, whose
  counts are trained as a Spark aggregation (one partial groupBy), then
  applied per batch with numpy (UDF-02).
* ``train_softmax`` -- class-weighted softmax regression by full-batch gradient
  steps, each an aggregation (ML-01); ``train_classifier`` is pyspark.ml's.

Term hashing takes the first 32 bits of the token's md5, identical in Spark
(``md5``), Python (``hashlib``) and SQL engines, so trained and scored buckets
agree everywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcurate.functions.labels import LABELS
from textcurate.session import cut_lineage

TOKEN = r"[a-z0-9]+"
EMBED_DIM = 256
SCORER_DIM = 4096
SMOOTHING = 1.0
_TOKEN_RE = re.compile(TOKEN)


def tokens(text: str | None) -> list[str]:
    return _TOKEN_RE.findall(text.lower()) if text else []


def term_hash(t: str) -> int:
    return int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16)


def bucket_ids(toks: list[str], dim: int) -> np.ndarray:
    return np.fromiter((term_hash(t) % dim for t in toks), dtype=np.int64, count=len(toks))


class HashedBagOfWords:
    """Default encoder: hashed term counts, L2-normalised."""

    def __init__(self, dim: int = EMBED_DIM):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.of_buckets([bucket_ids(tokens(t), self.dim) for t in texts])

    def of_buckets(self, buckets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(buckets), self.dim), dtype=np.float64)
        for i, b in enumerate(buckets):
            if len(b):
                out[i] = np.bincount(b, minlength=self.dim)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class NaiveBayesScorer:
    """Multinomial naive Bayes over hashed terms -> class probabilities."""

    def __init__(self, log_prior: np.ndarray, log_lik: np.ndarray):
        self.log_prior = log_prior      # (K,)
        self.log_lik = log_lik          # (dim, K)
        self.dim = log_lik.shape[0]

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.of_buckets([bucket_ids(tokens(t), self.dim) for t in texts])

    def of_buckets(self, buckets: list[np.ndarray]) -> np.ndarray:
        return softmax(np.array([self.log_prior + self.log_lik[b].sum(axis=0) for b in buckets]).reshape(-1, self.log_prior.size))


class SoftmaxScorer:
    """Softmax regression over L2-normalised hashed term counts -> class probabilities."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights          # (dim + 1, K), the last row the intercept
        self.dim = len(weights) - 1

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.of_buckets([bucket_ids(tokens(t), self.dim) for t in texts])

    def of_buckets(self, buckets: list[np.ndarray]) -> np.ndarray:
        doc, at, x = unit_counts(buckets, self.dim)
        z = np.zeros((len(buckets), self.weights.shape[1]))
        np.add.at(z, doc, x[:, None] * self.weights[at])
        return softmax(z + self.weights[-1])


def unit_counts(buckets: list[np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the non-zero components of L2-normalised counts."""
    sizes = [len(b) for b in buckets]
    flat = np.concatenate([np.asarray(b, np.int64) for b in buckets]) if sum(sizes) else np.empty(0, np.int64)
    key, n = np.unique(np.repeat(np.arange(len(buckets)), sizes) * dim + flat, return_counts=True)
    doc, at = key // dim, key % dim
    norm = np.sqrt(np.bincount(doc, n.astype(np.float64) ** 2, minlength=len(buckets)))
    return doc, at, n / norm[doc]


def batch_udf(factory: Callable[[], Callable[[list], np.ndarray]], element: T.DataType):
    """Iterator pandas UDF value -> array<element>; ``factory`` runs once per
    task (model load), the callable once per Arrow batch."""

    @F.pandas_udf(T.ArrayType(element))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            mat = model(s.tolist())
            yield pd.Series(list(mat))

    return run


def _hashed(model, text: str, element: T.DataType) -> Column:
    """The model's result on tokens that the JVM has hashed: Python sees numbers only."""
    return batch_udf(lambda: model.of_buckets, element)(F.coalesce(spark_buckets(F.col(text), model.dim), F.array().cast("array<bigint>")))


def embed(df: DataFrame, text: str, factory=None, out: str = "embedding",
          element: T.DataType = T.DoubleType()) -> DataFrame:
    """UDF-01: text -> unit vector, in Arrow batches. ``factory`` makes an encoder of text
    lists; without one texts are hashed in the JVM and counted by ``HashedBagOfWords``."""
    if factory is None:
        return df.withColumn(out, _hashed(HashedBagOfWords(), text, element))
    return df.withColumn(out, batch_udf(factory, element)(F.col(text)))


def spark_buckets(text: Column, dim: int) -> Column:
    """The same hashed tokens as ``tokens``/``bucket_ids``, as a Column."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)
    return F.transform(toks, lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)))


def train_naive_bayes(df: DataFrame, text: str, label_idx: str, dim: int = SCORER_DIM,
                      k: int = len(LABELS)) -> NaiveBayesScorer:
    """Counts per (class, bucket) by one aggregation with map-side combine; the
    result has at most dim x K rows (bounded by configuration), so it is the
    only thing brought to the driver."""
    ex = df.select(F.col(label_idx).alias("y"), F.explode(spark_buckets(F.col(text), dim)).alias("b"))
    counts = ex.groupBy("y", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    priors = df.groupBy(label_idx).agg(F.count(F.lit(1)).alias("n")).collect()
    mat = np.zeros((dim, k))
    for r in counts:
        mat[int(r["b"]), int(r["y"])] = r["n"]
    prior = np.zeros(k)
    for r in priors:
        prior[int(r[label_idx])] = r["n"]
    log_prior = np.log((prior + SMOOTHING) / (prior.sum() + SMOOTHING * k))
    log_lik = np.log((mat + SMOOTHING) / (mat.sum(axis=0, keepdims=True) + SMOOTHING * dim))
    return NaiveBayesScorer(log_prior, log_lik)


def score(df: DataFrame, text: str, scorer, out: str = "scores") -> DataFrame:
    """UDF-02: text -> class scores (array<double>) in Arrow batches. ``scorer`` is a model
    over hashed tokens (one with ``of_buckets``), or a factory of scorers of text lists."""
    if hasattr(scorer, "of_buckets"):
        return df.withColumn(out, _hashed(scorer, text, T.DoubleType()))
    return df.withColumn(out, batch_udf(scorer, T.DoubleType())(F.col(text)))


def relabel(unlabelled: DataFrame, text: str, scorer, out: str = "sentiment") -> DataFrame:
    """AUG-05: score the rows without a label, turn the top class into a
    classifier-style label string and normalise it (TXT-11)."""
    from textcurate.functions.labels import argmax, polarity_norm

    scored = score(unlabelled, text, scorer, "_scores")
    names = F.array(*[F.lit(x.upper()) for x in LABELS])
    raw = F.element_at(names, (argmax("_scores") + 1).cast("int"))
    return scored.withColumn(out, polarity_norm(raw)).drop("_scores")


def _features(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Label, weight and unit counts of some rows at a time."""
    for batch in batches:
        doc, at, x = unit_counts([np.asarray(b, np.int64) for b in batch.column("buckets").to_pylist()], dim)
        offsets = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("cw"), pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
                                          pa.ListArray.from_arrays(offsets, pa.array(x))], ["y", "cw", "at", "x"])


def _gradients(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The task's part of the gradient, one row per bucket that occurs; the last one is the
    intercept's."""
    k = weights.shape[1]
    total, used = np.zeros(weights.shape), np.zeros(len(weights), bool)
    for batch in batches:
        if not len(batch):
            continue
        at, x = batch.column("at").flatten().to_numpy(), batch.column("x").flatten().to_numpy()
        doc = np.repeat(np.arange(len(batch)), batch.column("at").value_lengths().to_numpy())
        z = np.zeros((len(batch), k))
        np.add.at(z, doc, x[:, None] * weights[at])
        r = softmax(z + weights[-1])
        r[np.arange(len(r)), batch.column("y").to_numpy()] -= 1.0
        r *= batch.column("cw").to_numpy()[:, None]
        np.add.at(total, at, x[:, None] * r[doc])
        total[-1] += r.sum(axis=0)
        used[at] = used[-1] = True
    rows = np.flatnonzero(used)
    yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(list(total[rows]), pa.list_(pa.float64()))], ["b", "g"])


def train_softmax(train: DataFrame, text: str, label_idx: str, class_weights: dict[int, float], steps: int = 30, rate: float = 4.0,
                  l2: float = 0.0005, dim: int = SCORER_DIM, k: int = len(LABELS)) -> SoftmaxScorer:
    """ML-01: class-weighted softmax regression by full-batch gradient steps from zero.

    The features are made once. Each step is one pass that adds up the tasks' gradients, a
    row per bucket, so the model is the same for every partitioning (up to rounding); the
    driver holds the weights alone, (dim + 1) * k numbers."""
    cw = F.create_map(*[v for c in range(k) for v in (F.lit(c).cast("long"), F.lit(float(class_weights.get(c, 1.0))))])
    y = F.col(label_idx).cast("long")
    rows = train.where(y.isNotNull()).select(y.alias("y"), F.element_at(cw, y).alias("cw"), F.coalesce(
        spark_buckets(F.col(text), dim), F.array().cast("array<bigint>")).alias("buckets"))
    feats = cut_lineage(rows.mapInArrow(partial(_features, dim=dim), "y long, cw double, at array<int>, x array<double>"))
    mass = feats.agg(F.sum("cw")).first()[0]
    w = np.zeros((dim + 1, k))
    shrink = np.append(np.full(dim, l2), 0.0)[:, None]
    for _ in range(steps if mass else 0):
        parts = feats.mapInArrow(partial(_gradients, weights=w), "b int, g array<double>")
        g = np.zeros(w.shape)
        for r in parts.groupBy("b").agg(*[F.sum(F.col("g")[c]).alias(f"g{c}") for c in range(k)]).collect():  # at most dim + 1 rows
            g[r["b"]] = [r[f"g{c}"] for c in range(k)]
        w = w - rate * (g / mass + shrink * w)
    return SoftmaxScorer(w)


def train_classifier(train: DataFrame, text: str, label_idx: str, weight: str | None = None,
                     num_features: int = SCORER_DIM, max_iter: int = 30):
    """ML-01: RegexTokenizer -> HashingTF -> IDF -> class-weighted multinomial
    LogisticRegression, trained distributed with pyspark.ml."""
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN, gaps=False)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_feat")
    lr = LogisticRegression(featuresCol="_feat", labelCol=label_idx, maxIter=max_iter,
                            regParam=0.01, family="multinomial",
                            **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[tok, tf, idf, lr]).fit(train)


def apply_classifier(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("probs", vector_to_array("probability")) \
              .withColumn("pred", F.col("prediction").cast("long")) \
              .drop("_tok", "_tf", "_feat", "rawPrediction", "probability", "prediction")
