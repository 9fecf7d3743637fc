"""Encoder and scorer contracts (UDF-01/02)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcurate.operators import scoring


def test_embedding_is_unit_and_hash_consistent(spark):
    df = spark.createDataFrame([(1, "Good film, good cast."), (2, "")], "id long, text string")
    rows = {r["id"]: r["embedding"] for r in scoring.embed(df, "text").collect()}
    assert sum(v * v for v in rows[1]) == pytest.approx(1.0)
    assert all(v == 0 for v in rows[2])
    good = scoring.term_hash("good") % scoring.EMBED_DIM
    spark_bucket = df.select(scoring.spark_buckets(F.lit("good"), scoring.EMBED_DIM)).first()[0]
    assert spark_bucket == [good]


def test_naive_bayes_scores_are_probabilities(spark):
    train = spark.createDataFrame(
        [("bad awful", 0), ("okay fine", 1), ("great superb", 2), ("great good", 2)],
        "text string, y int")
    nb = scoring.train_naive_bayes(train, "text", "y")
    df = spark.createDataFrame([(1, "great"), (2, "awful"), (3, "")], "id long, text string")
    out = {r["id"]: r["scores"] for r in scoring.score(df, "text", nb).collect()}
    for s in out.values():
        assert sum(s) == pytest.approx(1.0) and len(s) == 3
    assert max(range(3), key=lambda k: out[1][k]) == 2
    assert max(range(3), key=lambda k: out[2][k]) == 0


def _trained(spark, parts=2, **kw):
    words = {0: "bad awful poor", 1: "okay fine so", 2: "great superb good"}
    rows = [(f"{words[i % 3]} film number{i}", i % 3) for i in range(60)] + [("", 1), (None, 2), ("no label", None)]
    df = spark.createDataFrame(rows, "text string, y int").repartition(parts)
    return rows, scoring.train_softmax(df, "text", "y", {0: 1.5, 1: 0.9, 2: 0.6}, **kw)


def test_softmax_steps_equal_plain_gradient_descent(spark):
    rows, model = _trained(spark, steps=4, dim=32)
    data = [(scoring.unit_counts([scoring.bucket_ids(scoring.tokens(t), 32)], 32), y) for t, y in rows if y is not None]
    x = np.zeros((len(data), 33))
    for i, ((_, at, v), _) in enumerate(data):
        x[i, at] = v
    x[:, 32] = 1
    y = np.array([d[1] for d in data])
    cw = np.array([1.5, 0.9, 0.6])[y]
    w = np.zeros((33, 3))
    for _ in range(4):
        p = np.exp(x @ w)
        p /= p.sum(1, keepdims=True)
        g = x.T @ (cw[:, None] * (p - np.eye(3)[y])) / cw.sum()
        w = w - 4.0 * (g + np.append(np.full(32, 0.0005), 0)[:, None] * w)
    assert np.allclose(model.weights, w, atol=1e-12)


def test_softmax_is_the_same_for_any_partitioning_and_learns(spark):
    _, a = _trained(spark, 1, steps=20)
    _, b = _trained(spark, 9, steps=20)
    assert np.allclose(a.weights, b.weights, atol=1e-10)
    df = spark.createDataFrame([(0, "awful poor"), (1, "fine"), (2, "superb")], "y int, text string")
    assert all(max(range(3), key=lambda k: r["scores"][k]) == r["y"] for r in scoring.score(df, "text", a).collect())


def test_softmax_without_rows(spark):
    model = scoring.train_softmax(spark.createDataFrame([], "text string, y int"), "text", "y", {})
    assert not model.weights.any()


def test_text_scorers_still_plug_in(spark):
    df = spark.createDataFrame([("ab",), ("abcd",)], "text string")
    got = scoring.score(df, "text", lambda: lambda texts: np.array([[float(len(t))] for t in texts])).collect()
    assert sorted(r["scores"] for r in got) == [[2.0], [4.0]]
    assert len(scoring.embed(df, "text", factory=lambda: scoring.HashedBagOfWords(16)).first()["embedding"]) == 16
