"""Golden rows for the text expressions (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from textcurate.functions import labels as L
from textcurate.functions import text as T

STRICT = [
    ("a & b ,c!!?", "A  b,c?", 2),
    ("Hello WORLD. next one.  third", "Hello world. Next one. Third", 5),
    ("", "", 0),
    ("!!!", "!", 1),
    ("it's 5€.. ok . Yes", "Its 5. Ok. Yes", 4),
]
PERMISSIVE = [
    ("Wow — great… ok ....  really ?!", "Wow great ok... really?!"),
    ("a_b  c%%d e ,f", "a_b c d e,f"),
    ("it’s \"fine\" .", "it s \"fine\"."),
]


def _one(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


@pytest.mark.parametrize("raw,clean,words", STRICT)
def test_clean_strict_golden(spark, raw, clean, words):
    r = _one(spark, [(raw,)], "t string", T.clean_strict("t").alias("c"))[0]
    assert r["c"] == clean
    r = _one(spark, [(clean,)], "t string", T.word_count("t").alias("n"))[0]
    assert r["n"] == words


@pytest.mark.parametrize("raw,clean", PERMISSIVE)
def test_clean_permissive_golden(spark, raw, clean):
    assert _one(spark, [(raw,)], "t string", T.clean_permissive("t").alias("c"))[0]["c"] == clean


def test_null_text_is_length_filtered(spark):
    r = _one(spark, [(None,)], "t string", T.word_count(T.clean_strict("t")).alias("n"))[0]
    assert r["n"] == 0


@pytest.mark.parametrize("n,keep", [(4, False), (5, True), (150, True), (151, False)])
def test_length_bounds(spark, n, keep):
    text = " ".join(["w"] * n)
    r = _one(spark, [(text,)], "t string", T.in_length_range(T.word_count("t")).alias("k"))[0]
    assert r["k"] is keep


def test_dup_key_collides_after_strict_clean(spark):
    rows = [("it's",), ("its",)]
    out = _one(spark, rows, "t string", T.dup_key(T.clean_strict("t")).alias("k"))
    assert out[0]["k"] == out[1]["k"] == "its"


def test_complexity_population_std(spark):
    r = _one(spark, [("a b. c d e f. ",)], "t string",
             *[c.alias(n) for c, n in zip(T.text_complexity(F.col("t")), ["r", "avg", "std"])])[0]
    assert r["avg"] == pytest.approx(3.0)
    assert r["std"] == pytest.approx(1.0)
    assert r["r"] == pytest.approx(1.0)


def test_label_functions(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,)], "k int")
    stars = [r[0] for r in df.select(L.collapse5_stars("k")).collect()]
    polar = [r[0] for r in df.select(L.collapse5_polarity("k")).collect()]
    assert stars == [0, 1, 1, 1, 2]
    assert polar == [0, 0, 1, 2, 2]
    a = spark.createDataFrame([([0.1, 0.7, 0.7],)], "p array<double>").select(L.argmax("p")).first()[0]
    assert a == 1
    s = spark.createDataFrame([("POSITIVE",), ("neg",), ("LABEL_2",)], "l string")
    assert [r[0] for r in s.select(L.polarity_norm("l")).collect()] == ["positive", "negative", "neutral"]
