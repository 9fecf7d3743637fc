"""Augmentation on its own fixture (the driver texts contain no synonym keys)."""

import hashlib
import json

from pyspark.sql import functions as F

from textcurate.operators import augment as A


def test_synonyms_replace_whole_tokens(spark):
    df = spark.createDataFrame([(1, "The Patient, got treatment. patients stay")], "id long, text string")
    out = df.select(A.replace_synonyms(F.col("text"), F.col("id")).alias("t")).first()["t"]
    words = out.split(" ")
    assert words[0] == "The" and words[-2:] == ["patients", "stay"]
    assert "Patient," not in out and "treatment." not in out
    assert any(s in out for s in A.SYNONYMS["patient"])
    assert any(s in out for s in A.SYNONYMS["treatment"])
    again = df.select(A.replace_synonyms(F.col("text"), F.col("id"))).first()[0]
    assert again == out


def test_inject_adds_one_phrase_anywhere(spark):
    rows = [(i, "a b c") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    df = A.with_phrase(df, "id", A.phrase_table(spark))
    out = df.select(A.inject_phrase(F.col("text"), F.col("id"), F.col("_phrase")).alias("t")).collect()
    positions = set()
    for r in out:
        ws = r["t"].split(" ")
        phrase = next(p for p in A.FALLBACK_PHRASES if p in r["t"])
        assert r["t"].replace(phrase, "").split() == ["a", "b", "c"]
        positions.add(ws.index(phrase.split(" ")[0]))
    assert positions == {0, 1, 2, 3}


def test_augmented_rows_double(spark):
    df = spark.createDataFrame([(7, "x y z", "positive")], "id long, text string, sentiment string")
    rows = A.augmented_rows(df, "id", "text", "sentiment", A.phrase_table(spark)).collect()
    assert sorted(r["id"] for r in rows) == ["7_aug", "7_orig"]
    assert {r["sentiment"] for r in rows} == {"positive"}


def test_phrase_file(spark, tmp_path):
    """262 phrases of a pretty-printed file: numbered by hash, each row gets one, all occur."""
    phrases = [f"and perhaps {i}," for i in range(260)] + ["twice,", "twice,"]
    (tmp_path / "p.json").write_text(json.dumps({"ambiguous_phrases": phrases}, indent=2))
    got = A.phrase_table(spark, str(tmp_path / "p.json"))
    rows = got.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(262))
    assert [r["phrase"] for r in rows] == sorted(phrases, key=lambda p: (hashlib.md5(p.encode()).hexdigest(), p))
    picked = A.with_phrase(spark.range(6000), "id", got)
    assert picked.count() == 6000 and picked.select("_phrase").distinct().count() == 261
    again = A.with_phrase(spark.range(6000).repartition(7), "id", A.phrase_table(spark, str(tmp_path)))
    assert again.exceptAll(picked).count() == 0


def test_phrase_fallback_and_empty_file(spark, tmp_path):
    gone = A.phrase_table(spark, str(tmp_path / "missing.json"))
    assert [r["phrase"] for r in gone.orderBy("idx").collect()] == A.FALLBACK_PHRASES
    (tmp_path / "p.json").write_text('{"other": []}')
    none = A.phrase_table(spark, str(tmp_path / "p.json"))
    rows = A.augmented_rows(spark.createDataFrame([(7, "x y", "neutral")], "id long, text string, sentiment string"), "id", "text", "sentiment", none)
    assert {r["text"] for r in rows.collect()} == {"x y"}
