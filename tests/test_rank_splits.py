"""K-RANK equals row_number; split quotas and invariants (FIXTURES.md)."""

from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from textcurate.operators import rank, splits


def test_krank_equals_row_number(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey", "o_orderstatus")
    staged = o.withColumn("h", splits.shuffle_key("o_orderkey"))
    ours = rank.row_number_exact(staged, [F.col("h"), F.col("o_orderkey")], rank.hex_bucket(F.col("h")),
                                 ["o_orderstatus"], "rn")
    ref = staged.withColumn("rn2", F.row_number().over(
        Window.partitionBy("o_orderstatus").orderBy("h", "o_orderkey")))
    bad = ours.join(ref, ["o_orderkey"]).where(F.col("rn") != F.col("rn2")).count()
    assert bad == 0 and ours.count() == o.count()


def test_range_bucket_rank(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey")
    ours = splits.renumber(o.withColumnRenamed("o_orderkey", "pos"), "pos")
    ref = o.withColumn("r", F.row_number().over(Window.orderBy("o_orderkey")))
    j = ours.join(ref, ours.pos == ref.o_orderkey)
    assert j.where(F.col("new_id") != F.col("r")).count() == 0


def _labelled(spark, counts):
    rows, i = [], 0
    for lab, n in counts.items():
        for _ in range(n):
            rows.append((i, lab))
            i += 1
    return spark.createDataFrame(rows, "id long, sentiment string")


def test_stratified_quota_golden(spark):
    df = _labelled(spark, {"negative": 51, "neutral": 49, "positive": 299})
    q = {r["sentiment"]: (r["t_c"], r["v_c"]) for r in splits.stratified_quotas(df, "sentiment").collect()}
    assert q == {"negative": (8, 8), "neutral": (7, 7), "positive": (45, 45)}
    sp = splits.stratified_split(df, "sentiment", "id")
    got = {(r["sentiment"], r["split"]): r["n"] for r in
           sp.groupBy("sentiment", "split").agg(F.count("*").alias("n")).collect()}
    assert got[("negative", "train")] == 35 and got[("neutral", "train")] == 35
    assert got[("positive", "train")] == 209
    # disjoint, covering, repeatable
    assert sp.count() == 399 and sp.select("id").distinct().count() == 399
    again = splits.stratified_split(df, "sentiment", "id")
    assert sp.exceptAll(again).count() == 0


def test_single_member_class_goes_to_train(spark):
    df = _labelled(spark, {"negative": 1, "positive": 20})
    sp = {r["id"]: r["split"] for r in splits.stratified_split(df, "sentiment", "id").collect()}
    assert sp[0] == "train"


def test_sequential_and_partition_sizes(spark):
    df = spark.range(101).withColumnRenamed("id", "id")
    sizes = {r["split"]: r["n"] for r in splits.sequential_split(df, "id").groupBy("split")
             .agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 80, "validation": 10, "test": 11}
    lab = df.withColumn("sentiment", F.lit("positive"))
    p = splits.partition_labeled(lab, "id", "sentiment")
    assert p.where("is_labeled").count() == 70 and p.where("sentiment is null").count() == 31


def test_two_way_has_no_validation(spark):
    df = _labelled(spark, {"negative": 51, "neutral": 49, "positive": 299})
    sp = splits.stratified_split(df, "sentiment", "id", validation=Fraction(0))
    assert sp.where("split = 'validation'").count() == 0
    assert sp.where("split = 'test'").count() == 60


@pytest.mark.parametrize("parts", [1, 16])
def test_partition_count_independence(spark, parts):
    df = _labelled(spark, {"negative": 51, "neutral": 49, "positive": 299})
    base = splits.stratified_split(df, "sentiment", "id").collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        other = splits.stratified_split(df, "sentiment", "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, base)) == sorted(map(tuple, other))
