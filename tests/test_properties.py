"""Property tests: K-RANK equals a plain row_number on random inputs, and the
stratified split is disjoint, covering and within one of proportional."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from textcurate.operators import rank, splits

rows_strategy = st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None)
@given(rows_strategy)
def test_krank_random(spark, rows):
    data = [(i, g, k) for i, (g, k) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g int, k long")
    # a coarse monotone bucket with many ties and empty buckets
    ours = rank.row_number_exact(df, [F.col("k"), F.col("id")], F.floor(F.col("k") / 7), ["g"], "rn")
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    got = {r["id"]: r["rn"] for r in ours.collect()}
    exp = {r["id"]: r["rn2"] for r in ref.collect()}
    assert got == exp


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from(["negative", "neutral", "positive"]), min_size=2, max_size=120))
def test_stratified_split_contract(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "id long, sentiment string")
    sp = splits.stratified_split(df, "sentiment", "id").collect()
    assert sorted(r["id"] for r in sp) == list(range(len(labels)))
    n = len(labels)
    elig = {lab: labels.count(lab) for lab in set(labels) if labels.count(lab) >= 2}
    n_e = sum(elig.values())
    test_total = (15 * n_e + 99) // 100
    got_test = sum(1 for r in sp if r["split"] == "test")
    assert got_test == test_total
    for lab, c in elig.items():
        t = sum(1 for r in sp if r["split"] == "test" and r["sentiment"] == lab)
        assert abs(t - test_total * c / n_e) < 1 + 1e-9
    assert n >= 2
