"""Set similarity: the prefix-filtered search against all pairs, and its preprocessing."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textcurate.functions import text as T
from textcurate.operators import dedup, setjoin


def made(n, seed=1):
    """Sets of few and many grams, families of near copies, very frequent grams."""
    rng = random.Random(seed)
    sets = []
    for i in range(n):
        if sets and rng.random() < 0.5:
            base = set(rng.choice(sets[-40:]))
            for _ in range(rng.randint(0, 4)):
                base.discard(rng.choice(sorted(base))) if len(base) > 1 and rng.random() < 0.5 else base.add(f"g{rng.randrange(300)}")
        else:
            base = {f"g{int(300 * rng.random() ** 3)}" for _ in range(rng.randint(1, 25))}
        sets.append(sorted(base))
    return sets


def jac(a, b):
    a, b = set(a), set(b)
    return round(len(a & b) / len(a | b), 9)


@pytest.mark.parametrize(("threshold", "neighbours", "block"), [(0.3, 1, 5), (0.5, 8, 4096), (0.8, 1, 5), (1.0, 2, 50)])
def test_existence_equals_all_pairs(spark, threshold, neighbours, block):
    sets = made(220)
    scope = [i % 2 for i in range(len(sets))]
    df = spark.createDataFrame([(f"s{i}", i, scope[i], s) for i, s in enumerate(sets)], "sid string, pos long, sc int, grams array<string>")
    for cols in ([], ["sc"]):
        got = {r["pos"] for r in setjoin.earlier_overlap(df, threshold, cols, neighbours=neighbours, block=block).collect()}
        assert got == {j for j in range(len(sets)) if any(jac(sets[i], sets[j]) >= threshold and (not cols or scope[i] == scope[j]) for i in range(j))}


def test_threshold_met_by_rounding(spark):
    """1/3 rounds to the threshold 0.333333333 and 2/3 to 0.666666667, above it."""
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, ["y", "z"])], "sid string, pos long, grams array<string>")
    assert setjoin.earlier_overlap(df, 0.333333333).count() == 1
    assert setjoin.earlier_overlap(df, 0.333333334).count() == 0


def test_dense_groups_are_settled_by_their_neighbours(spark):
    """In a group of near copies the first pass decides all but the first member, so the
    second, which compares with all earlier entries, has one member left."""
    df = spark.range(400).select(F.format_string("s%d", "id").alias("sid"), F.col("id").alias("pos"),
                                 F.concat(F.array(*[F.lit(f"c{k}") for k in range(20)]), F.array(F.format_string("own%d", "id"))).alias("grams"))
    sets = setjoin.gram_sets(df, [])
    post = setjoin.prefix_postings(sets, 0.8, [])
    # the rarest gram is the own one; then all share the same prefix
    assert post.groupBy("sid").count().agg(F.max("count")).first()[0] == 5
    assert setjoin.earlier_overlap(df, 0.8).count() == 399
    plan = setjoin.earlier_overlap(df, 0.8)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_cosine_of_levels(spark):
    rng = random.Random(4)
    bags = [[f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 60))] for _ in range(30)]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bags)], "sid string, w array<string>")
    lv = setjoin.tf_levels(df, "w")
    a, b = [lv.select(*[F.col(c).alias(f"{c}{s}") for c in ("sid", "levels", "n2")]) for s in ("_a", "_b")]
    rows = a.join(b, F.col("sid_a") < F.col("sid_b")).select("sid_a", "sid_b", setjoin.level_cosine(
        F.col("levels_a"), F.col("n2_a"), F.col("levels_b"), F.col("n2_b")).alias("c")).collect()
    assert len(rows) > 400
    for r in rows:
        x, y = Counter(bags[int(r["sid_a"])]), Counter(bags[int(r["sid_b"])])
        assert r["c"] == round(sum(x[t] * y[t] for t in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())), 9)


def test_grams(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(setjoin.word_grams(F.col("w"))).collect()] == [["a b", "b a"], ["a"], []]
    df = spark.createDataFrame([("aaaab",), ("ab",), ("",)], "t string")
    assert [r[0] for r in df.select(setjoin.char_grams(F.col("t"))).collect()] == [["aaa", "aab"], ["ab"], []]


def test_similarity_words(spark):
    cases = {"It’s NOT working, won't start!": ["not", "working", "not", "start"], "I can't; they've gone": ["not", "gone"],
             "re-start (v2.0) #tag": ["re", "start", "v2", "0", "tag"], "the of and": [], "": [], None: None, "dogs' bowl 'quoted'": ["dogs", "bowl", "quoted"],
             "Größe naïve": ["größe", "naïve"], "he'd say y'all're late": ["say", "yall", "late"]}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.similarity_words("t").alias("w")).collect()
    assert {r["t"]: r["w"] for r in rows} == cases


def two_stage(spark, texts, **kw):
    rows = spark.createDataFrame([(i, i, t, "d") for i, t in enumerate(texts)], "id long, pos long, text string, domain string")
    return [r["dup_type"] for r in dedup.two_stage(dedup.prepare(rows), **kw).orderBy("pos").collect()]


def test_two_stage_verdicts(spark):
    """A contraction written out and stop words added are similar, another text is not."""
    texts = ["The laptop doesn't start when running multiple heavy apps at home", "the laptop doesn't start when running multiple heavy apps at home",
             "This laptop does not start while running multiple heavy apps, at my home!", "Screen looks bright and the battery lasts for two days",
             "of the and a an", "it is what it was"]
    assert two_stage(spark, texts) == [None, "exact", "similar", None, None, None]
    assert two_stage(spark, texts, chars=True) == [None, "exact", "similar", None, None, None]


def test_word_order_fails_the_first_stage(spark):
    """Cosine 1, but no bigram in common."""
    texts = ["alpha beta gamma delta epsilon", "epsilon delta gamma beta alpha"]
    assert two_stage(spark, texts) == [None, None]


def test_trigrams_of_texts_in_tasks(spark, monkeypatch):
    """Texts travel, not their grams: short and empty texts, letters beyond 16 bits, several pieces."""
    from textcurate.operators import blockjoin

    rng = random.Random(6)
    texts = ["", "a", "a", "ab", "ab", "abc", "\U00010400\U00010401", "\U00010400\U00010401", "aaaaaa", "aaa"]
    texts += [" ".join(rng.choice(["lorem", "ipsum", "dolor", "gr\u00fcn", "\U00010400x", "amet"]) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    sets = [{t[i:i + 3] for i in range(max(len(t) - 2, 1))} if t else set() for t in texts]
    want = {j for j, y in enumerate(sets) if y and any(x and jac(x, y) >= 0.5 for x in sets[:j])}
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    monkeypatch.setattr(blockjoin, "LEAST_BYTES", 100)
    for chars in (50, 1 << 20):
        monkeypatch.setattr(blockjoin, "GRAM_CHARS", chars)
        assert {r["pos"] for r in setjoin.trigrams_by_blocks(df, 0.5, 4000).collect()} == want
        n, codes = blockjoin._trigrams(__import__("pyarrow").array([*texts, None]))
        assert n.tolist() == [max(len(t) - 2, 1) if t else 0 for t in texts] + [0] and len(codes.dictionary) == len(set().union(*sets))
