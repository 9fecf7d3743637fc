"""Duplicate verdicts (golden rows) and K-SIM against brute force."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from textcurate.functions import text as T
from textcurate.operators import dedup, simjoin
from textcurate.sources.tables import reviews


def _reviews(spark, texts, domain="d"):
    rows = [(i, i, t, domain, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, pos long, text string, domain string, sentiment string")


def _verdicts(spark, texts, **kw):
    v = dedup.verdicts(_reviews(spark, texts), **kw)
    return [r["dup_type"] for r in v.orderBy("pos").collect()]


def test_exact_with_case_folding(spark):
    assert _verdicts(spark, ["A b c d e", "a  B c d e", "x y z w v"]) == [None, "exact", None]


def test_removed_neighbours_still_count(spark):
    base = "a b c d e f g h i j"
    texts = [base, base + " k", base + " k l"]
    assert _verdicts(spark, texts) == [None, "similar", "similar"]


def test_word_order_is_similar_not_exact(spark):
    assert _verdicts(spark, ["one two three four five", "five four three two one"]) == [None, "similar"]


def test_windowed_scope_boundary(spark):
    """Equal texts at filtered positions 100 and 101 (1-based) fall in different
    100-row chunks: not duplicates in windowed scope, duplicates globally."""
    filler = [f"w{i} x{i} y{i} z{i} q{i}" for i in range(99)]
    texts = filler + ["same text here for sure", "same text here for sure"]
    assert _verdicts(spark, texts)[100] == "exact"
    assert _verdicts(spark, texts, scope="windowed")[100] is None
    # both inside one chunk: duplicates in either scope
    texts2 = filler + ["pad a b c d"] + ["same text here for sure", "same text here for sure"]
    assert _verdicts(spark, texts2, scope="windowed")[101] == "exact"


def test_length_filtered_rows_have_no_verdict(spark):
    assert _verdicts(spark, ["too short", "too short"]) == [None, None]


def _bow(key):
    return Counter(key.split())


def _cos(a, b):
    dot = sum(a[t] * b[t] for t in a if t in b)
    return round(dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 9)


@pytest.mark.parametrize("threshold", [0.92, 0.6])
def test_ksim_equals_brute_force(spark, threshold):
    docs = reviews(spark, SF001).select("id", T.dup_key(T.clean_strict("text")).alias("k")) \
        .where(F.size(T.words("k")) > 0)
    rows = docs.collect()
    vecs = {}
    for r in rows:
        toks = sorted(r["k"].split())
        vecs[" ".join(toks)] = _bow(r["k"])
    keys = sorted(vecs)
    brute = {(a, b) for a, b in itertools.combinations(keys, 2) if _cos(vecs[a], vecs[b]) >= threshold}
    v = simjoin.vector_columns(docs, T.words("k"))
    nodes = v.groupBy("vid").agg(F.first("canon").alias("canon")) \
             .withColumn("c", F.array_join("canon", " "))
    got = simjoin.similar_pairs(nodes, ["c"], threshold, condition=F.col("c_a") < F.col("c_b"))
    ours = {(r["c_a"], r["c_b"]) for r in got.collect()}
    assert ours == brute
    assert len(brute) > 0


def test_copies_collapse_to_one_node(spark):
    texts = ["the same review text again"] * 50 + ["another different review text here"]
    v = dedup.verdicts(_reviews(spark, texts))
    counts = {r["dup_type"]: r["n"] for r in v.groupBy("dup_type").agg(F.count("*").alias("n")).collect()}
    assert counts == {None: 2, "exact": 49}


def test_domain_thresholds(spark):
    thr = dedup.domain_threshold(F.col("d"))
    df = spark.createDataFrame([("general",), ("technology",), ("service",), ("other",)], "d string")
    assert [r[0] for r in df.select(thr).collect()] == [0.92, 0.828, 1.012, 0.92]


def test_dense_near_copy_cluster(spark):
    """Many distinct near-copies sharing every prefix token: all but the first
    are similar, found without listing all pairs of the cluster."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [f"{base} extra{i}" for i in range(300)]
    got = _verdicts(spark, texts)
    assert got[0] is None and all(g == "similar" for g in got[1:])


def test_existence_search_matches_pairs(spark):
    docs = reviews(spark, SF001)
    v = dedup.verdicts(docs)
    kept = v.where("keep_len")
    nodes = dedup.near_nodes(kept, [])
    found = {r["first_pos"] for r in simjoin.earlier_similar(nodes, [], 0.92).collect()}
    pairs = simjoin.similar_pairs(nodes, ["first_pos"], 0.92,
                                  condition=F.col("first_pos_a") < F.col("first_pos_b"))
    assert found == {r["first_pos_b"] for r in pairs.collect()}


def test_cross_split_members_and_links(spark):
    """A dense group of copies is members, not pairs; both expand to all row pairs."""
    from textcurate.operators import leakage

    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base, ("train", "test", "validation")[i % 3]) for i in range(90)]
    rows += [(100 + i, f"{base} one{i}", "train") for i in range(5)] + [(200, "", "train"), (201, "", "test"), (202, "alone here", "test")]
    df = spark.createDataFrame(rows, "id long, clean_text string, split string")
    links, members = leakage.cross_split_links(df)
    found = {(r["id_a"], r["id_b"]) for r in leakage.row_pairs(links, members).collect()}
    order = ["train", "validation", "test"]

    def cos(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum(a[t] * b[t] for t in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()) or 1)
    brute = {(x[0], y[0]) for x in rows for y in rows if order.index(x[2]) < order.index(y[2]) and round(cos(x[1], y[1]), 9) > 0.98}
    assert found == brute and len(brute) > 2000
    # train-only texts link with the base, not with each other
    assert links.count() == 1 + 5 and members.count() == 95
    reps = leakage.representative_pairs(links, members)
    assert reps.agg(F.sum("n_pairs")).first()[0] == len(brute)
    (r,) = leakage.with_texts(reps.where("id_a = 100"), df, "clean_text").where("pair = 'train-test'").collect()
    assert (r["id_b"], r["text_a"], r["text_b"], r["n_pairs"]) == (1, f"{base} one0", base, 30)


def test_signatures_settle_pairs_that_share_rare_tokens_only(spark):
    """Bags of 12 of 60 words share words of their prefixes, yet are far apart: their signatures
    tell, so few of them are joined with their vectors. No similar pair is lost."""
    rng = random.Random(3)
    bags = [sorted(rng.sample([f"w{k}" for k in range(60)], 12)) for _ in range(200)]
    bags += [sorted([*b[1:], b[1]]) for b in bags[:20]]
    nodes = spark.createDataFrame([(f"v{i}", b) for i, b in enumerate(bags)], "vid string, canon array<string>")
    tf = {(r["vid"], r["word"]): r["tf"] for r in simjoin.term_frequencies(nodes).collect()}
    assert tf == {(f"v{i}", w): n for i, b in enumerate(bags) for w, n in Counter(b).items()}
    post = simjoin._prefix_postings(nodes, simjoin.vector_table(nodes, 0.8), [])
    side = lambda s: post.select("token", *[F.col(c).alias(f"{s}{c}") for c in ["vid", *simjoin.BOUNDS]])
    meet = side("a_").join(side("b_"), "token").where("a_vid < b_vid")
    found = {(r[0], r[1]) for r in meet.where(simjoin._bounded("a_", "b_", 0.8)).select("a_vid", "b_vid").distinct().collect()}
    true = {(a, b) for (a, x), (b, y) in itertools.permutations([(f"v{i}", Counter(b)) for i, b in enumerate(bags)], 2) if a < b and _cos(x, y) >= 0.8}
    assert true and true <= found
    assert len(found) < 0.05 * meet.select("a_vid", "b_vid").distinct().count()
