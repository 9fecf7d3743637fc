"""The crowded parts of the forest: blocks that meet, deeper regions, ids of any type."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcurate.llm import lsh_forest as L

from . import brute


def family(prose, n, edits, seed=0, words=150):
    """Texts of one base, each with its own edited words; the base itself is not among them."""
    base = prose(1000 + seed, words).split(" ")
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = list(base)
        for at in rng.choice(words, int(rng.integers(edits[0], edits[1] + 1)), replace=False):
            t[at] = f"own{seed}x{i}x{at}"
        out.append(" ".join(t))
    return out


def shared_passage(prose, n, common=110, own=60):
    """Dissimilar texts (about 0.5) with one passage in common."""
    passage = prose(77, common)
    return [f"{passage} {prose(5000 + i, own)}" for i in range(n)]


def components(found):
    return {r["doc_id"]: r["component_id"] for r in found.collect()}


@pytest.mark.parametrize(("crowd", "block"), [(L.CROWD, L.BLOCK), (L.CROWD, 7), (20, 16)])
def test_components_equal_all_pairs(make_docs, prose, crowd, block):
    """Variants without their origin, dissimilar texts that share a passage, copies; for
    blocks smaller than the regions, and with regions that grow deeper."""
    texts = family(prose, 70, (2, 5)) + family(prose, 40, (1, 6), seed=9) + shared_passage(prose, 60)
    rows = list(enumerate([*texts, texts[3], texts[80]]))
    got = components(L.near_duplicates(make_docs(rows), crowd=crowd, block=block))
    assert got == {i: c for i, (_, c) in brute.near_components(rows).items()}


def test_all_pairs_of_a_region_are_no_rows(make_docs, prose):
    """What meets in blocks grows with the members times the blocks, and links that come
    back are fewer than the members."""
    def made(n):
        docs = make_docs(list(enumerate(shared_passage(prose, n))))
        seen = {}
        real = L.rest_of_regions

        def spy(entries, *args):
            links = real(entries, *args)
            seen["links"], seen["entries"] = links.count(), entries.count()
            return links
        L.rest_of_regions = spy
        try:
            L.near_duplicates(docs).count()
        finally:
            L.rest_of_regions = real
        return seen
    assert made(150)["links"] == 0 and made(300)["links"] == 0


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, int(rng.integers(1, 700)))) for _ in range(23)]
    got = L.common_counts(sets[:9], sets[9:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[9:]] for a in sets[:9]]).all()
    assert (L.common_counts([np.array([1])], [np.array([2])]) == 0).all()


def test_joining_links_are_a_forest():
    """Everything similar: one link a component suffices."""
    sets = [np.arange(100)] * 12
    links = L.joining_links((list(range(6)), [0, 0, 1, 1, 2, 2], sets[:6]), (list(range(6, 12)), [2, 3, 3, 4, 4, 4], sets[6:]), 80)
    assert len(links) == 4


def test_ids_of_any_type(spark, prose):
    text = prose(3, 60)
    rows = [("b", text), ("a", text + " more"), ("c", prose(4, 60)), ("d", None), (None, text), ("c", text)]
    found = L.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"))
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"], r["first"]) for r in found.collect())
    # the second text of c is a node of its own, and joins a
    assert got == [("None", "None", True, True), ("a", "a", True, True), ("b", "a", False, False), ("c", "a", False, False),
                   ("c", "c", True, True), ("d", "d", True, True)]


def test_stage_columns_of_any_name(spark, make_docs, prose):
    from textcurate.llm import stages

    docs = make_docs([(1, prose(1, 80)), (2, prose(1, 80)), (2, prose(2, 80)), (3, None)])
    docs = docs.withColumns({"a.b": F.lit(1), "mix_weight": F.lit("x"), "mix_probability": F.lit("y")})
    kept = stages.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 3
    mixed = stages.mix_sources(spark, docs, "")
    assert mixed.columns == [c for c in docs.columns if not c.startswith("mix_")] + ["mix_weight", "mix_probability"]
    assert dict(mixed.dtypes)["mix_weight"] == "double"
