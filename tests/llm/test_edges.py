"""Odd rows through operators 6, 7, 8, 11 and the stages: very long texts, repeated rows,
null ids, columns whose names the operators use themselves."""

import math

import pytest

import corpus_pipeline
from textcurate.llm import langid, lbl, licenses, mixing
from textcurate.llm.common import written

from .conftest import with_clashes

SF = "/root/testdata/sf0.001"
NOTICE = "Released under the MIT License."


@pytest.fixture(scope="module")
def odd(make_docs, prose):
    long = f"{prose(1, 40_000)}\n{NOTICE}\n{prose(2, 40_000)}"
    rows = [(1, long, "en", "s0"), (2, prose(3, 90), "en", "s0"), (2, prose(3, 90), "en", "s0"), (2, prose(4, 90), "de", None),
            (None, prose(5, 120), "en", "s1"), (None, prose(5, 120), "en", "s1"), (5, None, None, None), (5, None, None, None), (6, "", "fr", "s1"),
            (7, " \n\t\n ", "fr", "s1"), (8, "x" * 200_000, "en", "s2"), *[(20 + i, prose(20 + i, 70), "en", f"s{i % 3}") for i in range(12)]]
    return with_clashes(make_docs(rows)), rows


def alike(found, *fields):
    """Rows of one id with equal texts have equal results; here: id 5 and the null id."""
    for key in (5, None):
        values = {tuple(r[f] for f in fields) for r in found if r["doc_id"] == key}
        assert len(values) == 1


def test_mixing(odd):
    docs, rows = odd
    found = mixing.mix_to_targets(mixing.measured(docs)).collect()
    assert len(found) == len(rows) and all(r["ratio"] > 0 and 0 < r["probability"] <= 1 for r in found)
    alike(found, "ratio", "probability", "kept", "n_tokens")
    assert {r["n_tokens"] for r in found if r["doc_id"] == 1} == {80_005}
    assert {r["n_tokens"] for r in found if r["doc_id"] in (5, 6, 7)} == {0}


def test_licenses(odd):
    docs, rows = odd
    found = licenses.scan_licenses(docs).collect()
    assert len(found) == len(rows)
    alike(found, "license", "n_units", "licenses")
    assert {r["doc_id"]: r["license"] for r in found if r["license"]} == {1: "MIT"}


def test_language_model(odd):
    docs, rows = odd
    found = lbl.score_corpus(docs).collect()
    assert len(found) == len(rows) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    alike(found, "score", "base_score", "n_tokens")
    assert {r["n_tokens"] for r in found if r["doc_id"] == 1} == {80_006}


def test_language(odd):
    docs, rows = odd
    found = langid.identify(docs, langid.train(docs)).collect()
    assert len(found) == len(rows)
    alike(found, "lang_pred", "score", "held_out")
    assert {r["lang_pred"] for r in found if r["doc_id"] in (5, 6, 7)} == {"und"}


def test_stages(spark, odd):
    """Every stage takes what the one before it kept; extra columns stay as they were."""
    docs, rows = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, docs, SF), name)
        assert kept.columns == docs.columns and {r[0] for r in kept.select("removed").collect()} <= {"x"}
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(docs.columns) < set(last.columns)
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert 1 in ids and ids.count(2) >= 1 and ids.count(5) == 0
