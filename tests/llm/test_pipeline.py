"""Every stage of the pipeline against a plain Python version, on its own input."""

import math
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from textcurate.llm import mixing

from . import brute
from .conftest import SCHEMA, with_clashes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose, make_docs):
    base = str(tmp_path_factory.mktemp("pipeline"))
    item = prose(900, 30)
    rows = []
    for i in range(60):
        lang, source = ("en", "de", "fr")[i % 3], f"s{0 if i % 2 else i % 4}"
        lines = [prose(i, 70), prose(1000 + i, 60)]
        if i % 6 == 0:
            lines.append("The Same  banner line of every sixth document here")
        if i in (10, 40):
            lines.insert(1, item)
        rows.append((i, "\n".join(lines), lang, source))
    rows += [(100, rows[3][1], "en", "s1"), (101, rows[5][1].replace("w", "W"), "en", "s1"), (102, "too short", "en", "s1"), (103, None, "en", "s1"),
             (104, "", None, None), (None, prose(5000, 80), "en", "s1"), (106, rows[7][1].split("\n")[0] + " \n" + prose(5001, 55), "de", "s2")]
    # a near copy whose lines differ too much for line dedup: every line has its own edits
    w = rows[9][1].split(" ")
    for at in (20, 55, 100):
        w[at] = f"edit{at}"
    rows.append((107, " ".join(w).replace("\n", " "), "de", "s2"))
    with_clashes(make_docs(rows)).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "unseen words only"), (3, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows before and after every stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder).cache()
        out[name] = (docs.columns, docs.collect(), after.columns, after.collect())
        docs = after
    return out


def texts(rows):
    return sorted((str(r["doc_id"]), r["text"]) for r in rows)


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        before, _, after, rows = stages[name]
        assert before == after and set(SCHEMA.names) <= set(after)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert set(stages[names[-1]][0]) <= set(stages[names[-1]][2])


def test_quality_rules(stages):
    _, before, _, after = stages["quality_rules"]
    # no line is in more than 20 texts of a host here, so only the base rules reject
    want = sorted((str(r["doc_id"]), r["text"]) for r in before if not brute.quality_base(r["text"])["base_failed"])
    assert texts(after) == want and len(want) < len(before)


def test_line_dedup(stages):
    _, before, _, after = stages["line_dedup"]
    first = {}
    order = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"]))

    def normal(line):
        return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()))

    want = []
    for r in order:
        kept = []
        for pos, line in enumerate(r["text"].split("\n")):
            n = normal(line)
            if len(n.split(" ")) < 5 or first.setdefault(n, (r["doc_id"], pos)) == (r["doc_id"], pos):
                kept.append(line)
        if "\n".join(kept).strip():
            want.append((str(r["doc_id"]), "\n".join(kept)))
    assert texts(after) == sorted(want)
    gone = {str(r["doc_id"]) for r in before} - {i for i, _ in want}
    assert {"100", "101"} <= gone


def test_near_dedup(stages):
    _, before, _, after = stages["minhash_near_dedup"]
    truth = brute.near_components([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
    want = sorted(str(r["doc_id"]) for r in before if r["doc_id"] is None or truth[r["doc_id"]][1] == r["doc_id"])
    assert sorted(str(r["doc_id"]) for r in after) == want
    assert "107" not in want and "None" in want


def test_decontaminate(spark, folder, stages):
    _, before, _, after = stages["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute.contamination([(r["doc_id"], r["text"]) for r in before], items) if x[5]}
    assert bad and sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in before if r["doc_id"] not in bad)


def test_mix(spark, stages):
    import hashlib

    _, before, _, after = stages["source_mixing"]
    cells, rows = defaultdict(float), []
    frame = spark.createDataFrame([tuple(r[c] for c in SCHEMA.names) for r in before], SCHEMA)
    for r in mixing.measured(frame).collect():
        cell = (r["source"], r["lang"], r["topic"])
        cells[cell] += r["n_tokens"]
        rows.append((r["doc_id"], cell))
    total = sum(cells.values())
    fit = {c: t / total for c, t in cells.items()}
    targets = []
    for d, power in enumerate((0.5, 0.7, 0.7)):
        seen = defaultdict(float)
        for c, t in cells.items():
            seen[c[d]] += t
        s = sum(t ** power for t in seen.values())
        targets.append({v: t ** power / s for v, t in seen.items()})
    for _ in range(12):
        for d in range(3):
            now = defaultdict(float)
            for c, f in fit.items():
                now[c[d]] += f
            fit = {c: f * targets[d][c[d]] / now[c[d]] for c, f in fit.items()}
    want = {}
    for doc_id, c in rows:
        ratio = 0.5 * fit[c] / (cells[c] / total)
        u = int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:13], 16) / 2 ** 52
        if u < min(ratio, 1):
            want[str(doc_id)] = max(ratio, 1.0)
    got = {str(r["doc_id"]): r["mix_weight"] for r in after}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_run_equals_the_stages(spark, folder, stages):
    last = stages[corpus_pipeline.STAGES[-1][0]][3]
    assert texts(corpus_pipeline.run(spark, folder).collect()) == texts(last)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
