"""Language identification: parts against plain Python, accuracy on held-out documents, edge cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcurate.llm import langid

from .conftest import SCHEMA, with_clashes

SYLLABLES = {"xx": "ka lo mi ren tu sha vo".split(), "yy": "éa ou qui ble tion eau rre".split(), "zz": "ñor cha do ción sta ll ue".split()}


def made(seed, lang, n=40):
    rng = random.Random(f"{seed}{lang}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def made_rows(n=240):
    return [(i, made(i, lang), lang, f"s{i % 3}") for i, lang in zip(range(n), list(SYLLABLES) * n, strict=False)]


def plain_normal(text):
    out = [" "]
    for c in (text or "").lower():
        k = {1: c, 2: c, 0: " "}[int(langid.char_kinds()[ord(c)])]
        if k != " " or out[-1] != " ":
            out.append(k)
    if out[-1] != " ":
        out.append(" ")
    return "".join(out)


def plain_bucket(gram):
    m, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15
    h = ord(gram[0])
    for c in gram[1:]:
        h = ((h ^ (h >> 29)) * mix + ord(c)) & m
    bits = langid.BITS[len(gram) - 1]
    return int(langid.OFFSETS[len(gram) - 1]) + ((h * mix & m) >> (64 - bits))


def plain_counts(text):
    s, out = plain_normal(text), {}
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            b = plain_bucket(s[i:i + n])
            out[b] = out.get(b, 0) + 1
    return out


TEXTS = ["Éléphants, 12 ñandúes!", "", " ", "a", "ab", "İstanbul ﬁ ǅ", "x\x00y\nz", "1234 --", "नमस्ते दुनिया", "日本 語", "été", "A" * 500, "!a!", "\U0001F600 q"]


@pytest.mark.parametrize("piece", [3, 1 << 19])
def test_features(monkeypatch, piece):
    """Grams of several texts at once, in pieces or not, as a plain loop finds them."""
    monkeypatch.setattr(langid, "PIECE", piece)
    codes, bounds, has_letter = langid.normalised(TEXTS)
    found = [{} for _ in TEXTS]
    for doc, bucket in langid.grams(codes, bounds):
        for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
            found[d][b] = found[d].get(b, 0) + 1
    assert found == [plain_counts(t) for t in TEXTS]
    assert has_letter.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]
    idf = np.linspace(1, 3, langid.SIZE)
    for t in TEXTS:
        at, x = langid.features(t, idf)
        n = plain_counts(t)
        assert at.tolist() == sorted(n) and np.allclose(x, [langid.SCALE * n[b] / sum(n.values()) * idf[b] for b in sorted(n)])


def test_document_frequencies(make_docs):
    """Counted over all learning documents, repeated ones included."""
    rows = [(i, t, "en") for i, t in enumerate(TEXTS * 9)]
    docs = make_docs(rows, 5)
    expect = np.zeros(langid.SIZE)
    for _, t, _ in rows:
        expect[list(plain_counts(t))] += 1
    got = langid.inverse_frequencies(docs, len(rows))
    assert np.allclose(got, np.log((1 + len(rows)) / (1 + expect)) + 1)


def test_leader_steps():
    """Steps equal a loop over single weights."""
    rng = random.Random(3)
    model = langid.Ftrl(12, 3, alpha=0.3, beta=0.7, l1=0.05, l2=0.01)
    z, n = {}, {}

    def weight(f, c):
        a, l1, l2 = z.get((f, c), 0.0), 0.0 if f == 12 else 0.05, 0.0 if f == 12 else 0.01
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((0.7 + math.sqrt(n.get((f, c), 0.0))) / 0.3 + l2)

    for _ in range(60):
        x = {f: rng.random() for f in rng.sample(range(12), 5)}
        y = rng.randrange(3)
        model.step(np.array(sorted(x)), np.array([x[f] for f in sorted(x)]), y)
        row = x | {12: 1.0}
        s = [sum(v * weight(f, c) for f, v in row.items()) for c in range(3)]
        e = [math.exp(v - max(s)) for v in s]
        step = {(f, c): v * (e[c] / sum(e) - (c == y)) for f, v in row.items() for c in range(3)}
        w = {k: weight(*k) for k in step}
        for k, g in step.items():
            z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / 0.3 * w[k]
            n[k] = n.get(k, 0.0) + g * g
    expect = np.array([[weight(f, c) for c in range(3)] for f in range(13)])
    assert np.allclose(model.weights(np.arange(13)), expect)


def test_penalty_makes_weights_zero():
    rng = np.random.default_rng(1)

    def zeros(l1):
        m = langid.Ftrl(200, 2, l1=l1)
        for i in range(300):
            m.step(np.arange(200), np.append(rng.normal(0, 0.05, 198), [i % 2, 1 - i % 2]), i % 2)
        return int((m.weights(np.arange(200)) == 0).sum())
    assert zeros(0.0) < zeros(0.5) and zeros(0.5) > 200


def test_temperature():
    rng = np.random.default_rng(2)
    s = rng.normal(0, 1, (4000, 4))
    y = np.array([rng.choice(4, p=p) for p in langid.softmax(s)])
    assert abs(langid.fit_temperature(3 * s, y) - 3) < 0.3
    assert langid.fit_temperature(np.zeros((0, 4)), y[:0]) == 1.0
    assert langid.fit_temperature(np.ones((5, 1)), np.zeros(5, int)) == 1.0


def predictions(docs, model):
    return {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}


def test_learns_and_predicts(make_docs):
    """Every held-out text is right; null, empty and letterless ones are unknown."""
    rows = [*made_rows(), (1000, None, "xx"), (1001, "", "xx"), (1002, "12 3!", "yy"), (1003, made(9, "zz", 60_000), None), (1004, made(5, "yy"), None)]
    docs = with_clashes(make_docs(rows))
    got = predictions(docs, langid.train(docs))
    assert len(got) == len(rows)
    for i, text, lang, *_ in rows:
        held, pred, score = got[i]
        assert held == (zlib.crc32(str(i).encode()) % 4 == 2)
        if i < 1000:
            assert pred == lang and 0.5 < score <= 1
    assert [got[i][1:] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert (got[1003][1], got[1004][1]) == ("zz", "yy")


def test_scores_equal_a_plain_sum(make_docs):
    """Calibrated probabilities of a loop over grams, very long text included."""
    rows = [*made_rows(90), (500, made(7, "xx", 40_000), "xx"), (501, "q ñ", "yy"), (502, TEXTS[8], None)]
    docs = make_docs(rows)
    model = langid.train(docs)
    got = predictions(docs, model)
    for i, text, *_ in rows:
        n = plain_counts(text)
        s = [sum(c * float(model.table[b, k]) for b, c in n.items()) / sum(n.values()) + model.intercept[k] for k in range(3)]
        p = langid.softmax(np.array(s) / model.temperature)
        assert got[i][1] == model.languages[int(p.argmax())] and abs(got[i][2] - p.max()) < 1e-6


def test_held_out_and_other_columns_teach_nothing(make_docs):
    """Texts, languages, sources of held-out rows change nothing; nor does the partitioning, or a null id."""
    rows = made_rows()
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    other = [(i, t, "zz" if h else lang, "elsewhere") for (i, t, lang, _), h in zip(rows, held, strict=True)] + [(None, made(3, "xx"), "zz"), (77_000, made(4, "yy"), None)]
    base = make_docs(rows, 1)
    a, b = langid.train(base), langid.train(make_docs(other, 7))
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.temperature == b.temperature
    assert predictions(base, a) == predictions(base.withColumn("lang", F.lit("zz")).repartition(9), a)


def test_sample_is_bounded(make_docs):
    """A small sample still predicts; copies of one text count once in it."""
    rows = made_rows(300) + [(10_000 + i, made(1, "yy"), "yy") for i in range(150)]
    docs = make_docs(rows)
    got = predictions(docs, langid.train(docs, sample=60))
    assert sum(got[i][1] == lang for i, _, lang, _ in rows[:300]) > 290


def test_degenerate_tables(spark, make_docs):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, langid.train(empty)).count() == 0
    nothing = make_docs([(1, "some words", None), (3, None, "en")])
    assert set(predictions(nothing, langid.train(nothing)).values()) == {(False, "und", 0.0)}
    one = make_docs([(1, "some words", "en"), (3, "words", "en"), (3, "words", "en"), (None, "other", None)])
    assert {r["lang_pred"] for r in langid.identify(one, langid.train(one)).collect()} == {"en"}
    with pytest.raises(ValueError, match="languages"):
        langid.train(make_docs([(i, "word", f"l{i}") for i in range(9)]), max_languages=3)


def test_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
