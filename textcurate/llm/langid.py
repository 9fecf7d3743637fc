"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

* Features. A text is lower-cased; every run of other characters than letters and marks
  becomes one space, and one space stands before and after the text. Its 1-, 2- and
  3-grams are hashed into a table of fixed size, one region per length. A feature is the
  share of the gram among all grams of the text (TF) times log((1 + N) / (1 + df)) + 1
  (IDF), with df and N over all learning documents, counted by Spark.
* Training. Follow-the-regularised-leader (proximal, step sizes per weight) with an
  elastic net: the first-order penalty makes weights exactly zero, the second-order one
  shrinks the rest. It runs in one task over a sample of distinct texts that ``sample``
  bounds: every language is expected to give ``sample`` / languages texts, those of the
  smallest hash. It depends on the texts and labels alone, not on the partitioning.
* Calibration. A fifth of the sample is kept from training; one temperature that divides
  all scores is fitted on it by likelihood.

Documents with crc32(doc_id as text) mod 4 = 2 are held out: nothing is learnt from them.
A prediction reads the text only, and the whole of it.

Cases: a null text or one without a letter is ``und`` with score 0, and so is every text if
there is nothing to learn from. A null lang teaches nothing. A null doc_id is not held out,
and teaches nothing, as its remainder is unknown. Equal scores go to the first language by
name. Repeated rows are predicted alike, and count once in the sample. A long text is
taken in pieces that lose no gram. An empty table gives an empty result. More languages
than ``max_languages`` are an error. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BITS = (12, 14, 16)  # of the table region of 1-, 2-, 3-grams
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in BITS])]).astype(np.int64)
SIZE = int(OFFSETS[-1])
MIX = np.uint64(0x9E3779B97F4A7C15)
GROUP_CHARS, GROUP_DOCS = 1 << 20, 96  # texts handled together; a longer text is alone
PIECE = 1 << 19  # grams looked up at a time
UNKNOWN = "und"

SAMPLE = 4000  # expected distinct texts to learn from, all languages together
EPOCHS = 3
SCALE = 30.0  # brings shares of a text to the size of words' TF-IDF
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.0005

_KINDS: np.ndarray | None = None


def char_kinds() -> np.ndarray:
    """Of every code point: 1 a letter, 2 a mark, 0 anything else."""
    global _KINDS
    if _KINDS is None:
        first = (unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1))
        _KINDS = np.fromiter(({"L": 1, "M": 2}.get(c, 0) for c in first), np.uint8, sys.maxunicode + 1)
    return _KINDS


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, bounds per text, whether it has a letter) of the normalised texts."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in padded])]).astype(np.int64)
    kinds = char_kinds()[codes]
    is_word = kinds > 0
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]  # one space after every run of letters
    keep[bounds[:-1]] = True
    letters = np.concatenate([[0], np.cumsum(kinds == 1)])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return np.where(is_word, codes, np.uint32(32))[keep], kept[bounds], np.diff(letters[bounds]) > 0


def grams(codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every gram, texts ascending, some at a time."""
    n = len(codes)
    for order, (bits, offset) in enumerate(zip(BITS, OFFSETS, strict=False), 1):
        for at in range(0, n - order + 1, PIECE):
            end = min(at + PIECE, n - order + 1)
            h = codes[at:end].astype(np.uint64)
            for k in range(1, order):
                h = (h ^ (h >> np.uint64(29))) * MIX + codes[at + k:end + k]
            h *= MIX
            doc = np.searchsorted(bounds, np.arange(at, end), "right") - 1
            inside = np.arange(at, end) + order <= bounds[doc + 1]
            yield doc[inside], ((h >> np.uint64(64 - bits)).astype(np.int64) + offset)[inside]


def grouped(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, some texts); null counts as empty."""
    at, group, chars = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if group and (len(group) == GROUP_DOCS or chars + len(t) > GROUP_CHARS):
            yield at, group
            at, group, chars = i, [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield at, group


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


# ---- document frequencies ---------------------------------------------------

def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that occurs in the task's texts."""
    df = np.zeros(SIZE, np.int64)
    for batch in batches:
        for _, texts in grouped(batch.column(0).to_pylist()):
            codes, bounds, _ = normalised(texts)
            seen = np.zeros((len(texts), SIZE), np.uint8)
            for doc, bucket in grams(codes, bounds):
                seen[doc, bucket] = 1
            df += np.add.reduce(seen, axis=0, dtype=np.uint8)  # at most GROUP_DOCS
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used])], ["bucket", "df"])


def inverse_frequencies(learn: DataFrame, n_docs: int) -> np.ndarray:
    """IDF of every bucket, from all learning documents."""
    found = learn.select("text").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(SIZE)  # at most SIZE rows
    df[found["bucket"].to_numpy(np.int64)] = found["df"].to_numpy(np.float64)
    return np.log((1.0 + n_docs) / (1.0 + df)) + 1.0


# ---- training ---------------------------------------------------------------

def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, ascending, and their TF-IDF values."""
    codes, bounds, _ = normalised([text])
    count = np.zeros(SIZE, np.int64)
    for _, bucket in grams(codes, bounds):
        count += np.bincount(bucket, minlength=SIZE)
    at = np.flatnonzero(count)
    return at.astype(np.int32), SCALE * count[at] / count.sum() * idf[at]


class Ftrl:
    """Proximal follow-the-regularised-leader for softmax regression. The last feature
    is the intercept and carries no penalty."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((n_features + 1, n_classes))
        self.n = np.zeros((n_features + 1, n_classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.arange(len(self.z))[at] == len(self.z) - 1
        l1, l2 = np.where(free, 0.0, self.l1)[:, None], np.where(free, 0.0, self.l2)[:, None]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + l2)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its
    logarithm; 1 without rows or with one class. As in Platt's method a row counts as
    1 / (n + 2) of the other classes, so that rows without an error do not ask for 0."""
    rows, classes = scores.shape
    if not rows or classes < 2:
        return 1.0
    target = np.full(scores.shape, 1.0 / (rows + 2) / (classes - 1))
    target[np.arange(rows), labels] = 1.0 - 1.0 / (rows + 2)

    def loss(log_t: float) -> float:
        return -(target * np.log(np.maximum(softmax(scores / np.exp(log_t)), 1e-300))).sum()

    low, high = np.log(0.05), np.log(20.0)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _fit(batches: Iterator[pa.RecordBatch], idf: np.ndarray, languages: list[str], epochs: int) -> Iterator[pa.RecordBatch]:
    """The sample in, one row per feature with a weight out; feature -1 holds the temperature."""
    rows = []
    for batch in batches:
        rows += [(key, languages.index(lang), *features(text, idf))
                 for key, lang, text in zip(*(batch.column(c).to_pylist() for c in ("key", "lang", "text")), strict=True)]
    rows.sort(key=lambda r: r[:2])
    # keys are hashes, so every fifth row is any row; few rows are all learnt from
    every = 5 if len(rows) >= 20 * len(languages) else len(rows) + 1
    checks = [r for i, r in enumerate(rows, 1) if i % every == 0]
    learns = [r for i, r in enumerate(rows, 1) if i % every]
    model = Ftrl(SIZE, len(languages))
    for e in range(epochs):
        for i in np.random.default_rng(e).permutation(len(learns)):
            _, label, at, x = learns[i]
            model.step(at, x, label)
    w = model.weights(np.arange(SIZE + 1))
    scores = np.array([x @ w[at] + w[SIZE] for _, _, at, x in checks]).reshape(-1, len(languages))
    t = fit_temperature(scores, np.array([r[1] for r in checks], np.int64))
    used = np.flatnonzero(w.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, used).astype(np.int32)),
                                      pa.array([[t] * len(languages), *w[used].tolist()], pa.list_(pa.float64()))], ["feature", "w"])


@dataclass
class Model:
    """Languages by name, score per gram (``SIZE`` rows), intercept, temperature."""

    languages: list[str]
    table: np.ndarray
    intercept: np.ndarray
    temperature: float


def train(docs: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, max_languages: int = 200) -> Model:
    """Learns from the documents that are not held out and have text and lang."""
    learn = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    idf = inverse_frequencies(learn, sum(counts.values()))
    share = {x: min(1.0, sample / len(languages) / n) for x, n in counts.items()}
    limits = F.create_map(*[F.lit(v) for x in languages for v in (x, share[x])])
    key = F.xxhash64("text")
    chosen = learn.select("lang", "text", key.alias("key")).filter(
        F.shiftrightunsigned(F.col("key"), 11) / F.lit(float(1 << 53)) < F.element_at(limits, F.col("lang"))).dropDuplicates(["lang", "key"])
    found = written(chosen.repartition(1).mapInArrow(partial(_fit, idf=idf, languages=languages, epochs=epochs),
                                                     "feature int, w array<double>"), "language-weights")
    w, t = np.zeros((SIZE + 1, len(languages))), 1.0
    for r in found.collect():  # at most SIZE + 2 rows
        if r["feature"] < 0:
            t = r["w"][0]
        else:
            w[r["feature"]] = r["w"]
    return Model(languages, (SCALE * idf[:, None] * w[:SIZE]).astype(np.float32), w[SIZE], t)


# ---- prediction -------------------------------------------------------------

def scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(scores per language before calibration, whether there is a letter)."""
    codes, bounds, has_letter = normalised(texts)
    total, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for doc, bucket in grams(codes, bounds):
        if len(doc):
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            total[doc[starts]] += np.add.reduceat(model.table[bucket], starts, axis=0, dtype=np.float64)
            count += np.bincount(doc, minlength=len(texts))
    return total / np.maximum(count, 1)[:, None] + model.intercept, has_letter


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in grouped(batch.column(1).to_pylist()):
            names, best = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if model.languages:
                s, has_letter = scores(texts, model)
                p = softmax(s / model.temperature)
                first = p.argmax(axis=1)
                names[has_letter] = np.array(model.languages, object)[first[has_letter]]
                best = np.where(has_letter, p[np.arange(len(p)), first], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(names, pa.string()), pa.array(best.round(9))],
                                             ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (calibrated probability) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_predicted, model=model), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
