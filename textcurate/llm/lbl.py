"""Language-model scoring with a log-bilinear model trained by noise-contrastive
estimation.

Symbols: the most frequent training words (``SYMBOLS`` of them), one symbol for the
end of a text, and ``GROUPS`` groups that hold all other words by their last two
bytes. The model predicts the next symbol from the two before it: each context
symbol's vector passes its own matrix, their sum q gives the score q . r + b of a
symbol. Inside a group a word has its smoothed share of the group's training
count, with half a count for unseen words, so probabilities sum to 1 over all words.

Training covers every training document. Each task runs mini-batch NCE in numpy
(noise drawn from the training unigrams, shared by a batch) from the common start,
and the parameters are averaged by token count in a Spark aggregation, round by
round. Then the normaliser of each of the S**2 contexts is computed by batched
matrix products (one task per slice of contexts), and scoring a token is a look-up of
normalised log-probabilities: score less normaliser.

Counts of words are exact over all training documents: tasks emit combined
(word hash, count) rows and Spark sums them. The ``frequent`` most frequent words
are broadcast (a fixed bound); every other token is joined with its count through
a shuffle. Words are 64-bit hashes.

Held out: documents whose crc32(doc_id as text) mod 5 is 1.

Defined cases: null and empty texts are one end token; a null doc_id is not held out;
repeated rows count as often as they occur and get equal scores; without training
tokens all counts are 0 and the model is uniform; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import text_key, whole_text, written

SYMBOLS, GROUPS, DIM, FREQUENT = 900, 100, 24, 100_000
END_HASH = np.int64(0x0E0D0E0D0E0D0E0D)
BATCH, NOISE = 8192, 48


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def group_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, groups: int) -> np.ndarray:
    """Group of a word by its last two bytes."""
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)].astype(np.int64), 0)
    return (before * 31 + last) % groups


@dataclass
class Tokens:
    """Tokens of a slice, each document's words and then its end."""

    hashes: np.ndarray  # int64
    group: np.ndarray  # -1 for the end
    counts: np.ndarray  # tokens per document, 1 or more


def tokens(s: W.Slice, groups: int) -> Tokens:
    low = W.LOWER[s.data]
    starts, ends, n_words = W.word_bounds(low, s.bounds, W.SPACES)
    h = W.range_hash(W.prefix_sums(low), starts, ends).view(np.int64)
    counts = n_words + 1
    total = int(counts.sum())
    is_end = np.zeros(total, bool)
    is_end[np.cumsum(counts) - 1] = True
    hashes, group = np.full(total, END_HASH), np.full(total, -1, np.int64)
    hashes[~is_end] = h
    if len(starts):
        group[~is_end] = group_of(low, starts, ends, groups)
    return Tokens(hashes, group, counts)


# ---- counts -----------------------------------------------------------------

def _count_batches(batches: Iterator[pa.RecordBatch], groups: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def combined():
        h, g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, g, n = h[order], g[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        return (h[first], g[first], np.add.reduceat(n, first)) if len(h) else (h, g, n)

    def batch_of(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2])], ["word", "grp", "n"])

    for batch in batches:
        for s in W.slices(batch.column(0), 1 << 22):
            t = tokens(s, groups)
            parts.append((t.hashes, t.group, np.ones(len(t.hashes), np.int64)))
            held += len(t.hashes)
            if held > most:
                parts = [combined()]
                held = len(parts[0][0])
                if held > most // 2:  # combined rows leave, so memory is bounded
                    yield batch_of(parts[0])
                    parts, held = [], 0
    if parts:
        yield batch_of(combined())


def word_counts(docs: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(word, grp, c) over the documents that are not held out, ends included."""
    train = docs.filter(~held_out(F.col("doc_id"))).select(whole_text().alias("text"))
    return train.mapInArrow(partial(_count_batches, groups=groups), "word long, grp long, n long").groupBy("word").agg(
        F.first("grp").alias("grp"), F.sum("n").alias("c"))


# ---- model ------------------------------------------------------------------

@dataclass
class Vocabulary:
    """Symbols: 0 .. n-1 words by hash, then groups, then the start of a text."""

    words: np.ndarray  # sorted hashes of the symbol words (the end among them)
    unigram: np.ndarray  # counts by symbol, without the start
    groups: int

    @property
    def size(self) -> int:
        return len(self.words) + self.groups

    def symbols(self, t: Tokens) -> np.ndarray:
        if not len(self.words):
            return np.maximum(t.group, 0)
        i = np.minimum(np.searchsorted(self.words, t.hashes), len(self.words) - 1)
        return np.where(self.words[i] == t.hashes, i, len(self.words) + np.maximum(t.group, 0))


def contexts(symbols: np.ndarray, counts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols two and one before each token; ``start`` before a text."""
    w1, w2 = np.full(len(symbols), start), np.full(len(symbols), start)
    w2[1:], w1[2:] = symbols[:-1], symbols[:-2]
    first = np.cumsum(counts) - counts
    w2[first] = w1[first] = start
    second = first[counts > 1] + 1
    w1[second] = start
    return w1, w2


class LogBilinear:
    """Context vectors ``q``, matrices ``c1`` and ``c2``, output vectors ``r``, biases ``b``."""

    NAMES = ("q", "r", "c1", "c2", "b")

    def __init__(self, unigram: np.ndarray, dim: int, seed: int = 8):
        rng = np.random.default_rng(seed)
        n = len(unigram)
        self.q = (rng.standard_normal((n + 1, dim)) * 0.1).astype(np.float32)
        self.r = (rng.standard_normal((n, dim)) * 0.1).astype(np.float32)
        self.c1 = np.eye(dim, dtype=np.float32) * 0.5
        self.c2 = np.eye(dim, dtype=np.float32)
        self.p = ((unigram + 0.5) / (unigram + 0.5).sum()).astype(np.float64)
        self.b = np.log(self.p).astype(np.float32)
        self.squares = None

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at:at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def _sum_rows(self, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Rows added up by id (sorted by a radix sort of 16-bit ids)."""
        order = np.argsort(ids.astype(np.uint16) if n < 65536 else ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        out = np.zeros((n, rows.shape[1]), np.float32)
        out[ids[first]] = np.add.reduceat(rows[order], first, axis=0)
        return out

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, noise: np.ndarray, rate: float) -> float:
        """One NCE step: each token against the batch's noise words. Returns the
        mean loss per token."""
        k, m = len(noise), len(w)
        x1, x2 = self.q[w1], self.q[w2]
        ctx = x1 @ self.c1 + x2 @ self.c2
        log_kp = np.log(k * self.p).astype(np.float32)
        rw = self.r[w]
        good = np.einsum("ij,ij->i", ctx, rw) + self.b[w] - log_kp[w]
        bad = ctx @ self.r[noise].T + (self.b[noise] - log_kp[noise])
        e_good = 1 / (1 + np.exp(good))  # 1 - sigmoid
        e_bad = 1 / (1 + np.exp(-bad))
        loss = float(np.log1p(np.exp(-good)).mean() + np.log1p(np.exp(bad)).sum(axis=1).mean())
        scale = np.float32(1 / m)
        g_ctx = (e_bad @ self.r[noise] - e_good[:, None] * rw) * scale
        n = len(self.r)
        grads = {
            "r": self._sum_rows(w, -(e_good * scale)[:, None] * ctx, n) + self._sum_rows(noise, (e_bad.T @ ctx) * scale, n),
            "b": np.bincount(noise, e_bad.sum(axis=0) * scale, n) - np.bincount(w, e_good * scale, n),
            "c1": x1.T @ g_ctx, "c2": x2.T @ g_ctx,
            "q": self._sum_rows(w1, g_ctx @ self.c1.T, n + 1) + self._sum_rows(w2, g_ctx @ self.c2.T, n + 1),
        }
        if self.squares is None:
            self.squares = {name: np.full(getattr(self, name).shape, 1e-8, np.float32) for name in self.NAMES}
        for name, g in grads.items():  # Adagrad
            g = g.astype(np.float32)
            self.squares[name] += g * g
            getattr(self, name)[...] -= rate * g / np.sqrt(self.squares[name])
        return loss

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores by (context symbol, symbol) of the two context places; the bias
        is in the second."""
        return self.q @ self.c1 @ self.r.T, self.q @ self.c2 @ self.r.T + self.b


def log_normalisers(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """log sum over symbols of exp(score), by (w1 in ``first``'s rows, w2)."""
    out = np.empty((len(first), len(second)), np.float32)
    b = second.max(axis=1)
    e2 = np.exp(second - b[:, None])
    for i, row in enumerate(first):
        a = row.max()
        out[i] = np.log(np.maximum(e2 @ np.exp(row - a), 1e-30)) + a + b
    return out


def _train_batches(batches: Iterator[pa.RecordBatch], shared, dim: int, rate: float) -> Iterator[pa.RecordBatch]:
    vocabulary, flat = shared.value
    model = LogBilinear(vocabulary.unigram, dim)
    model.load(flat)
    rng = np.random.default_rng(1)
    start, seen = vocabulary.size, 0
    cdf = np.cumsum(model.p)
    waiting: list[np.ndarray] = []
    held = 0
    with np.errstate(over="ignore"):
        def run(triples, size):
            nonlocal seen
            # batches are spread over the block, not neighbouring texts
            triples = triples[:, rng.permutation(triples.shape[1])]
            for at in range(0, triples.shape[1], size):
                part = triples[:, at:at + size]
                noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE) * cdf[-1]), len(cdf) - 1)
                model.step(part[0], part[1], part[2], noise, rate)
                seen += part.shape[1]

        for batch in batches:
            for s in W.slices(batch.column(0)):
                t = tokens(s, vocabulary.groups)
                sym = vocabulary.symbols(t)
                waiting.append(np.stack([*contexts(sym, t.counts, start), sym]).astype(np.int32))
                held += len(sym)
                if held >= 64 * BATCH:
                    run(np.concatenate(waiting, axis=1), BATCH)
                    waiting, held = [], 0
        if waiting:
            run(np.concatenate(waiting, axis=1), BATCH)
    values = model.flat()
    piece = 1024
    n = -(-len(values) // piece)
    padded = np.zeros(n * piece, np.float64)
    padded[:len(values)] = values
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, float(seen))), pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * piece), pa.array(padded))], ["piece", "weight", "v"])


def average(trained: DataFrame, n: int) -> np.ndarray | None:
    """The token-weighted mean of the tasks' parameters, summed by Spark; what comes
    to the driver is one parameter vector."""
    one = trained.filter("weight > 0").select("piece", "weight", F.posexplode("v").alias("i", "x")).groupBy("piece", "i").agg(
        (F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("mean"))
    rows = one.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("v")).collect()
    if not rows:
        return None
    out = np.zeros(max(r[0] for r in rows) * 1024 + 1024)
    for r in rows:
        out[r[0] * 1024:r[0] * 1024 + 1024] = [x["mean"] for x in r[1]]
    return out[:n]


@dataclass
class Scorer:
    """All that a scoring task needs; its size is fixed by the parameters."""

    vocabulary: Vocabulary
    first: np.ndarray
    second: np.ndarray
    normal: np.ndarray
    frequent: np.ndarray  # sorted hashes
    frequent_c: np.ndarray
    group_mass: np.ndarray
    total: int  # N
    distinct: int  # V


def _normalise(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    first, second = shared.value
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for at in range(0, len(ids), 64):
            part = ids[at:at + 64]
            z = log_normalisers(first[part], second)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(z), pa.list_(pa.float32()))], ["w1", "z"])


def least_frequent(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words reach, to about 3 %: counts are
    grouped by 24 steps per factor of 2, some hundred rows in all."""
    step = F.floor(F.log2("c") * 24)
    rows = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect()
    least, total = 1, 0
    for i, r in enumerate(sorted(rows, key=lambda r: -r["s"])):
        total += r["n"]
        if total > most:
            return least if i else r["c"] + 1
        least = r["c"]
    return least


TOKENS_PER_TASK = 2_000_000


def train(docs: DataFrame, counts: DataFrame, symbols: int = SYMBOLS, groups: int = GROUPS, dim: int = DIM,
          frequent: int = FREQUENT, rounds: int = 1, rate: float = 0.05, tokens_per_task: int = TOKENS_PER_TASK) -> Scorer:
    """Trains on every document that is not held out; ``counts`` is its ``word_counts``.
    Partitions are merged (not split) until a task has about ``tokens_per_task`` tokens, so
    the model does not depend on how finely the table is dealt out."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the end counts as the most frequent, so it is a symbol and in the broadcast table
    # as all symbols are
    is_end = F.col("word") == F.lit(int(END_HASH))
    least = least_frequent(counts, frequent)
    top = counts.filter(is_end | (F.col("c") >= least)).select("word", "c").toPandas()  # at most frequent + 1 rows
    top = top.sort_values(["c", "word"], ascending=[False, True])
    top = top.iloc[np.argsort(top["word"].to_numpy(np.int64) != END_HASH, kind="stable")]
    order = np.argsort(top["word"].to_numpy(np.int64))
    hashes, c = top["word"].to_numpy(np.int64)[order], top["c"].to_numpy(np.int64)[order]
    chosen = np.sort(top["word"].to_numpy(np.int64)[:symbols])
    # the words that are no symbols, by group
    names = spark.createDataFrame([(int(x),) for x in chosen], "o_word long")
    rest = counts.join(F.broadcast(names), F.col("word") == F.col("o_word"), "left_anti").groupBy("grp").agg(
        F.sum("c").alias("c"), F.sum(F.col("c") + 0.5).alias("mass")).collect()  # at most one row per group
    mass, in_group = np.full(groups, 0.5), np.zeros(groups)
    for r in rest:
        if r["grp"] is not None and r["grp"] >= 0:
            mass[r["grp"]] += r["mass"]
            in_group[r["grp"]] = r["c"]
    at = np.searchsorted(hashes, chosen) if len(hashes) else np.empty(0, np.int64)
    unigram = np.concatenate([c[np.minimum(at, max(len(c) - 1, 0))] if len(c) else np.empty(0), in_group]).astype(np.float64)
    vocabulary = Vocabulary(chosen, unigram, groups)
    model = LogBilinear(unigram, dim)
    flat = model.flat()
    # each task's model is moved by what it reads and the models are averaged: tasks that
    # read little would leave the mean near its start, however much text there is in all
    tasks = max(1, -(-int(totals[0]) // tokens_per_task))
    texts = docs.filter(~held_out(F.col("doc_id"))).select(whole_text().alias("text")).coalesce(tasks)
    size = len(flat)
    for i in range(rounds if totals[0] else 0):
        shared = sc.broadcast((vocabulary, flat))
        trained = written(texts.mapInArrow(partial(_train_batches, shared=shared, dim=dim, rate=rate / (1 + i)),
                                           "piece int, weight double, v array<double>"), "lbl")
        flat = average(trained, size)
        model.load(flat)
    first, second = (x.astype(np.float32) for x in model.tables())
    shared = sc.broadcast((first, second))
    z = np.zeros((len(first), len(first)), np.float32)
    parts = max(1, min(len(first) // 64, sc.defaultParallelism * 2))
    for r in spark.range(0, len(first), 1, parts).mapInArrow(partial(_normalise, shared=shared), "w1 long, z array<float>").collect():
        z[r["w1"]] = r["z"]  # symbols**2 numbers
    return Scorer(vocabulary, first, second, z, hashes, c, mass, int(totals[0]), int(totals[1]))


# ---- scoring ----------------------------------------------------------------

def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted keys, -1 if it is not there."""
    if not len(keys):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[i] == h, i, -1)


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    m: Scorer = shared.value
    v = m.vocabulary
    n_sym = len(v.words)
    log_mass = np.log10(m.group_mass)
    log_c = np.log10(m.frequent_c + 0.5)
    for batch in batches:
        for s in W.slices(batch.column(2)):
            t = tokens(s, v.groups)
            sym = v.symbols(t)
            w1, w2 = contexts(sym, t.counts, v.size)
            # natural logarithm of the symbol's probability, then decimal
            model = (m.first[w1, sym] + m.second[w2, sym] - m.normal[w1, w2]).astype(np.float64) / np.log(10)
            i = _lookup(m.frequent, t.hashes)
            known = i >= 0
            word = np.where(known, log_c[i] if len(log_c) else 0.0, 0.0)  # log10(c + 1/2); of rare words added later
            grouped = sym >= n_sym
            model += np.where(grouped, word - log_mass[np.where(grouped, sym - n_sym, 0)], 0.0)
            first = np.cumsum(t.counts) - t.counts
            rare = np.flatnonzero(~known)
            doc = np.searchsorted(first + t.counts, rare, "right")
            offsets = np.searchsorted(doc, np.arange(len(t.counts) + 1)).astype(np.int32)
            n = len(t.counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s.first, n), batch.column(1).slice(s.first, n), pa.array(t.counts.astype(np.int64)),
                 pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(word, first)),
                 pa.array(np.add.reduceat(model, first)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(t.hashes[rare]))],
                ["doc_id", "text_key", "n_tokens", "n_known", "base", "model", "rare"])


def score_documents(docs: DataFrame, counts: DataFrame, scorer: Scorer) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(whole_text()).alias("text_key"), whole_text().alias("text"))
    part = written(rows.mapInArrow(partial(_score_batches, shared=shared),
                                   f"doc_id {kind}, text_key long, n_tokens long, n_known long, base double, model double, rare array<long>"),
                   "scored")
    # rare words meet their counts by a shuffle; no word among them is frequent
    rare = part.filter(F.size("rare") > 0).dropDuplicates(["doc_id", "text_key"]).select(
        "doc_id", "text_key", F.explode("rare").alias("r_word"))
    c = rare.join(counts.select("word", "c"), F.col("r_word") == F.col("word"), "left").groupBy("doc_id", "text_key").agg(
        F.count("c").alias("more_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"))
    c = c.select(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key"), "more_known", "more")
    log_all = float(np.log10(scorer.total + 0.5 * (scorer.distinct + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return part.join(c, part["doc_id"].eqNullSafe(c["o_id"]) & (part["text_key"] == c["o_key"]), "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(scorer.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("model") + more).alias("score"))


def score_corpus(docs: DataFrame, **parameters) -> DataFrame:
    """Counts, trains and scores."""
    counts = written(word_counts(docs, parameters.get("groups", GROUPS)), "counts")
    return score_documents(docs, counts, train(docs, counts, **parameters))
