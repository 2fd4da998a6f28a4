"""Quality classifier learned from trusted positives and unlabelled text.

The classifier minimises the non-negative unbiased risk
``prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)])`` with logistic loss, so that the
score is an estimate of the probability of label 1. The class prior is estimated from the
positives and the unlabelled texts alone; labels other than 1 are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interlace.llm.common import U64, checkpoint, run_lengths, shingles, slices, utf8, words

#: Bound of either sample that a classifier is fitted on.
SAMPLE = 12_000
HIDDEN = 16
SPELLING = 64


def _kinds() -> np.ndarray:
    kind = np.full(256, 7, np.int64)
    kind[128:] = 6
    kind[:32] = 9
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"?-()")):
        kind[list(chars)] = i
    kind[ord("!")] = 8
    return kind


KIND = _kinds()


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row for each text: shares of character kinds, repetition and spelling; no label, language or source."""
    return np.concatenate([_features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in slices(at)] or [np.zeros((0, 20 + SPELLING))])


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    key = row.astype(U64) << U64(44) | h >> U64(20)
    key.sort()
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] >> U64(44)).astype(np.int64), minlength=n)


def _features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, size = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 10 + KIND[raw], minlength=10 * n).reshape(n, 10) / np.maximum(size, 1)[:, None]
    h, starts, counts = words(raw, at)
    word = np.repeat(np.arange(n), counts)
    least = np.maximum(counts, 1)
    inner = np.flatnonzero(run_lengths(counts) > 0)
    stuck = np.bincount(word[inner[h[inner] == h[inner - 1]]], minlength=n)
    runs, per_row = shingles(h, counts, 3)
    fresh = _distinct(runs, np.repeat(np.arange(n), per_row), n)
    upper = np.bincount(word[(raw[starts] >= 65) & (raw[starts] <= 90)], minlength=n)
    breaks = np.flatnonzero(raw == 10)
    lines = np.bincount(row[breaks], minlength=n) + 1
    twice = np.bincount(row[1:][(raw[1:] == raw[:-1]) & (KIND[raw[1:]] >= 5)], minlength=n) if len(raw) else np.zeros(n)
    # shares of hashed pairs of letters
    pairs = np.zeros((n, SPELLING))
    if len(raw) > 1:
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.int64)
        code = (low[:-1] * 31 + low[1:] * 57) % SPELLING
        pairs = np.bincount(row[:-1] * SPELLING + code, minlength=n * SPELLING).reshape(n, SPELLING) / np.maximum(size, 1)[:, None]
    more = np.stack([np.log1p(size), np.log1p(counts), size / least, _distinct(h, word, n) / least, np.log1p(_distinct(h, word, n)), stuck / least, fresh / np.maximum(per_row, 1), upper / least, counts / lines, twice / np.maximum(size, 1)], 1)
    return np.concatenate([kinds, more, np.sqrt(pairs)], 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.weights, np.clip((x - self.mean) / self.scale, -8, 8))[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _forward(w: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w[0] + w[1])
    return hidden @ w[2] + x @ w[3] + w[4][0], hidden


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Non-negative PU learning of one hidden layer beside a linear part, by Adam over whole samples."""
    width = unlabelled.shape[1]
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    rng = np.random.default_rng(7)
    w = [rng.normal(0, 0.1, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(width), np.array([np.log(prior / (1 - prior))])]
    if not len(positive):
        return Model(mean, scale, tuple(w))
    x = np.clip((np.concatenate([positive, unlabelled]) - mean) / scale, -8, 8)
    p, u = len(positive), len(unlabelled)
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for step in range(1, steps + 1):
        f, hidden = _forward(tuple(w), x)
        s = 1 / (1 + np.exp(-f))
        negative = np.logaddexp(0, f[p:]).mean() - prior * np.logaddexp(0, f[:p]).mean()
        g = np.empty(p + u)
        if negative >= 0:
            g[:p] = (prior * (s[:p] - 1) - prior * s[:p]) / p
            g[p:] = s[p:] / u
        else:  # the estimate of the negative risk fell below 0: step back along it
            g[:p] = prior * s[:p] / p
            g[p:] = -s[p:] / u
        back = (g[:, None] * w[2]) * (1 - hidden**2)
        grads = [x.T @ back + decay * w[0], back.sum(0), hidden.T @ g + decay * w[2], x.T @ g + decay * w[3], np.array([g.sum()])]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, tuple(w))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled, by best bin estimation on held-out halves.

    A classifier fitted on one half of both samples scores the other. Above a threshold lie a share
    u of the unlabelled and p of the positives; u / p bounds the prior from above, and comes near it
    where few negatives score so high. The threshold is the one with the least upper confidence
    bound of u / p at level ``delta``. Halves change places and the two estimates are averaged. One half
    where a sample has fewer than four rows.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    rng = np.random.default_rng(11)
    halves = [np.array_split(x[rng.permutation(len(x))], 2) for x in (positive, unlabelled)]
    found = []
    for learn, test in ((0, 1), (1, 0)):
        model = fit(halves[0][learn], halves[1][learn], 0.5, steps=300)
        p, u = (np.sort(model.logit(h[test])) for h in halves)
        bars = np.unique(p)
        above = lambda x, bars=bars: 1 - np.searchsorted(x, bars, "left") / len(x)
        slack = sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (p, u))
        at = np.argmin((above(u) + (1 + gamma) * slack) / above(p))
        found.append(above(u)[at] / above(p)[at])
    return float(np.clip(np.mean(found), 0.01, 0.99))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` positives of the learning folds and ``sample`` documents of any kind.

    Both are the rows with the least hashed ids, so they don't depend on how rows are dealt; where
    ids repeat, the rows of the chosen ids with the least hashed features. The ids (at most twice
    ``sample``) are broadcast, at most ``sample`` rows of features a kind come to the driver.
    Without positives every text gets the prior, which then is one half.
    """
    learn = labels.where(~held_out() & (F.col("quality") == 1) & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id", F.lit(5))
    trusted = learn.select("doc_id").distinct().orderBy(order).limit(sample).withColumn("trusted", F.lit(1))
    any_kind = docs.where("doc_id is not null").select("doc_id").orderBy(order).limit(sample).distinct().withColumn("any_kind", F.lit(1))
    chosen = trusted.join(any_kind, "doc_id", "full")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(*utf8(b["text"])).astype("<f8")
            yield pa.RecordBatch.from_arrays([b["trusted"], b["any_kind"], pa.array([r.tobytes() for r in x], pa.binary())], ["trusted", "any_kind", "x"])

    rows = checkpoint(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("trusted", "any_kind", "text").mapInArrow(measure, "trusted int, any_kind int, x binary"))

    def matrix(which: str) -> np.ndarray:
        kept = rows.where(F.col(which) == 1).select("x").orderBy(F.xxhash64("x"), "x").limit(sample).collect()
        return np.frombuffer(b"".join(sorted(bytes(r["x"]) for r in kept)), "<f8").reshape(-1, 20 + SPELLING)

    positive, unlabelled = matrix("trusted"), matrix("any_kind")
    return fit(positive, unlabelled if len(unlabelled) else np.zeros((1, 20 + SPELLING)), class_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """All columns of docs and ``column``, from 0 to 1, which replaces one of that name. Null and empty texts are
    scored as empty texts, an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(features(*utf8(b["text"]))))], [*b.schema.names, column])

    docs = docs.drop(column)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; an empty table gives none, null ids aren't held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
