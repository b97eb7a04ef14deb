"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents carry a label in training; every other text is unlabelled. A
linear model over the presence of hashed words and word prefixes is trained in numpy on

    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))

with the logistic loss; where the second part falls below zero its gradient is ascended, which
keeps a flexible model from driving the estimated negative risk under zero. pi is the class prior.

The unlabelled sample is drawn from all documents, the confirmed ones among them, as R_u is of the whole population.

Calibration. The logit is shifted so that a share `MATCH` of the prior scores above a half in the unlabelled sample (but
never so far that half the largest weight alone does not decide: a prior that is too large flags no text without
marks), and steepened to the slope that brings the mean score nearest to the prior.

Defined results: a null text scores as an empty one (the bias alone); repeated rows and ties are
scored row by row; of several labels of one doc_id any that is toxic counts; a table without any confirmed example gives
every document the prior; bytes that are no UTF-8 are letters of words; an empty table gives no rows; columns beyond the
four that are named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import excerpt, held_out, sample_ids, steps, strings, task
from .features import word_features

#: Documented bounds of the training sample: confirmed and unlabelled texts, and characters of one that are trained on (a longer
#: one's in windows from its beginning to its end; every text is scored whole).
MAX_POSITIVE, MAX_UNLABELLED, MAX_CHARS = 3000, 6000, 10_000
#: Share of the prior that is to score above a half in the unlabelled sample, and the steepest slope.
MATCH, STEEPEST = 0.9, 20.0
#: Share of common features that makes a near copy in the training sample, and how many rare features find it.
COPY, MARKS = 0.8, 3
#: A feature is kept if this many confirmed examples of the sample hold it, if it is this many times as
#: frequent in them as in the unlabelled texts, and if chance would give it so often less than once in
#: `CHANCE` tries over all features of the examples (by a Poisson bound). Weights may be of either sign.
MIN_POSITIVE_DF, MIN_LIFT, CHANCE = 4, 2.0, 1


@dataclass
class PuModel:
    keys: np.ndarray  # sorted features, the upper 32 bits of their hashes
    weights: np.ndarray
    bias: float
    centre: float = 0.0  # the logit that scores a half
    slope: float = 1.0

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each text; whole texts, in bounded steps."""
        out = np.empty(len(off) - 1)
        for a, b in steps(off):
            doc, key = word_features(data, off[a : b + 1])
            key = _short(key)
            total = np.zeros(b - a)
            if len(self.keys) and len(key):
                hit = self._maybe(key)
                doc, key = doc[hit], key[hit]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[at] == key
                pair = np.unique(doc[ok] * len(self.keys) + at[ok])
                total = np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], b - a)
            out[a:b] = _sigmoid(self.slope * (total + self.bias - self.centre))
        return out

    def _maybe(self, key: np.ndarray) -> np.ndarray:
        """A 2**20-bit sieve before the exact look-up."""
        if not hasattr(self, "_sieve"):
            self._sieve = np.zeros(1 << 20, bool)
            self._sieve[self.keys >> np.uint32(12)] = True
        return self._sieve[key >> np.uint32(12)]

    def calibrated(self, logits: np.ndarray, prior: float) -> PuModel:
        """With centre and slope for logits of the population."""
        largest = float(self.weights.max(initial=0.0))
        centre = max(float(np.quantile(logits, 1 - MATCH * prior)), self.bias + largest / 2)
        slope = min(np.linspace(1.0, STEEPEST, 77), key=lambda k: abs(_sigmoid(k * (logits - centre)).mean() - prior))
        return PuModel(self.keys, self.weights, self.bias, centre, float(slope))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _short(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(32)).astype(np.uint32)


def _untrained(prior: float) -> PuModel:
    return PuModel(np.zeros(0, np.uint32), np.zeros(0), float(np.log(prior / (1 - prior))))


def nnpu(ptr: np.ndarray, idx: np.ndarray, positive: np.ndarray, n_features: int, prior: float, epochs: int = 40, rate: float = 0.05, l2: float = 1e-5, seed: int = 7, correct: bool = True) -> tuple[np.ndarray, float]:
    """Train on documents whose present features are idx[ptr[i]:ptr[i+1]]; returns weights and bias. Without `correct` the risk may fall below zero."""
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(p) or not len(u):
        return w[:-1], float(w[-1])
    n_batches, t = max(1, len(u) // 256), 0
    size = np.diff(ptr)

    def margin(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = size[rows]
        at = np.repeat(ptr[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        row = np.repeat(np.arange(len(rows)), n)
        return np.bincount(row, w[idx[at]], len(rows)) + w[-1], row, idx[at]

    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(p), n_batches), np.array_split(rng.permutation(u), n_batches)
        for pb, ub in zip(ps, us, strict=True):
            if not len(pb):
                pb = p[rng.integers(0, len(p), 8)]
            rows = np.concatenate([pb, ub])
            f, row, col = margin(rows)
            s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))  # d loss(-1) / df; d loss(+1) / df is s - 1
            is_p = np.arange(len(rows)) < len(pb)
            soft = np.logaddexp(0, f)
            negative = soft[~is_p].mean() - prior * soft[is_p].mean()
            g = np.where(is_p, prior * (s - 1) / len(pb), 0.0)
            g_neg = np.where(is_p, -prior * s / len(pb), s / len(ub))
            g = g + g_neg if negative >= 0 or not correct else -g_neg
            grad = np.bincount(col, g[row], n_features + 1) + l2 * w * (np.arange(n_features + 1) < n_features)
            grad[-1] += g.sum()
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = strings(batch["text"])
        found = []
        for i in range(batch.num_rows):
            found.append(np.unique(_short(word_features(data, off[i : i + 2])[1])).tobytes())
        yield pa.RecordBatch.from_arrays([batch["positive"], pa.array(found, pa.binary())], ["positive", "features"])


def _spread(sets: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Mask that keeps one of the sampled texts that are near copies of each other, in each class.

    They would have what they alone share taken for a mark of their class. A text is a near copy of a kept one if
    at least `COPY` of the features of both are common; texts that share one of their `MARKS` least rare features are
    compared. A feature is rare if a fiftieth of the texts at most hold it; texts without a rare feature stay.
    """
    if not sets:
        return np.zeros(0, bool)
    keys, df = np.unique(np.concatenate(sets), return_counts=True)
    common = keys[df > max(1, len(sets) // 50)]
    held: dict[tuple[bool, int], list[int]] = {}
    kept = np.zeros(len(sets), bool)
    for i, s in enumerate(sets):
        marks = [(bool(positive[i]), int(k)) for k in s[~np.isin(s, common, assume_unique=True)][:MARKS]]
        met = {j for m in marks for j in held.get(m, ()) if min(len(s), len(sets[j])) >= COPY * max(len(s), len(sets[j]))}
        kept[i] = not any(_alike(s, sets[j]) for j in met)
        if kept[i]:
            for m in marks:
                held.setdefault(m, []).append(i)
    return kept


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= COPY * (len(a) + len(b) - both)


def train(documents: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> PuModel:
    """Learn from the confirmed toxic rows and from unlabelled text outside the held-out fold.

    At most `max_positive` confirmed and `max_unlabelled` other documents are sampled by a hash of
    their id. `prior` is the share of toxic documents; by default that of the labelled rows.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "toxic")
    n, n_pos = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    prior = min(0.9, max(1e-3, n_pos / n)) if prior is None and n else (prior or 0.5)
    if not n_pos:
        return _untrained(prior)
    pos = sample_ids(known.where(F.col("toxic") == 1).select("doc_id").distinct(), "doc_id", max_positive, 1)
    rest = sample_ids(documents.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id"), "doc_id", max_unlabelled, 2)
    chosen = pos.withColumn("positive", F.lit(True)).unionByName(rest.withColumn("positive", F.lit(False))).distinct()  # at most max_positive + max_unlabelled rows
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "positive")
        .agg(F.min(excerpt("text", MAX_CHARS)).alias("text"))  # one row of those that share an id
        .select("positive", "text")
        .mapInArrow(task(_features_of), "positive boolean, features binary")
        .collect()
    )
    rows.sort(key=lambda r: (r.positive, bytes(r.features)))
    sets = [np.frombuffer(r.features, np.uint32) for r in rows]
    positive = np.array([r.positive for r in rows], bool)
    kept = _spread(sets, positive)
    sets, positive = [s for s, k in zip(sets, kept, strict=True) if k], positive[kept]
    if not positive.any():
        return _untrained(prior)
    keys, df = np.unique(np.concatenate([s for s, p in zip(sets, positive, strict=True) if p]), return_counts=True)
    n_seen = len(keys)
    keys, df = keys[df >= MIN_POSITIVE_DF], df[df >= MIN_POSITIVE_DF]
    n_p, n_u = positive.sum(), max(1, (~positive).sum())
    df_u = np.zeros(len(keys))
    for s, p in zip(sets, positive, strict=True):
        if not p:
            df_u += np.isin(keys, s, assume_unique=True)
    expected = np.maximum(n_p * (df_u + 1) / n_u, 1e-9)
    surprise = df * np.log(df / expected) - df + expected  # minus the logarithm of the chance, at least
    keys = keys[(df / n_p >= MIN_LIFT * df_u / n_u) & (df > expected) & (surprise >= np.log(CHANCE * max(1, n_seen)))]
    if not len(keys):
        return _untrained(prior)
    cols = [np.flatnonzero(np.isin(keys, s, assume_unique=True)) for s in sets]
    ptr = np.concatenate([[0], np.cumsum([len(c) for c in cols])])
    w, bias = nnpu(ptr, np.concatenate(cols), positive, len(keys), prior)
    logits = np.array([w[c].sum() + bias for c, p in zip(cols, positive, strict=True) if not p])
    return PuModel(keys, w, bias).calibrated(logits, prior) if len(logits) else PuModel(keys, w, bias)


def score(documents: DataFrame, model: PuModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `documents`."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most the features of max_positive texts

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(*strings(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return documents.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(
        task(scored), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    )
