"""Mixing sources to target weights with soft membership.

A classifier trained on a labelled table gives each document posteriors over the domains: the
toxicity learner's score, brought to the labels' scale on labelled rows that it was not trained on (its own least
score is far above the share of toxic texts among those that get it, and would count as toxic tokens), and what is left of one by a softmax over averaged subword embeddings
that tells low from high quality, weighted with the labelled classes' shares. Nonnegative document rates r minimise

    1/2 sum_d (sum_i r_i n_i p_id / T - target_d)^2 + ridge/2 sum_i (n_i / T) (r_i - 1)^2

where n_i are tokens, p_id posteriors and T all tokens.

Projected gradient, projected lazily. A gradient step moves every rate along its posteriors times the domains' residuals, which are scaled by
the inverse of the posteriors' second moments over the rows with a rate above zero. Steps are added up, and the sum is projected onto
r_i >= 0 where a rate is read: r_i = max(0, 1 - p_i . m), m the sum of the scaled residuals, one number a domain. Projecting every iterate
itself has the same least value as its fixed point, but would have to keep a rate a document, and a rate that was cut off once would come back at
the pace of the ridge alone; tests hold the rates against that slow form. A step is one pass over the posteriors that sums up residuals and
moments at several step lengths, of which the best is taken; nothing of a document's size is sent and no pass repeats an earlier one. The
least value is where the residuals are ridge times m. The ridge `HELD` vanishes against the data term: totals are the targets, and rates as near to 1 as that allows.
Steps end at a gradient below `TOLERANCE`; a warning tells the shares reached where they miss the targets, as
when no row is likely enough of a domain.

Defined results: null and empty texts have no tokens, the class shares as posteriors and do not change
the sums; a table without labels leaves every rate at 1; repeated rows are fitted row by row, and of several labels of
one doc_id the greater counts; columns of `documents` are carried along by `resample`, whatever their names, and
ignored by `rates`; `resample` draws with a hash of doc_id and text, so that a row is drawn alike on every run; an empty
table gives no rows. Tokens are words: ids of the tokenizer would cost more than all else here.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import excerpt, fields_of, held_out, own_name, replacing, sample_ids, set_apart, task, written
from .common import strings as strings_of
from .language import MAX_CHARS, LanguageModel, _softmax, fit
from .toxicity import PuModel
from .toxicity import score as toxic_scores
from .toxicity import train as train_toxicity

DOMAINS = ("high", "low", "toxic")
#: Shares of all tokens that the domains should have.
TARGETS = (0.84, 0.12, 0.04)
MAX_TRAIN, RIDGE, ROUNDS, TOLERANCE = 2400, 0.1, 80, 1e-7
#: The ridge that rates and resample use: totals within about HELD of the targets, and bounded copies where they cannot be reached.
HELD = 1e-4
#: How far an expected share may be from its target without a warning.
MISSED = 0.005
#: Step lengths that a pass tries.
LENGTHS = 0.5 ** np.arange(16)


def _logit(score: np.ndarray) -> np.ndarray:
    score = np.clip(score, 1e-6, 1 - 1e-6)
    return np.log(score / (1 - score))


def scaling(score: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logit that fit the labels (Platt's method); none where a class is missing."""
    if toxic.all() or not toxic.any():
        return 1.0, 0.0
    x = np.stack([_logit(score), np.ones(len(score))], 1)
    goal = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    at, best = np.array([1.0, 0.0]), np.inf
    step = np.zeros(2)
    for _ in range(100):
        tried = [at + t * step for t in LENGTHS]
        values = [np.mean(np.logaddexp(0, x @ a) - goal * (x @ a)) + 1e-6 * a @ a for a in tried]
        k = int(np.argmin(values))
        if not values[k] < best - 1e-12:
            break
        at, best = tried[k], values[k]
        s = 1 / (1 + np.exp(-x @ at))
        step = np.linalg.solve(x.T @ (x * (s * (1 - s))[:, None]) / len(x) + 2e-6 * np.eye(2), x.T @ (goal - s) / len(x) - 2e-6 * at)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


@dataclass
class DomainModel:
    quality: LanguageModel
    shares: np.ndarray  # of the labelled classes, in the order of quality.langs
    toxic: PuModel
    scale: tuple[float, float] = (1.0, 0.0)  # of the toxicity score's logit

    def posteriors(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, DOMAINS) probabilities that sum to 1."""
        q = _softmax(self.quality.logits(data, off) / self.quality.temperature) * self.shares
        q /= q.sum(1, keepdims=True)
        t = 1 / (1 + np.exp(-(self.scale[0] * _logit(self.toxic.score(data, off)) + self.scale[1])))
        p = np.zeros((len(q), len(DOMAINS)))
        p[:, [DOMAINS.index(d) for d in self.quality.langs]] = q * (1 - t)[:, None]
        p[:, DOMAINS.index("toxic")] = t
        return p


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DomainModel | None:
    """Learn quality from at most `max_train` labelled texts, half of them of each class, and toxicity as its learner does."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    known = labels.where("doc_id is not null and coalesce(toxic, 0) = 0").select("doc_id", domain.alias("domain")).where("domain is not null")
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    counts = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    low, high = (sample_ids(known.where(F.col("domain") == d), "doc_id", max_train // 2, 5) for d in ("low", "high"))
    chosen = low.unionByName(high)  # at most max_train rows
    begun = F.min(excerpt("text", MAX_CHARS)).alias("text")  # one row of those that share an id
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(begun).collect()
    if len({r.domain for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.domain, r.text))
    quality = fit([r.text for r in rows], [r.domain for r in rows])
    shares = np.array([counts[d] for d in quality.langs]) / sum(counts.values())
    toxic = train_toxicity(documents, labels)
    judged = labels.where(F.col("toxic").isNotNull() & held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = sample_ids(judged, "doc_id", max_train, 6)  # at most max_train rows
    tested = documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    tested = toxic_scores(tested.groupBy("doc_id").agg(F.min("text").alias("text")), toxic)
    seen = tested.join(F.broadcast(chosen), "doc_id").select("score", "toxic").collect()
    seen.sort()
    scale = scaling(np.array([r.score for r in seen]), np.array([r.toxic == 1 for r in seen], bool)) if seen else (1.0, 0.0)
    return DomainModel(quality, shares, toxic, scale)


def _tokens(text: str = "text") -> Column:
    """Number of words of the text, which stands for tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def posteriors(documents: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """`documents` with n_tokens and p, an array over DOMAINS, appended. Its columns must have other names."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a table of fixed size and the features of a bounded sample
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.posteriors(*strings_of(batch[text]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), batch["n_tokens"], pa.array(list(p), pa.list_(pa.float64()))], [*names, "n_tokens", "p"])

    return documents.withColumn("n_tokens", _tokens(text)).mapInArrow(task(run), f"{fields_of(documents)}, n_tokens long, p array<double>")


def replay(p: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Rates under the multipliers that `fit_rates` found."""
    return np.maximum(0.0, 1 - p @ multipliers)


def rate(multipliers: np.ndarray) -> Column:
    """`replay` of column p."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col("p")[d] * float(m) for d, m in enumerate(multipliers)), F.lit(0.0)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["p"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(DOMAINS))


def fit_rates(soft: DataFrame, targets: tuple[float, ...] = TARGETS, ridge: float = RIDGE, rounds: int = ROUNDS) -> np.ndarray:
    """The domains' summed steps m, by one pass over `soft` a step."""
    total = soft.agg(F.sum("n_tokens")).first()[0] or 0
    n, m = len(DOMAINS), np.zeros(len(DOMAINS))
    if not total:
        return m
    goal = np.array(targets) / sum(targets)
    names = [f"s{k}" for k in range(1 + n + n * n)]
    best, step, reached = np.inf, np.zeros(n), goal
    for _ in range(rounds):
        tried = [m + t * step for t in (LENGTHS if step.any() else LENGTHS[:1])]

        def sums(batches: Iterator[pa.RecordBatch], tried=tried) -> Iterator[pa.RecordBatch]:
            s = np.zeros((len(tried), len(names)))
            for batch in batches:
                p, tokens = _matrix(batch), batch["n_tokens"].to_numpy()
                for k, at in enumerate(tried):
                    r = replay(p, at)
                    s[k, 0] += tokens @ r**2 / 2
                    s[k, 1 : 1 + n] += (r * tokens) @ p
                    s[k, 1 + n :] += (p.T @ (p * (tokens * (r > 0))[:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(tried))), *(pa.array(c) for c in s.T)], ["at", *names])

        schema = "at long, " + ", ".join(f"{c} double" for c in names)
        found = {r["at"]: np.array(r[1:], float) / total for r in soft.select("n_tokens", "p").mapInArrow(task(sums), schema).groupBy("at").agg(*(F.sum(c) for c in names)).collect()}
        values = [found[k][0] + goal @ at + ridge / 2 * at @ at for k, at in enumerate(tried)]
        k = int(np.argmin(values))
        if not values[k] < best:  # no length is better: the least value, as near as numbers tell
            break
        m, best, s = tried[k], values[k], found[k]
        reached = s[1 : 1 + n]
        slope = reached - goal - ridge * m
        if np.abs(slope).max() < TOLERANCE * max(ridge, 1e-3):
            break
        step = np.linalg.solve(s[1 + n :].reshape(n, n) + ridge * np.eye(n), slope)
    if np.abs(reached - goal).max() > MISSED:
        warnings.warn(f"expected shares {dict(zip(DOMAINS, reached.round(4).tolist(), strict=True))} miss the targets {goal.round(4).tolist()}", stacklevel=2)
    return m


def rates(documents: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, one posterior column a domain, and rate, of every row."""
    model = train(documents, labels)
    if model is None:
        return documents.select("doc_id", _tokens().alias("n_tokens"), *(F.lit(1 / len(DOMAINS)).alias(f"p_{d}") for d in DOMAINS), F.lit(1.0).alias("rate"))
    soft = written(posteriors(documents.select("doc_id", "text"), model).drop("text"), "mixing-posteriors")
    multipliers = fit_rates(soft, targets, HELD)
    return soft.select("doc_id", "n_tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), rate(multipliers).alias("rate"))


def resample(documents: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """`documents` with each row as often as its rate says: floor(rate + u), u a hash of doc_id and text in [0, 1)."""
    model = train(documents, labels)
    if model is None:
        return documents
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1 << 40)) / float(1 << 40)
    apart, own = set_apart(documents, u.alias("u"))
    soft = written(posteriors(apart, model, own_name(own, "text")), "mixing-rows")  # the rows with their posteriors, so that no text is judged twice
    times = F.floor(rate(fit_rates(soft, targets, HELD)) + F.col("u")).cast("int")
    return replacing(soft.withColumn("copy", F.explode(F.array_repeat(F.lit(True), times))), own, [])
