"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its byte n-grams; both the embeddings and the softmax
are trained by stochastic gradient descent in numpy.

Rejection. Beside the languages there is a class of texts that are none of them. Its examples are made from the
training texts: their letters put in place of others, by a permutation of its own for each text, and words of random
letters, digits and characters of other scripts. What shares few n-grams with any language falls to it.

Calibration. A temperature is fitted on held-back rows that share next to no five words with the rows
trained on, whole and cut to a few words (whole texts alone are all told apart, and bound no temperature). A text is
rejected if it is likelier of no language than `NONE`, or if the score is below the one that a share of
`REJECT_RATE` of the whole held-back texts does not reach.

Defined results: a null text or one without a letter is `und` with score 0 and is rejected; a table
without any labelled text gives `und` for all; repeated rows are judged row by row; ties go to the first language of
the alphabet; bytes that are no UTF-8 are n-grams like others; an empty table gives no rows. `identify` carries other
columns along and puts its own in place of those called lang_pred, score or rejected; `reject` leaves every column as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import excerpt, fields_of, give_back, held_out, own_name, replacing, set_apart, steps, strings, task
from .features import gram_ids
from .nearcopies import hashes, normal

GRAMS, BITS, DIM = (2, 3, 4), 15, 16
#: Documented bounds of the training sample: texts, shared out evenly over the languages, languages, and characters of a
#: text that are trained on (a longer one's in windows from its beginning to its end; every text is judged whole).
MAX_TRAIN, MAX_LANGS, MAX_CHARS = 3000, 200, 20_000
#: Share of whole held-back texts that the least score may cost, and how likely of no language a rejected text is.
REJECT_RATE, NONE = 0.001, 0.5
#: Most characters of an example of no language.
FOREIGN = 1000
#: The class of no language, which no label equals.
NO_LANGUAGE = None


@dataclass
class LanguageModel:
    langs: list[str | None]
    table: np.ndarray  # (languages, len(GRAMS) * (2**BITS + 1)): softmax weights times embeddings
    bias: np.ndarray
    temperature: float
    threshold: float
    refuses: bool = False  # whether the last class is NO_LANGUAGE

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros((len(off) - 1, len(self.langs)))
        for a, b in steps(off, 1 << 18):
            o = off[a : b + 1]
            size = np.diff(o)
            if o[-1] == o[0]:
                continue
            full = size > 0
            total, n = np.zeros((full.sum(), len(self.langs))), np.zeros(full.sum())
            for k, g in enumerate(GRAMS):
                ids = gram_ids(data, o, g, BITS)
                at = slice(k * ((1 << BITS) + 1), (k + 1) * ((1 << BITS) + 1))
                for c in range(1, len(self.langs)):  # relative to the first language, which stays at zero
                    total[:, c] += np.add.reduceat(self.table[c, at].take(ids), (o[:-1] - o[0])[full], dtype=np.float64)
                n += np.maximum(size[full] - g + 1, 0)
            out[a:b][full] = total / np.maximum(n, 1)[:, None]
        return out + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams of a text, and their shares."""
    width = (1 << BITS) + 1
    b = np.frombuffer(text, np.uint8)
    ids = np.concatenate([gram_ids(b, np.array([0, len(b)]), g, BITS).astype(np.int64) + k * width for k, g in enumerate(GRAMS)]) if len(b) else np.zeros(0, np.int64)
    ids, n = np.unique(ids[ids % width != 1 << BITS], return_counts=True)
    return ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def _foreign(text: str, rng: np.random.Generator) -> str:
    """A text of no language: the letters of a part of `text` in place of each other, or random words about as long."""
    text = text[: int(rng.integers(40, FOREIGN))]
    kind = rng.integers(0, 4)
    if kind < 2:
        letters = sorted({c for c in text.lower() if c.isalpha()} | set("abcdefghijklmnopqrstuvwxyz") | (set("äöüåæøőűčšžłńśżğışēāţã") if kind else set()))
        return text.lower().translate({ord(a): letters[k] for a, k in zip(letters, rng.permutation(len(letters)), strict=True)})
    scripts = ((97, 123), (48, 58), (0x430, 0x450), (0x3B1, 0x3CA), (0x5D0, 0x5EB), (0x627, 0x64B), (0x905, 0x93A), (0xE01, 0xE2F), (0x3041, 0x3097), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (33, 127))
    low, high = scripts[rng.integers(0, len(scripts))]
    sizes = rng.integers(1, 12 if kind == 2 else 40, max(1, len(text) // 6))
    return " ".join("".join(map(chr, rng.integers(low, high, n))) for n in sizes.tolist())


def _excerpts(text: str, rng: np.random.Generator) -> list[str]:
    """The text, and a few words of it."""
    words = text.split()
    n = int(rng.integers(1, 9))
    at = int(rng.integers(0, max(1, len(words) - n)))
    return [text, " ".join(words[at : at + n])]


def fit(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 20.0, seed: int = 3, refuse: bool = False) -> LanguageModel:
    """Stochastic gradient descent over (text, language) pairs, a tenth of them for calibration; with `refuse` also over texts of no language."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = max(1, len(texts) // 10) if len(texts) >= 20 else 0
    trained = [(texts[i], langs[i]) for i in order[cut:]]
    seen = set(chain.from_iterable(hashes(normal(t.encode()), 5).tolist() for t, _ in trained))
    held = []
    for i in order[:cut]:
        own = hashes(normal(texts[i].encode()), 5).tolist()
        if sum(h in seen for h in own) <= 0.1 * len(own):  # no near copy of what is trained on
            held.append((texts[i], langs[i]))
    whole = len(held)
    if refuse:
        trained += [(_foreign(t, rng), NO_LANGUAGE) for t, _ in trained[::2]]
        held += [(_foreign(t, rng), NO_LANGUAGE) for t, _ in held]
    names = sorted(set(langs)) + [NO_LANGUAGE] * refuse
    number = {n: k for k, n in enumerate(names)}
    y = np.array([number[x] for _, x in trained])
    width = (1 << BITS) + 1
    bags = [_bag(t.encode()) for t, _ in trained]
    emb = rng.normal(0, 0.1, (len(GRAMS) * width, DIM))
    out, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    weight = len(y) / (len(names) * np.maximum(1, np.bincount(y, minlength=len(names))))
    for e in range(epochs):
        step = rate * (1 - e / epochs)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 16)):
            if not len(rows):
                continue
            h = np.stack([bags[i][1] @ emb[bags[i][0]] for i in rows])
            p = _softmax(h @ out + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (weight[y[rows]] / len(rows))[:, None]
            back = p @ out.T
            out -= step * 0.1 * (h.T @ p)
            bias -= 0.05 * p.sum(0)
            for k, i in enumerate(rows):
                emb[bags[i][0]] -= step * bags[i][1][:, None] * back[k]
            if e == 0 and not out.any():
                out += rng.normal(0, 0.1, out.shape)
    for k in range(len(GRAMS)):
        emb[k * width + (1 << BITS)] = 0
    table = (emb @ out).T
    model = LanguageModel(names, np.ascontiguousarray(table - table[0], np.float32), bias, 1.0, 0.0, refuse)
    if held and len(names) > 1:
        parts = [(x, number[lang], k == 0 and i < whole) for i, (t, lang) in enumerate(held) for k, x in enumerate(_excerpts(t, rng))]
        known = [_bag(x.encode()) for x, _, _ in parts]
        z = np.stack([model.table[:, ids].astype(float) @ share for ids, share in known]) + bias
        goal, full = np.array([g for _, g, _ in parts]), np.array([w for _, _, w in parts])
        grid = np.exp(np.linspace(np.log(0.002), np.log(10), 120))
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), goal], 1e-9)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        best = _softmax(z / model.temperature)[:, : len(names) - refuse].max(1)
        model.threshold = float(np.quantile(best[full], REJECT_RATE) / 2) if full.any() else 0.0
    del bags, emb, seen
    give_back()
    return model


def train(documents: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel | None:
    """Fit on at most `max_train` labelled texts outside the held-out fold, evenly over languages."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return None
    each = max(1, max_train // len(counts))
    h = F.xxhash64(F.col("doc_id"), F.lit(11))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 30, int(1.5 * each / n * (1 << 30)) + 1))])
    ids = known.select("doc_id", "lang", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")))
    ids = ids.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= each)
    begun = F.min(excerpt("text", MAX_CHARS)).alias("text")  # one row of those that share an id
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(begun).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows], refuse=True)


_JUDGED = ["lang_pred", "score", "rejected"]


def _judged(documents: DataFrame, model: LanguageModel | None) -> tuple[DataFrame, dict[str, str]]:
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        apart, own = set_apart(documents)
        return apart.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)}), own
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a table of at most MAX_LANGS languages
    apart, own = set_apart(documents, letter.alias("letter"))
    text = own_name(own, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = len(m.langs) - m.refuses
        langs = np.array([*m.langs[:known], "und"], object)
        for batch in batches:
            p = _softmax(m.logits(*strings(batch[text])) / m.temperature)
            ok = batch["letter"].to_numpy(zero_copy_only=False)
            best = np.where(ok, p[:, :known].argmax(1), known)
            s = np.where(ok, p[:, :known].max(1), 0.0)
            refused = ~ok | (s < m.threshold) | (p[:, known:].sum(1) > NONE)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own.values()), pa.array(langs[best], pa.string()), pa.array(s), pa.array(refused)], [*own.values(), *_JUDGED])

    return apart.mapInArrow(task(run), f"{fields_of(apart.drop('letter'))}, lang_pred string, score double, rejected boolean"), own


def identify(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Every column of `documents` with lang_pred, score and rejected appended."""
    return replacing(*_judged(documents, model), _JUDGED)


def reject(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of `documents` that are not rejected, with their own columns only."""
    judged, own = _judged(documents, model)
    return replacing(judged.where(~F.col("rejected")), own, [])
