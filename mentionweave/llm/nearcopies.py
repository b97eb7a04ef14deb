"""Candidates and verification of near copies by the Jaccard similarity of word shingles.

Texts that are equal but for case of A-Z and white space are one text. Of each text's shingles,
`BANDS` keys of `ROWS` minimum hashes are made; texts that share a key meet. Two of similarity 0.8
share none with a chance of 7e-5, and fewer the more alike they are. Who meets is compared by exact sets of
shingles, until every two texts that meet are known to be of one component or not alike.

First every band's leader is compared with all others of it: the text that meets most others, so that the middle of a
group of copies leads it in all of its bands. That is one comparison a text and band, and settles bands whose texts
are of one component by then. The texts of the others are compared in blocks: a task takes two blocks of a band of at most about `BLOCK` texts
and `ENTRIES` shingles each, counts the shingles that every two texts share by products of matrices, and gives back no pairs, but
for each text one of its component. No pair of texts is a row of any table; a band whose texts meet and are not alike costs a row for each of its
texts and blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import replacing, set_apart, strings, task, written
from .components import connected

BANDS, ROWS, SEED = 24, 5, 42
#: Texts and shingles of one block, about, and columns of one product.
BLOCK, ENTRIES, COLUMNS = 256, 200_000, 2048
#: Shingles that are hashed under all functions at a time.
HASHED = 1 << 9
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def normal(text: bytes) -> bytes:
    """Words in lower case (A-Z only) with one space between; white space is 09-0D and 20."""
    return b" ".join(text.lower().split())


def hashes(words: bytes, shingle: int) -> np.ndarray:
    """64-bit hash of each shingle of a normal text, repeats included; one of a text that is shorter, none of an empty one."""
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words.split(b" ")), np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    end = (start + size)[shingle - 1 :] if len(size) >= shingle else np.array([len(words)])
    digest = xxhash.xxh64_intdigest
    spans = zip(start[: len(end)].tolist(), end.tolist(), strict=True)
    return np.fromiter((digest(words[a:b], SEED) for a, b in spans), np.uint64, len(end))


def bands(distinct: np.ndarray) -> list[int]:
    """A signed key for each band; none of an empty text."""
    if not len(distinct):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(distinct), HASHED):
        mixed = distinct[k : k + HASHED, None] * _MUL + _ADD
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, off = strings(batch["text"])
    view = memoryview(data)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield normal(bytes(view[a:b]))


def key_of(words: bytes) -> int:
    return xxhash.xxh64_intdigest(words, SEED) - (1 << 63)


def _sets(documents: DataFrame, shingle: int) -> DataFrame:
    """key and its distinct shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for words in texts(batch):
                keys.append(key_of(words))
                found.append(np.unique(hashes(words, shingle)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["key", "hashes"])

    return documents.select("text").mapInArrow(task(run), "key long, hashes array<long>")


def shared(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, n) numbers of shingles that two texts have in common; `hashes` are distinct for each owner."""
    order = np.argsort(hashes, kind="stable")
    owner, hashes = owner[order], hashes[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    owner, number = owner[often], number[often]
    column = np.cumsum(np.concatenate([[True], number[1:] != number[:-1]])[: len(number)]) - 1
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, (a, a + COLUMNS)))
        x = np.zeros((n, COLUMNS), np.float32)
        x[owner[at], column[at] - a] = 1
        both += x @ x.T
    return both


def joined(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each text a text of its component, by links a-b and by equal labels."""
    _, root = np.unique(label, return_inverse=True)
    n = len(label)
    root = root + n  # a node for each label
    a, b = np.concatenate([a, np.arange(n)]), np.concatenate([b, root])
    least = np.arange(n + int(root.max(initial=n - 1)) - n + 1)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least[:n]
        least = new


def _compared(similarity: float):
    """Texts in order of (band, low, high) to links (a, b) that join those of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if left is not None:
                now = pa.concat_tables([left, now])
            key = _group(now)
            ends = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True) if len(ends) else ():
                yield compare(now.slice(a, b - a))
            left = now.slice(int(ends[-1])) if len(ends) else now
        if left is not None and left.num_rows:
            yield compare(left)

    def compare(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        keys, label, sets = t["key"].to_numpy(), t["of"].to_numpy(), t["hashes"].combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        both = shared(np.repeat(np.arange(len(keys)), size), sets.flatten().to_numpy(), len(keys))
        alike = np.triu(both >= similarity * (size[:, None] + size[None] - both), 1)
        a, b = np.nonzero(alike)
        other = label[a] != label[b]
        root = joined(a[other], b[other], label) if other.any() else np.arange(len(keys))
        on = (root != np.arange(len(keys))) & (label[root] != label)
        return pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(keys[root[on]])], ["a", "b"])

    return run


def _group(t: pa.Table) -> np.ndarray:
    return np.stack([t[c].to_numpy() for c in ("band", "low", "high")], 1)


def components(rows: DataFrame, groups: DataFrame, index: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, component) of the keys that are alike to another by `similarity` or more, over links between such; all but the least of each.

    `rows`: r1, r2, text; `groups`: key, r1, r2 of one row of each text; `index`: band, key and n distinct shingles, texts of a band meet.
    """
    crowded = index.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    index = written(index.join(crowded.hint("merge"), "band"), "nearcopies-index")
    meets = index.groupBy("key").agg(F.sum("size").alias("meets"))
    index = written(index.join(meets, "key").select("band", "key", "n", "meets"), "nearcopies-meets")
    wanted = groups.join(meets, "key", "left_semi")
    sets = written(_sets(rows.join(wanted.select("r1", "r2"), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]), shingle), "nearcopies-sets")
    first = F.max_by(F.struct(F.col("key").alias("a"), F.col("n").alias("n_a")), F.struct("meets", -F.col("key"))).alias("first")
    leaders = written(index.groupBy("band").agg(first).select("band", "first.*"), "nearcopies-leaders")  # a table of its own, so that Spark can split the join's hot keys
    may = F.least("n", "n_a") >= similarity * F.greatest("n", "n_a")  # sets so different in size can't be alike
    met = index.join(leaders, "band").where((F.col("a") != F.col("key")) & may).select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
    pairs = met.join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha")), "a")
    common = F.size(F.array_intersect("ha", "hb"))
    alike = written(pairs.where(common >= similarity * (F.size("ha") + F.size("hb") - common)).select("a", "b"), "nearcopies-alike")
    component = connected(alike)
    labelled = index.join(component.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "n", F.coalesce("component", "key").alias("of"))
    labelled = written(labelled, "nearcopies-labelled")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / ENTRIES)).cast("int").alias("parts")
    still = written(labelled.groupBy("band").agg(parts, F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("band", "parts"), "nearcopies-open")
    placed = labelled.join(still, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "of")
    blocks = placed.join(sets, "key").select("band", "low", "high", "key", "of", "hashes")
    more = blocks.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high").mapInArrow(task(_compared(similarity)), "a long, b long")
    return connected(alike.unionByName(written(more, "nearcopies-more")))


def row_name(documents: DataFrame) -> tuple[Column, Column]:
    """r1 and r2, 128 bits over all columns: rows that share both are the same row."""
    every = [x for c in documents.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(*every).alias("r1"), F.xxhash64(F.lit(1), *every).alias("r2")


def keep_one(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of `documents` that `chosen` (r1, r2) names, one of each."""
    rows, own = set_apart(documents, *row_name(documents))
    return replacing(rows.join(chosen, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]), own, [])
