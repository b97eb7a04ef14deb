"""Audit of how filters interact, over every order in which they can be applied.

A document's outcome under an order of filters depends on nothing but the set of filters that it fails, a mask of five bits. So
Spark reduces the corpus to histograms, for each part one row of 32 counts of all, of good and of toxic documents, and the rest is one
product: the stacked histograms times integer matrices of 32 rows (masks) by 600 columns (120 orders of five steps), one for each
of the outcomes kept, removed, redundant and unique. Summing what a filter removes over its columns gives its Shapley value times 120.

Texts are read once and travel no further than their digest (SHA-256, by which texts are the same); what is shuffled is an id, a digest
and a few bits a document. A group of copies is counted before it moves: a row a (digest, part, labels), however many documents share a text.

Defined results: null text is empty text and a copy of it; null lang is the part "" and one with it; a null doc_id has no label, is no
copy and makes none; rows that share an id are documents of their own, copies only of smaller ids; an id with several label rows is
good (toxic) if one of them says so; an empty table gives no rows; other columns are ignored; bytes that are no UTF-8 count as the
characters that Spark reads in them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import task

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
#: What each column of the matrices stands for.
STEPS = tuple((order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    failed = (n < 100, 100 * distinct < 80 * n, 100 * capitals.cast("long") > 10 * F.length(whole).cast("long"), whole.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def outcome_matrices() -> dict[str, np.ndarray]:
    """For each outcome the masks (rows) that have it at each step of each order (columns); `owner` says which filter a column applies."""
    masks = np.arange(1 << len(FILTERS))[:, None]
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    now = np.array([bit[order[step - 1]] for order, step in STEPS])
    before = np.array([sum(bit[f] for f in order[: step - 1]) for order, step in STEPS])
    fails, gone = masks & now != 0, masks & before != 0
    owner = (now[:, None] == np.array(list(bit.values()))).astype(np.int64)
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == now}
    return {k: v.astype(np.int64) for k, v in found.items()} | {"owner": owner}


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, failed (bits of A to D), n: distinct ones, with how often they occur."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(F.col("text")).alias("failed"))
    return seen.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents that fail exactly the filters of the mask."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.hex("digest")))  # rows without an id don't meet under one key
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key"))
    marked = marked.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = _documents(docs).withColumn("key", key).join(marked, "key", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # ids are distinct within these groups, so the least id's row says how many documents have it
    groups = joined.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a row a part and label here, not a document
    originals = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("least", least).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("failed").alias("mask"), originals.alias("n")), F.struct((F.col("failed") + 16).alias("mask"), (F.col("all") - originals).alias("n")))).alias("of"),
    )
    n = F.col("of.n")
    return split.groupBy("part", F.col("of.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )


_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def multiplied(stacked: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The counts of COUNTS, a row a part and a column a step: histograms (parts by 32) times the outcome matrices."""
    to = outcome_matrices()
    out = {c: stacked["n"] @ to[c] for c in ("kept", "removed", "redundant", "unique_fails")}
    out |= {"good_lost": stacked["good"] @ to["removed"], "toxic_lost": stacked["toxic"] @ to["removed"]}
    return out | {"shapley": out["removed"] @ to["owner"] @ to["owner"].T}


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders, steps = [o for o, _ in STEPS], np.array([s for _, s in STEPS], np.int32)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            rows = batch.slice(a, 256).to_pylist()
            stacked = {c: np.zeros((len(rows), 1 << len(FILTERS)), np.int64) for c in ("n", "good", "toxic")}
            for k, row in enumerate(rows):
                for cell in row["cells"]:
                    for c, h in stacked.items():
                        h[k, cell["mask"]] = cell[c]
            out = multiplied(stacked)
            parts = [r["part"] for r in rows for _ in STEPS]
            columns = [pa.array(parts, pa.string()), pa.array(orders * len(rows)), pa.array(np.tile(steps, len(rows)))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out[c].ravel()) for c in COUNTS], ["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step, with COUNTS."""
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")  # 32 at most
    return histograms(docs, labels).groupBy("part").agg(cells).mapInArrow(task(_product), _SCHEMA)
