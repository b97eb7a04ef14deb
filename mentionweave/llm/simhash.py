"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments: of two fingerprints that differ in at most two
bits, one segment differs in at most one. Each segment is indexed under its 32 variants with one
bit deleted (a wildcard), so that an equality join on the variants meets every such pair, and the
Hamming distance verifies it. Equal fingerprints are one index entry with many documents.

Variants under which more than `MAX_BUCKET` different fingerprints meet are not joined with
themselves: their members are linked through the fingerprints at distance one of them, as two
differ in at most two bits exactly if they have such a neighbour (or themselves) in common. At
most 65 fingerprints share one, so no group grows with the data, and no link is lost.

`report` takes three words a shingle and links at two bits. `deduplicate` is for texts alike by `SIMILARITY` of their
five-word shingles, which flips more bits than two (six in the middle, up to eleven, of the 293 such pairs of different
texts in the 15 MB table): there the neighbourhoods of fingerprints are one source of candidates, keys of least
hashes (`nearcopies`) are the other, and exact similarity decides.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; texts
of one or two words are one shingle; repeated rows share a component; a null doc_id is carried along, links like any
other and never names a component while another id is there (one of such rows alone has none); an empty table gives no rows.
`deduplicate` keeps one row of each component, that of the least (doc_id, row hash), rows without a doc_id last, so
that rows that share a doc_id but no component stay; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearcopies
from .common import strings, task, written
from .components import connected

SHINGLE, SEED, MAX_BUCKET = 3, 42, 32
#: Words of a shingle and similarity of near copies.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included."""
    words = nearcopies.normal(text)
    return combined(nearcopies.hashes(words, shingle)) if words else 0


def combined(hashes: np.ndarray) -> int:
    """The fingerprint of the shingles' hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        bits = np.ascontiguousarray(hashes[k : k + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = strings(batch["text"])
        view = memoryview(data)
        found = [fingerprint(bytes(view[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every whole text."""
    return documents.select("doc_id", "text").mapInArrow(task(_prints), "doc_id long, fp long")


def _variants(prints: DataFrame) -> DataFrame:
    """fp under its 64 keys: the segment and deleted bit in the upper half, what is left below."""
    segment = F.when(F.col("p") < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    key = segment.bitwiseAND(F.expr("~shiftleft(1L, p % 32)")).bitwiseOR(F.expr("shiftleft(cast(p as long), 32)"))
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select("fp", key.alias("key"))


def links(prints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints of `prints` (column fp, distinct) that join all that link."""
    index = _variants(prints)
    meets = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    meets = written(meets, "simhash-meets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = meets.where("n = 2").select("a", "b").where(near)
    # Crowded keys grow with the corpus: the join is a merge join at every size, and none that only small ones could have.
    crowd = written(index.join(meets.where("n > 2").select("key", "n").hint("merge"), "key"), "simhash-crowd")
    few = crowd.where(F.col("n") <= max_bucket)
    joined = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where(F.col("a") < F.col("b")).select("a", "b").where(near)
    many = crowd.where(F.col("n") > max_bucket).select("fp").distinct()
    flips = many.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("p")).select(
        "fp", F.expr("if(p < 0, fp, fp ^ shiftleft(1L, p))").alias("at")
    )
    stars = flips.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    flipped = flips.join(stars, "at").select(F.col("fp").alias("a"), "b").where("a <> b")
    return pairs.unionByName(joined).unionByName(flipped).distinct()


def components(documents: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id reachable over links."""
    prints = written(fingerprints(documents), "simhash-prints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    joined = connected(links(groups.select("fp")))
    named = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("at"))
    least = named.groupBy("at").agg(F.min("rep").alias("component_id"))
    named = written(named.join(least, "at").select("fp", "component_id"), "simhash-named")  # a table of its own, so that Spark can split the join's hot keys
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def report(documents: DataFrame) -> DataFrame:
    """components() with the fingerprint as 16 lowercase hexadecimal digits."""
    return components(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketches(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id, r1 and r2 (the row's name), key (the text's), n distinct shingles, fp and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, found = [], [], [], []
            for words in nearcopies.texts(batch):
                h = nearcopies.hashes(words, shingle)
                distinct = np.unique(h)
                keys.append(nearcopies.key_of(words))
                sizes.append(len(distinct))
                prints.append(combined(h) if len(h) else 0)
                found.append(nearcopies.bands(distinct))
            values = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "r1", "r2")), *values], ["doc_id", "r1", "r2", "key", "n", "fp", "bands"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(task(run), f"doc_id {kind}, r1 long, r2 long, key long, n long, fp long, bands array<long>")


def neighbourhoods(prints: DataFrame) -> DataFrame:
    """band and key: texts (key, fp) that share a fingerprint or link with the same one are of one band, which that names."""
    edges = links(prints.select("fp").distinct()).select(F.col("a").alias("fp"), F.col("b").alias("centre"))
    near = edges.unionByName(edges.select(F.col("centre").alias("fp"), "centre")).unionByName(prints.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp", F.col("fp").alias("centre")))
    near = written(near.distinct(), "simhash-near")  # a table of its own, so that Spark can split the join's hot keys
    return prints.join(near, "fp").select(F.xxhash64(F.lit("fingerprint"), "centre").alias("band"), "key")


def deduplicate(documents: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of texts linked by a similarity of `similarity` or more of their shingles."""
    rows = documents.select("doc_id", *nearcopies.row_name(documents), "text")
    sketches = written(_sketches(rows, shingle), "nearcopies-sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("best")  # the row that is kept
    groups = written(sketches.groupBy("key").agg(best, *(F.first(c).alias(c) for c in ("n", "fp", "bands"))), "nearcopies-groups")
    index = groups.select("key", "n", F.explode("bands").alias("band"))
    index = index.unionByName(neighbourhoods(groups.select("key", "fp")).join(groups.select("key", "n"), "key").select("key", "n", "band"))
    component = nearcopies.components(rows, groups.select("key", "best.r1", "best.r2"), index, shingle, similarity)
    named = groups.join(component, groups["key"] == component["node"], "left").select("best", F.coalesce("component", "key").alias("component"))
    chosen = written(named.groupBy("component").agg(F.min("best").alias("best")).select("best.r1", "best.r2"), "nearcopies-chosen")
    return nearcopies.keep_one(documents, chosen)
