"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers, floor(256 x). They are put in order of a locality-preserving code and cut
into document ranges: superblocks of `SUPER` rows, each of blocks of `BLOCK`. A term is a dimension
with a sign; its maximum in a block is the largest value (for positive query weights) or the
smallest (for negative ones). The sum of weight times maximum bounds any score in the block.

1. Every query is scored against its own superblock, which gives a first k-th score.
2. Chunks of queries meet chunks of superblock summaries; only superblocks whose bound reaches
   the k-th score of some query of the chunk go on.
3. A chunk goes through its superblocks in order of their lead (the bound over the k-th score). In each, every query takes
   the blocks in order of their bound and scores them through their rows, until the bound falls below its
   k-th score, which rises from block to block and superblock to superblock.

Chunks, summaries and superblocks have fixed sizes, and a chunk's superblocks stream by one at a time, so no task's memory
grows with the data; queries are never broadcast. A bound equal to the k-th score is still scored, so ties are settled by vec_id alone.

Defined results: vectors null, empty or holding null or non-finite components take no part; vectors of different
lengths meet as if the shorter one ended in zeros; scores are exact, and one outside the range of a long is the nearest
long (and ties with others like it); repeated ids are rows of their own, and none meets its own id; with fewer than
k candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import task, written
from .vectors import cross_polytope, rotated, usable

K, SCALE, BLOCK, SUPER, CHUNK, SUMMARIES = 5, 256.0, 64, 1024, 128, 512

#: Numbers beyond it count as it, so that bounds stay finite; scores of such are out of a long's range anyway.
LARGE = 1e150
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def packed(x: np.ndarray) -> bytes:
    """A matrix of whole numbers in as few bytes a number as hold them all."""
    most = np.abs(x).max(initial=0)
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64
    return np.array([*x.shape, np.dtype(kind).itemsize], np.int64).tobytes() + x.astype(kind).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    rows, width, size = np.frombuffer(b, np.int64, 3)
    return np.frombuffer(b, {2: np.int16, 4: np.int32, 8: np.float64}[int(size)], rows * width, 24).astype(np.float64).reshape(rows, width)


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices below each other, with zeros where one is less wide."""
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, off = batch["embedding"].values.to_numpy(zero_copy_only=False).astype(np.float64), batch["embedding"].offsets.to_numpy()
        size = np.diff(off)
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            x = flat[off[rows][:, None] + np.arange(d)]
            small = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # codes go by direction, and squares stay finite
            code = np.zeros(len(x), np.int64)
            for k in range(3):
                code = code * 4096 + cross_polytope(rotated(small, 77 + k))[0][:, 0]
            ints = np.clip(np.floor(SCALE * x), -LARGE, LARGE)
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(rows)), pa.array(code), pa.array([r.tobytes() for r in ints], pa.binary())], ["vec_id", "code", "ints"])


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q @ x.T exactly: in floating point where sums stay under 2**53, else in Python's integers, cut to the range of a long."""
    d = min(q.shape[1], x.shape[1])
    q, x = q[:, :d], x[:, :d]
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * d < 2.0**53:
        return (q @ x.T).astype(np.int64)
    left, right = ([[int(v) for v in row] for row in m.tolist()] for m in (q, x))
    return np.array([[min(max(sum(a * b for a, b in zip(u, v, strict=True)), _LEAST), _MOST) for v in right] for u in left], np.int64).reshape(len(q), len(x))


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima: no score of a row under (high, low) is larger. Rounded up by more than sums can err."""
    d = min(q.shape[1], high.shape[1])
    q, high, low = q[:, :d], high[:, :d], low[:, :d]
    b = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return np.maximum(b + np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T * 1e-12, float(_LEAST))


def _reach(floor: np.ndarray) -> np.ndarray:
    """Scores as floating point numbers that are not larger."""
    f = floor.astype(np.float64)
    return np.where(np.abs(f) < 2.0**53, f, np.nextafter(f, -np.inf))


def _supers(k: int, every: int):
    """Rows of one partition, in order, to superblocks of one length of vector with their own queries' first k-th scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[bytes] = []
        for batch in batches:
            for i, r in zip(batch["vec_id"].to_pylist(), batch["ints"].to_pylist(), strict=True):
                if rows and (len(rows) == SUPER or len(r) != len(rows[0])):
                    yield made(ids, rows)
                    ids, rows = [], []
                ids.append(i)
                rows.append(r)
        if rows:
            yield made(ids, rows)

    def made(given: list[int], rows: list[bytes]) -> pa.RecordBatch:
        ids = np.array(given, np.int64)
        x = np.frombuffer(b"".join(rows), np.float64).reshape(len(ids), -1)
        at = np.flatnonzero(ids % every == 0)
        floor = np.full(len(at), _LEAST)
        s = product(x[at], x)
        for n, i in enumerate(at):
            own = s[n][ids != ids[i]]
            if len(own) >= k:
                floor[n] = np.partition(own, len(own) - k)[len(own) - k]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.binary()) for v in (ids.tobytes(), packed(x), packed(x.max(0)[None]), packed(x.min(0)[None]), ids[at].tobytes(), packed(x[at]), floor.tobytes())],
            ["ids", "x", "high", "low", "query_ids", "queries", "floors"],
        )

    return run


_SUPER = "ids binary, x binary, high binary, low binary, query_ids binary, queries binary, floors binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of neighbouring superblocks, in chunks."""
    kept: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("query_ids", "queries", "floors")), strict=True):
            if row[0]:
                kept.append((np.frombuffer(row[0], np.int64), unpacked(row[1]), np.frombuffer(row[2], np.int64)))
            while sum(len(i) for i, _, _ in kept) >= CHUNK:
                ids, queries, floors = np.concatenate([i for i, _, _ in kept]), stacked([q for _, q, _ in kept]), np.concatenate([f for _, _, f in kept])
                yield one(ids[:CHUNK], queries[:CHUNK], floors[:CHUNK])
                kept = [(ids[CHUNK:], queries[CHUNK:], floors[CHUNK:])]
    if sum(len(i) for i, _, _ in kept):
        yield one(np.concatenate([i for i, _, _ in kept]), stacked([q for _, q, _ in kept]), np.concatenate([f for _, _, f in kept]))


def one(ids: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (ids.tobytes(), packed(queries), floors.tobytes())], ["query_ids", "queries", "floors"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        ids, high, low = zip(*rows, strict=True)
        values = (np.array(ids, np.int64).tobytes(), *(packed(stacked([unpacked(v) for v in x])) for x in (high, low)))
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["supers", "high", "low"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("super", "high", "low")), strict=True):
            rows.append(row)
            if len(rows) == SUMMARIES:
                yield made(rows)
                rows = []
    if rows:
        yield made(rows)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunk, supers, leads = [], [], []
        for c, q, f, s, h, w in zip(*(batch[n].to_pylist() for n in ("chunk", "queries", "floors", "supers", "high", "low")), strict=True):
            lead = (_bounds(unpacked(q), unpacked(h), unpacked(w)) - _reach(np.frombuffer(f, np.int64))[:, None]).max(0)
            on = lead >= 0
            chunk += [c] * int(on.sum())
            supers += np.frombuffer(s, np.int64)[on].tolist()
            leads += lead[on].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(supers, pa.int64()), pa.array(leads, pa.float64())], ["chunk", "super", "lead"])


class Search:
    """The best candidates of a chunk of queries so far."""

    def __init__(self, query_ids: bytes, queries: bytes, floors: bytes, k: int) -> None:
        self.ids, self.q, self.floor, self.k = np.frombuffer(query_ids, np.int64), unpacked(queries), np.frombuffer(floors, np.int64).copy(), k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]  # scores, ids

    def add(self, ids: bytes, x: bytes) -> None:
        """Score a superblock, each query's blocks in order of their bound until it falls below the k-th score."""
        did, rows = np.frombuffer(ids, np.int64), unpacked(x)
        starts = np.arange(0, len(did), BLOCK)
        bound = _bounds(self.q, np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts))
        order = np.argsort(-bound, 1, kind="stable")
        for wave in order.T:  # the n-th block of every query
            on = np.flatnonzero(bound[np.arange(len(wave)), wave] >= _reach(self.floor))
            if not len(on):
                return
            for b in np.unique(wave[on]):
                of = on[wave[on] == b]
                d = did[starts[b] : starts[b] + BLOCK]
                s = product(self.q[of], rows[starts[b] : starts[b] + BLOCK])
                ok = (s >= self.floor[of][:, None]) & (d != self.ids[of][:, None])
                for n in np.flatnonzero(ok.any(1)):
                    self._take(of[n], s[n][ok[n]], d[ok[n]])

    def _take(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.concatenate([self.best[n][0], scores]), np.concatenate([self.best[n][1], ids])
        top = np.lexsort((d, ~s))[: self.k]  # ~s is -s - 1, which no long overflows
        self.best[n] = s[top], d[top]
        if len(top) == self.k:
            self.floor[n] = max(self.floor[n], s[top[-1]])

    def rows(self) -> pa.RecordBatch:
        size = [len(s) for s, _ in self.best]
        scores, ids = (np.concatenate([b[k] for b in self.best]) if self.best else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, size)), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


def _scored(k: int):
    """Rows of a chunk's queries and of its superblocks after them to the chunk's best candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search | None = None
        for batch in batches:
            for query_ids, queries, floors, ids, x in zip(*(batch[n].to_pylist() for n in ("query_ids", "queries", "floors", "ids", "x")), strict=True):
                if query_ids is None:
                    search.add(ids, x)
                    continue
                if search is not None:
                    yield search.rows()
                search = Search(query_ids, queries, floors, k)
        if search is not None:
            yield search.rows()

    return run


def search(embeddings: DataFrame, k: int = K, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query (vec_id divisible by `every`)."""
    rows = embeddings.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    n = rows.count()
    coded = rows.mapInArrow(task(_coded), "vec_id long, code long, ints binary").withColumn("width", F.length("ints"))
    place = ["width", "code", "vec_id"]
    spread = coded.repartitionByRange(max(1, min(4096, n // (8 * SUPER))), *place).sortWithinPartitions(*place).drop("width")
    supers = written(spread.mapInArrow(task(_supers(k, every)), _SUPER).withColumn("super", F.monotonically_increasing_id()), "topk-supers")
    chunks = supers.select("query_ids", "queries", "floors").mapInArrow(task(_chunks), "query_ids binary, queries binary, floors binary")
    chunks = written(chunks.withColumn("chunk", F.monotonically_increasing_id()), "topk-queries")
    summed = written(supers.select("super", "high", "low").mapInArrow(task(_summaries), "supers binary, high binary, low binary").withColumn("part", F.monotonically_increasing_id()), "topk-summaries")
    parts = [r.part for r in summed.select("part").collect()]  # one number for SUMMARIES * SUPER rows
    pairs = chunks.withColumn("part", F.explode(F.lit(parts).cast("array<bigint>"))).join(summed, "part")
    met = pairs.select("chunk", "queries", "floors", "supers", "high", "low").mapInArrow(task(_survivors), "chunk long, super long, lead double")
    met = written(met, "topk-met")
    none = F.lit(None).cast("binary")
    work = met.join(supers.select("super", "ids", "x"), "super").select("chunk", "lead", none.alias("query_ids"), none.alias("queries"), none.alias("floors"), "ids", "x")
    work = work.unionByName(chunks.select("chunk", F.lit(float("inf")).alias("lead"), "query_ids", "queries", "floors", none.alias("ids"), none.alias("x")))
    work = work.repartition("chunk").sortWithinPartitions("chunk", F.desc("lead"))
    found = work.select("query_ids", "queries", "floors", "ids", "x").mapInArrow(task(_scored(k)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
