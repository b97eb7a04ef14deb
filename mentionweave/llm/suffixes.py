"""Removal of repeated 200-byte strings by merging shard Burrows-Wheeler transforms.

Which suffixes can repeat at all. Every 200-byte window has one minimiser: its 32-byte gram of least
hash, the leftmost of equals. Neighbouring windows with the same minimiser form a class, and their bytes
together are the class's string; a window repeats only among windows of classes with the same gram. A class
whose gram is met once is done. Equal strings around one gram are one string with a weight; where it is
above one, the string is repeated as a whole. What is left are different strings around one gram.

The transforms. Strings are dealt out by their gram; a task takes about `MERGE_BYTES` of whole groups at a
time and cuts them into shards of `SHARD_BYTES`. A shard sorts its own suffixes, by blocks of the lengths
in `LEVELS`: blocks of 8 bytes are numbered in byte order, and two blocks of one length give the next. The
last numbering is the order of the shard's transform.

The merge. Shards are interleaved by their first 8 bytes, and each round refines the interleave to the
next level: a shard's distinct blocks, which are in order already, become pairs of numbers from the
interleave so far, and the sorted lists of pairs are merged. No round looks at single suffixes or sorts
those of several shards together. Neighbours that share a number after a round have a common prefix of
that length; after the last one, suffixes of one number and a weight of two or more are a repeated interval.

Hot grams. The strings around a gram grow with the corpus where it stands in boilerplate. Windows are
told apart by how far into them the gram starts; all that have it in one range of places share more bytes
around it than the gram, and those name a smaller group. A gram of more than `SHARD` different strings is
narrowed so, halving the range until no group is larger, at most eight times, as a range of one place names
the whole window. Every string goes on as its two halves: the work is linear, no pair of strings is formed,
and a task holds at most `SHARD` strings of one group. Rows that share id and text are one text there: a place in it is one string.

What is merged across tasks: nothing is. A transform is that of the strings around one gram, whose shards are merged in one task; strings
around different grams have no window in common, so that one transform of the corpus would add no interval to those found.

Defined results: null counts as empty; texts under 200 bytes hold no window and stay whole; copies of
a text of 200 bytes or more are removed entirely, rows with the same doc_id or none included; bytes that are no
UTF-8 count as they are in the report, and `deduplicate` drops them from a text that it cuts, as it does characters
of which a removal takes a part; an empty table gives no rows; other columns are ignored by the report and carried
along by `deduplicate`. Rows are told apart by 128 bits over doc_id and text, strings by 64 bits under one gram's 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, strings, task, written

WINDOW, GRAM = 200, 32
#: Most different strings around one gram that a task takes together.
SHARD = 2048
#: Prefix lengths to which the interleave is refined; each is at most twice the one before, the first is a machine word.
LEVELS = (8, 16, 32, 64, 128, WINDOW)
#: Windows of one text taken at a time; bytes of strings merged at a time, and of one shard among them.
CHUNK, MERGE_BYTES, SHARD_BYTES = 1 << 20, 1 << 20, 1 << 18

_M = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def _loads(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; bytes past the end are zero."""
    out = np.zeros(len(b) + 8, np.uint8)
    out[: len(b)] = b
    return np.lib.stride_tricks.as_strided(out, (len(b), 8), (1, 1)).copy().view("<u8").ravel()


def _hashes(loads: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes (a multiple of eight) from each position on that has so many."""
    m = max(0, len(loads) - size + 1)
    h = np.zeros(m, np.uint64)
    for k in range(0, size, 8):
        h = (h ^ loads[k : k + m]) * _M
        h ^= h >> np.uint64(29)
    return h


def classes(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of the gram, first window, window after the last, place of the gram) of each class of one text."""
    n = len(text) - WINDOW + 1
    found: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, n, CHUNK):
        b = text[at : min(len(text), at + CHUNK + WINDOW - 1)]
        h = _hashes(_loads(b), GRAM)
        least, s, w = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1, WINDOW - GRAM + 1
        while 2 * s <= w:
            least, s = np.minimum(least[:-s], least[s:]), 2 * s
        if w > s:
            least = np.minimum(least[: s - w], least[w - s :])
        pos = (least & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(pos[1:] != pos[:-1]) + 1])
        for out, x in zip(found, (h[pos[first]], first + at, np.append(first[1:], len(pos)) + at, pos[first] + at), strict=True):
            out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, (np.uint64, np.int64, np.int64, np.int64), strict=True))


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = strings(batch["text"])
        key, salt = batch["key"].to_numpy(), batch["salt"].to_numpy()
        rows: list[list[np.ndarray]] = []
        size = 0
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            if b - a >= WINDOW:
                g, s, e, at = classes(data[a:b])
                view = memoryview(data[a:b])
                u = np.fromiter((xxhash.xxh3_64_intdigest(view[x : y + WINDOW - 1]) for x, y in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s))
                rows.append([g.view(np.int64), u.view(np.int64), np.full(len(s), key[i]), np.full(len(s), salt[i]), s.astype(np.int32), e.astype(np.int32), (at - s).astype(np.int16)])
                size += len(s)
            if size > 1 << 16 or rows and i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["gram", "unit", "key", "salt", "start", "stop", "at"])
                rows, size = [], 0


@dataclass
class Shard:
    """Suffixes of some strings in byte order, by prefixes of each length in LEVELS."""

    starts: np.ndarray  # positions with a whole window
    words: np.ndarray  # distinct first 8 bytes, as numbers in byte order
    blocks: list[np.ndarray]  # for each level the number of the block at each position (undefined where a string ends before)
    firsts: list[np.ndarray]  # for each level a position of each block, in byte order

    @classmethod
    def of(cls, data: np.ndarray, off: np.ndarray) -> Shard:
        """`off` are the bounds of the strings in `data`."""
        size = np.diff(off)
        left = np.repeat(off[1:], size) - np.arange(off[-1])  # bytes from each position to its string's end
        word = _loads(data[: off[-1]]).byteswap()
        words, blocks, firsts = np.zeros(0, np.uint64), [], []
        for k, length in enumerate(LEVELS):
            at = np.flatnonzero(left >= length)
            if k:
                known, step = blocks[-1], length - LEVELS[k - 1]
                key = known[at] * (len(firsts[-1]) + 1) + known[at + step]
            else:
                key = word[at]
            by = np.argsort(key)
            key = key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            block = np.zeros(off[-1], np.int64)
            block[at[by]] = np.cumsum(new) - 1
            words = words if k else key[new]
            blocks.append(block)
            firsts.append(at[by[new]])
        return cls(np.flatnonzero(left >= WINDOW), words, blocks, firsts)

    def order(self) -> np.ndarray:
        """The shard's suffix array: positions with a whole window in order of the window's bytes, then of place."""
        return self.starts[np.argsort(self.blocks[-1][self.starts], kind="stable")]


def interleave(lists: list[np.ndarray]) -> tuple[int, list[np.ndarray]]:
    """Merge sorted lists of distinct keys: how many differ, and the place of each list's keys among them."""
    keys = np.concatenate(lists)
    at = np.argsort(keys, kind="stable")  # finds the sorted runs and merges them
    keys = keys[at]
    place = np.empty(len(keys), np.int64)
    place[at] = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]) - 1
    return int(place.max(initial=-1)) + 1, np.split(place, np.cumsum([len(x) for x in lists])[:-1])


def refined(shards: list[Shard]) -> list[np.ndarray]:
    """For each shard the place of its blocks of the last level in the merged order of all shards' blocks."""
    n, place = interleave([s.words for s in shards])
    for k in range(1, len(LEVELS)):
        step = LEVELS[k] - LEVELS[k - 1]
        lists = []
        for s, at in zip(shards, place, strict=True):
            known, first = s.blocks[k - 1], s.firsts[k]
            lists.append(at[known[first]] * (n + 1) + at[known[first + step]])
        n, place = interleave(lists)
    return place


def merged_order(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged transform: (shard, position in it, whether the window is that of the suffix before) of all suffixes in order."""
    place = refined(shards)
    orders = [s.order() for s in shards]
    rank = np.concatenate([p[s.blocks[-1][o]] for s, p, o in zip(shards, place, orders, strict=True)])
    which = np.repeat(np.arange(len(shards)), [len(o) for o in orders])
    at = np.argsort(rank, kind="stable")  # sorted runs: a merge
    rank = rank[at]
    return which[at], np.concatenate(orders)[at], np.concatenate([[False], rank[1:] == rank[:-1]])[: len(rank)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in order of their group to repeated byte ranges of those of weight one."""
    left: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if left is not None and left.num_rows:
            now = pa.concat_tables([left, now])
        left = yield from _pieces(now, False)
    if left is not None and left.num_rows:
        yield from _pieces(left, True)


def _pieces(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
    """Merge whole groups, about MERGE_BYTES at a time; returns what may be an unfinished group."""
    key = t["gram"].to_numpy()
    ends = np.flatnonzero(key[1:] != key[:-1]) + 1
    if last:
        ends = np.append(ends, len(key))
    size = np.concatenate([[0], np.cumsum(pc.binary_length(t["bytes"]).to_numpy())])
    a = 0
    while len(ends) and a < ends[-1]:
        fit = ends[(ends > a) & (size[ends] <= size[a] + MERGE_BYTES)]
        b = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, a, "right")])
        yield from _repeats(t.slice(a, b - a))
        a = b
    return t.slice(a)


def shards_of(data: np.ndarray, off: np.ndarray) -> list[tuple[int, Shard]]:
    """Shards of about SHARD_BYTES, each with the number of its first string."""
    out, a = [], 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + SHARD_BYTES, "right")) - 1)
        out.append((a, Shard.of(data[off[a] : off[b]], off[a : b + 1] - off[a])))
        a = b
    return out


def _repeats(t: pa.Table) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    data, off = strings(t["bytes"])
    weight = t["n"].to_numpy()
    numbered = shards_of(data, off)
    place = refined([s for _, s in numbered])
    interval, owner, inner = [], [], []
    for (a, s), p in zip(numbered, place, strict=True):
        o = np.searchsorted(off, s.starts + off[a], "right") - 1
        interval.append(p[s.blocks[-1][s.starts]])
        owner.append(o)
        inner.append(s.starts + off[a] - off[o])
    interval, owner, inner = (np.concatenate(x) for x in (interval, owner, inner))
    total = np.bincount(interval, weight[owner])
    hit = (total[interval] > 1) & (weight[owner] == 1)
    owner, inner = owner[hit], inner[hit]
    if not len(owner):
        return
    new = np.flatnonzero((np.diff(owner) != 0) | (np.diff(inner) != 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(owner)]]) - 1
    start = t["start"].to_numpy()[owner[first]]
    rows = pa.array(owner[first])
    yield pa.RecordBatch.from_arrays(
        [t["key"].combine_chunks().take(rows), t["salt"].combine_chunks().take(rows), pa.array((start + inner[first]).astype(np.int32)), pa.array((start + inner[last] + WINDOW).astype(np.int32))], ["key", "salt", "a", "b"]
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace text by its compressed bytes, so that texts that move between machines are small; null stays null."""
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.names.index("text")
        packed = pa.array([None if t is None else z.compress(t) for t in batch["text"].cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def _unpacked(array: pa.Array) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([b"" if t is None else z.decompress(t) for t in array.to_pylist()], pa.large_binary())


def _once(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """The first of neighbouring rows that share the columns; rows come in their order, across batches."""
    last: np.ndarray | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], 1)
        before = np.concatenate([now[:1] - 1 if last is None else last, now[:-1]])
        last = now[-1:]
        new = (now != before).any(1)
        yield batch if new.all() else batch.filter(pa.array(new))


_STRINGS = "gram long, unit long, n long, key long, salt long, start int, at short, hot boolean, bytes binary"
_STRING_NAMES = [x.split()[0] for x in _STRINGS.split(", ")]


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted strings out of their texts; of rows that share id and text and stand together, out of one."""
    for batch in _once(batches, "key", "salt"):
        if not batch.num_rows:
            continue
        data, off = strings(_unpacked(batch["text"]))
        wanted = batch["wanted"]
        flat, ends = wanted.flatten(), np.concatenate([[0], np.cumsum(np.array(pc.list_value_length(wanted)))])
        gram, unit, n, start, stop, at, hot = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
        doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        view = memoryview(data)
        for a in range(0, len(doc), 4096):
            s = slice(a, a + 4096)
            cut = [bytes(view[x:y]) for x, y in zip((off[doc[s]] + start[s]).tolist(), (off[doc[s]] + stop[s] + WINDOW - 1).tolist(), strict=True)]
            rows = pa.array(doc[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[s]), pa.array(unit[s]), pa.array(n[s]), batch["key"].take(rows), batch["salt"].take(rows), pa.array(start[s]), pa.array(at[s]), pa.array(hot[s]), pa.array(cut, pa.binary())],
                _STRING_NAMES,
            )


_HALVES = "gram long, unit long, n long, key long, salt long, start int, at short, low short, high short, bytes binary"


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string as that of its windows in which the gram starts before the middle of (low, high), and that of the others.

    The group of a half is named by the bytes that all such windows have around the gram.
    """
    names = [x.split()[0] for x in _HALVES.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for gram, n, key, salt, start, at, low, high, b in zip(*(batch[c].to_pylist() for c in ("gram", "n", "key", "salt", "start", "at", "low", "high", "bytes")), strict=True):
            middle = (low + high) // 2
            for lo, hi in ((low, middle), (middle, high)):
                first, last = max(0, at - hi + 1), min(len(b) - WINDOW, at - lo)  # windows with the gram at lo to hi - 1
                if first > last:
                    continue
                half = b[first : last + WINDOW]
                group = xxhash.xxh3_64_intdigest(b[max(0, at - lo) : at + WINDOW - hi + 1], (gram ^ (lo << 8 | hi)) & (1 << 64) - 1)
                row = (_signed(group), _signed(xxhash.xxh3_64_intdigest(half)), n, key, salt, start + first, at - first, lo, hi, half)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int16(), pa.binary()), strict=True)], names
        )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """key and salt, 128 bits that name a row by its id and text; rows that share both are copies and lose the same bytes."""
    return F.xxhash64(doc_id, text).alias("key"), F.xxhash64(F.lit(1), F.col(doc_id).isNull(), doc_id, text).alias("salt")


def _large(groups: DataFrame) -> DataFrame:
    return groups.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > SHARD).select("gram")


def _narrowed(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strings, removed): strings of groups of at most SHARD, and byte ranges of strings that became equal on the way."""
    ready, removed = None, None
    hot = hot.select("gram", "n", "key", "salt", "start", "at", F.lit(0).cast("short").alias("low"), F.lit(WINDOW - GRAM + 1).cast("short").alias("high"), "bytes")
    while True:
        halves = written(hot.mapInArrow(task(_halved), _HALVES), "suffix-halves")
        one = F.min(F.struct("key", "salt", "start", "at", "low", "high", "bytes")).alias("one")
        groups = written(halves.groupBy("gram", "unit").agg(F.sum("n").alias("n"), F.count("*").alias("met"), one).select("gram", "unit", "n", "met", "one.*"), "suffix-groups")
        equal = halves.join(groups.where("met > 1").select("gram", "unit"), ["gram", "unit"]).select("key", "salt", F.col("start").alias("a"), (F.col("start") + F.length("bytes")).alias("b"))
        removed = equal if removed is None else removed.unionByName(equal)
        large = written(_large(groups), "suffix-large")
        done = groups.join(large, "gram", "left_anti").select("gram", "n", "key", "salt", "start", "bytes")
        ready = done if ready is None else ready.unionByName(done)
        if large.isEmpty():
            return ready, removed
        hot = groups.join(large, "gram")


def ranges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, removed): the rows with their text compressed, and by key and salt the byte ranges (a, b), which may overlap.

    `rows` has key, salt, text and any other columns. Both joins with the texts deal them out alike, so Spark moves them once.
    """
    found = rows.select("key", "salt", "text").mapInArrow(task(_classed), "gram long, unit long, key long, salt long, start int, stop int, at short")
    found = written(found, "suffix-classes")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("unit").alias("u"), F.max("unit").alias("v")).where("n > 1")
    grams = written(grams.select("gram", (F.col("u") != F.col("v")).alias("mixed")), "suffix-grams")  # a table of its own, so that Spark can split the join's hot keys
    again = written(found.join(grams, "gram"), "suffix-again")
    discard(found)
    discard(grams, shuffles=True)
    span = F.col("start").alias("a"), (F.col("stop") + WINDOW - 1).alias("b")
    whole = again.where("not mixed").select("key", "salt", *span)
    mixed = again.where("mixed").drop("mixed")
    units = mixed.groupBy("gram", "unit").agg(F.count("*").alias("n"), F.min(F.struct("key", "salt", "start", "stop", "at")).alias("one"))
    units = written(units.select("gram", "unit", "n", "one.*"), "suffix-units")
    twice = mixed.join(units.where("n > 1").select("gram", "unit"), ["gram", "unit"]).select("key", "salt", *span)
    simple = written(whole.unionByName(twice), "suffix-whole")
    discard(again, shuffles=True)
    large = written(_large(units), "suffix-large").withColumn("hot", F.lit(True))
    sized = units.join(large, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = sized.groupBy("key", "salt").agg(F.collect_list(F.struct("gram", "unit", "n", "start", "stop", "at", "hot")).alias("wanted"))
    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema.fields)
    texts = rows.mapInArrow(task(_packed), fields).where("key is not null and salt is not null")
    cut = texts.join(wanted, ["key", "salt"]).mapInArrow(task(_strings), _STRINGS)
    removed = simple
    if large.isEmpty():
        ready = cut.select("gram", "n", "key", "salt", "start", "bytes")
    else:
        cut = written(cut, "suffix-strings")
        narrow, equal = _narrowed(cut.where("hot"))
        ready = cut.where("not hot").select("gram", "n", "key", "salt", "start", "bytes").unionByName(narrow)
        removed = removed.unionByName(equal)
    # A place is one string however many rows share id and text, so a group has no more strings than were counted above.
    places = ready.repartition("gram").sortWithinPartitions("gram", "key", "salt", "start")
    partly = places.mapInArrow(task(lambda batches: _merge(_once(batches, "gram", "key", "salt", "start"))), "key long, salt long, a int, b int")
    return texts, removed.unionByName(partly).groupBy("key", "salt").agg(F.collect_set(F.struct("a", "b")).alias("removed"))


def _kept(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the n bytes of a text that no range (a, b) covers."""
    depth = np.bincount(a, minlength=n + 1)[: n + 1] - np.bincount(b, minlength=n + 1)[: n + 1]
    return np.cumsum(depth[:n]) == 0


def _each(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray | None]]:
    """Text and mask of kept bytes (None: all) of each row."""
    data, off = strings(_unpacked(batch["text"]))
    removed = batch["removed"]
    size = np.array(pc.fill_null(pc.list_value_length(removed), 0))
    ends = np.cumsum(size)
    a, b = (x.to_numpy() for x in removed.flatten().flatten()) if ends[-1] else (np.zeros(0, int), np.zeros(0, int))
    for i in range(batch.num_rows):
        text = data[off[i] : off[i + 1]]
        s = slice(ends[i] - size[i], ends[i])
        yield text, (_kept(len(text), a[s], b[s]) if size[i] else None)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[list] = [[], [], [], []]
        for text, keep in _each(batch):
            gone = 0 if keep is None else int(len(text) - keep.sum())
            spans = 0 if keep is None else int((~keep[0]) + (keep[:-1] & ~keep[1:]).sum())
            for c, v in zip(out, (len(text), gone, spans, hashlib.sha256(text if keep is None else text[keep]).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, removed = ranges(documents.select(*keys(), "doc_id", "text"))
    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return texts.join(removed, ["key", "salt"], "left").mapInArrow(task(_reported), f"doc_id {doc_id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(documents: DataFrame) -> DataFrame:
    """Every row of `documents` with the repeated bytes cut out of its text; a null text stays null.

    Rows are kept even if nothing is left of their text.
    """
    names = documents.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                had = batch["text"].is_valid().to_pylist()
                new = [text.tobytes() if keep is None else text[keep].tobytes().decode("utf-8", "ignore").encode() for text, keep in _each(batch)]
                text = pa.array([t if h else None for t, h in zip(new, had, strict=True)], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([text if n == "text" else batch[_inner(n)] for n in names], names)

    rows = documents.select(*keys(), "text", *(F.col(f"`{n}`").alias(_inner(n)) for n in names if n != "text"))
    texts, removed = ranges(rows)
    return texts.join(removed, ["key", "salt"], "left").mapInArrow(task(cut), fields)


def _inner(name: str) -> str:
    """A name that clashes with none of the columns that the joins add."""
    return f"own_{name}"
