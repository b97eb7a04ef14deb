"""URL filters by a Bloom filter cascade over the corpus's complete key universe.

A key is a host suffix at a label boundary with a path prefix, of the lengths that rule paths have.
The first level holds the listed keys; the second the keys of the corpus that the first takes for
listed by mistake; the third the listed keys that the second takes for such; and so on until no
mistake is left. For any key of the corpus the number of levels it passes tells exactly whether it is
listed, without a join. Of the listed keys of a url the longest names its rule.

Size: with n listed keys among U keys of the corpus, the first level's error rate is n / U, so that
about n keys err; both are bounded by the rule list (`MAX_ERRORS` times it is checked, else the level
is built anew under another salt), while the universe is only counted and tested where it lies.

Defined results: a null url or one without `://` has an empty host and path and no rule; a url that
no rule fits gets `DEFAULT`; a rule list may be empty; repeated rows are judged row by row; rules
that name the same host and path twice take the last verdict; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import task

#: The verdict of the cascade on a url without a listed key: it is on no list.
DEFAULT = "allow"
MAX_ERRORS = 16
#: (host, path, verdict). Fixed values.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass
class Bloom:
    bits: np.ndarray
    hashes: int
    salt: int

    @classmethod
    def of(cls, keys: Iterable[str], n: int, rate: float, salt: int) -> Bloom:
        rate = min(0.5, max(rate, 1e-9))
        m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        f = cls(np.zeros((m + 7) // 8, np.uint8), max(1, round(-math.log2(rate))), salt)
        for k in keys:
            for at in f._places(k):
                f.bits[at >> 3] |= np.uint8(1 << (at & 7))
        return f

    def _places(self, key: str) -> Iterator[int]:
        h = xxhash.xxh3_128_intdigest(key, self.salt)
        a, b, m = h >> 64, (h & 0xFFFFFFFFFFFFFFFF) | 1, 8 * len(self.bits)
        return ((a + i * b) % m for i in range(self.hashes))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._places(key))


@dataclass
class Cascade:
    levels: list[Bloom]

    def __contains__(self, key: str) -> bool:
        """Exact for every key of the universe that it was built over."""
        depth = 0
        for level in self.levels:
            if key not in level:
                break
            depth += 1
        return depth % 2 == 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path of a url; both empty for null or without `://`."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(host: str, path: str, lengths: tuple[int, ...], labels: int) -> list[tuple[str, str]]:
    """Candidate (host, path) rules of a url, the longest first; of equal ones the longer host.

    Suffixes of a host are told apart by their labels and a path begins with `/`, so host and path
    run together stay one key; an empty path or host has none.
    """
    parts = host.split(".") if host else []
    out = []
    for n in range(min(labels, len(parts)), 0, -1):
        suffix = ".".join(parts[-n:])
        out += [(suffix, path[:k]) for k in lengths if k <= len(path)]
    return sorted(out, key=lambda x: -len(x[0]) - len(x[1]))


def _rules(rules: Iterable[tuple[str, str, str]]) -> tuple[dict[str, str], tuple[int, ...], int]:
    listed = {h.lower() + p: v for h, p, v in rules}
    lengths = tuple(sorted({len(p) for _, p, _ in rules}, reverse=True))
    return listed, lengths, max((h.count(".") + 1 for h, _, _ in rules), default=0)


def build(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> Cascade:
    """Build the cascade of `rules` over all candidate keys of the urls of `pages`."""
    rules = tuple(rules)
    listed, lengths, labels = _rules(rules)
    if not listed:
        return Cascade([])
    host, path = host_and_path(F.col("url"))
    longest = max(lengths)
    stems = pages.select(host.alias("host"), F.substring(path, 1, longest).alias("path")).distinct()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {h + p for hs, ps in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True) for h, p in keys_of(hs, ps, lengths, labels)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], ["key"])

    universe = stems.mapInArrow(task(explode), "key string").distinct()
    size = max(len(listed), universe.agg(F.approx_count_distinct("key")).first()[0])
    salt = 0
    while True:
        first = Bloom.of(listed, len(listed), len(listed) / size / 2, salt)
        shared = pages.sparkSession.sparkContext.broadcast((first, frozenset(listed)))

        def erring(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            level, known = shared.value
            for batch in batches:
                hits = [k for k in batch["key"].to_pylist() if k not in known and k in level]
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string())], ["key"])

        bound = MAX_ERRORS * (len(listed) + 1)
        errors = [r.key for r in universe.mapInArrow(task(erring), "key string").limit(bound + 1).collect()]
        if len(errors) <= bound:
            break
        salt += 1000  # rarer than one time in a million; none is dropped
        size *= 2
    levels, inside, outside = [first], set(listed), set(errors)
    while outside:
        salt += 1
        levels.append(Bloom.of(sorted(outside), len(outside), 0.5, salt))
        inside, outside = outside, {k for k in inside if k in levels[-1]}
    return Cascade(levels)


def judge(pages: DataFrame, cascade: Cascade, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    listed, lengths, labels = _rules(tuple(rules))
    host, path = host_and_path(F.col("url"))
    shared = pages.sparkSession.sparkContext.broadcast((cascade, listed))  # of the rule list's size

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, verdicts = shared.value
        known: dict[str, bool] = {}
        for batch in batches:
            rule, verdict = [], []
            for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True):
                found = None
                for a, b in keys_of(h, p, lengths, labels):
                    k = a + b
                    hit = known.get(k)
                    if hit is None:
                        if len(known) > 100_000:
                            known.clear()
                        hit = known[k] = k in filters
                    if hit:
                        found = k
                        break
                rule.append(found)
                verdict.append(verdicts.get(found, DEFAULT))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(task(judged), "page_id long, host string, path string, rule string, verdict string")
