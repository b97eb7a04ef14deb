"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) edges that isn't its component's least node.

    Each round joins the edges to per-node minima, which Spark pre-aggregates and which are a table of their own, so that
    Spark can split a node of great degree and none is a group in one task; in the second join a node has but its own
    lesser neighbours' minima. Rounds stop when the
    edges no longer change: each node then points to the least node of its component. Null ends and
    loops are dropped; an empty table gives an empty table.
    """
    a, b = F.col("a"), F.col("b")
    e = written(edges.where(a != b).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "edges-least")
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.inline(F.array(F.struct(a, F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))))
        done, e = [e, least], written(small.where(a != b).distinct(), "edges")
        for table in done:
            discard(table)
        last, mark = mark, _mark(e)
        if mark == last:
            break
    return e.select(a.alias("node"), b.alias("component"))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
