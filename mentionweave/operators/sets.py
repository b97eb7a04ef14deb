"""Unions of drifting schemas, set operations on keys, upserts and comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import keep_first


def union_all(frames: list[DataFrame], fill: str | None = None) -> DataFrame:
    """Rows of all frames by column name; columns that one lacks are null, or `fill` in text columns."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if fill is None:
        return out
    return out.na.fill(fill, [f.name for f in out.schema.fields if f.dataType.simpleString() == "string"])


def ensure_columns(df: DataFrame, columns: list[str], default: object = "") -> DataFrame:
    """Adds the columns that are missing."""
    return df.withColumns({c: F.lit(default) for c in columns if c not in df.columns})


def resolve(df: DataFrame, names: list[str], required: bool = True) -> str | None:
    """The first of the names that the frame has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[n.lower()] for n in names if n.lower() in have), None)
    if found is None and required:
        raise ValueError(f"none of {names} is a column")
    return found


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of `a` whose key `b` does not have."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], newest: bool = True) -> DataFrame:
    """Both, one row a key: the new one, or with `newest` false the old one; `order` settles ties within one side."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    side = F.col("__new").desc() if newest else F.col("__new").asc()
    return keep_first(both, keys, [side, *order]).drop("__new")


def diff_runs(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Key, before, after, change: what became of each record between two runs."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.withColumn("change", kind)


def count_difference(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """How often each value occurs in two runs, and the difference."""
    a, b = (df.groupBy(column).agg(F.count("*").alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    both = a.join(b, column, "full").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("difference", F.col("n_after") - F.col("n_before"))


def diff_summary(changes: DataFrame, layer: str, key: str, spots: int = 3) -> DataFrame:
    """Rows of `diff_runs` by layer and change, with the first `spots` keys of each for a look."""
    counts = changes.groupBy(layer, "change").agg(F.count("*").alias("n"))
    first = changes.withColumn("__k", F.row_number().over(Window.partitionBy(layer, "change").orderBy(key))).where(F.col("__k") <= spots)
    looked = first.groupBy(layer, "change").agg(F.array_join(F.array_sort(F.collect_list(key)), ";").alias("spots"))
    return counts.join(looked, [layer, "change"])
