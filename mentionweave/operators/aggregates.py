"""Aggregates and distinct operators that keep pandas' meaning and have a defined order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import no_null_word


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out over all cores before work that costs much a row: adaptive coalescing goes by bytes, and a few MB of names are hours of patterns."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def joined_set(c: Column | str, sep: str = "|", limit: int | None = None) -> Column:
    """Distinct non-blank values, sorted, joined, the first `limit`."""
    values = F.array_sort(F.collect_set(F.nullif(no_null_word(c), F.lit(""))))
    return F.array_join(F.slice(values, 1, limit) if limit else values, sep)


def joined_in_order(c: Column | str, order: Column | str, sep: str = "; ", limit: int | None = None) -> Column:
    """Distinct non-blank values in the order in which they are first met."""
    x = F.col(c) if isinstance(c, str) else c
    seen = F.array_sort(F.collect_list(F.when(no_null_word(x) != "", F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), no_null_word(x).alias("x")))))
    values = F.array_distinct(F.transform(seen, lambda s: s["x"]))
    return F.array_join(F.slice(values, 1, limit) if limit else values, sep)


def first_nonblank(c: Column | str, order: Column | str) -> Column:
    """The first non-blank value in order, or the empty string."""
    x = no_null_word(c)
    return F.coalesce(F.min_by(F.when(x != "", x), F.when(x != "", F.col(order) if isinstance(order, str) else order)), F.lit(""))


def unique_or_blank(c: Column | str) -> Column:
    """The value if it is the only one, else the empty string."""
    x = F.nullif(no_null_word(c), F.lit(""))
    return F.when(F.min(x) == F.max(x), F.min(x)).otherwise("")


def modes(df: DataFrame, keys: list[str], value: str, sep: str = "; ") -> DataFrame:
    """All values of greatest count in each group, sorted and joined."""
    counts = df.where(no_null_word(value) != "").groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    tied = counts.join(best, [*keys, "n"])
    return tied.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), sep).alias("modes"), F.max("n").alias("n"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in a total order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs again. Keys are counted first, so only repeated keys' rows are joined."""
    again = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return df.join(again, keys)


def value_counts(df: DataFrame, c: str, label: str = "(missing)") -> DataFrame:
    """How often each value occurs, blank ones under `label`."""
    return df.groupBy(F.coalesce(F.nullif(no_null_word(c), F.lit("")), F.lit(label)).alias(c)).agg(F.count("*").alias("n"))


def status_pivot(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """One row a key with how many rows have each of the given statuses, 0 if none."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def summary(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Aggregates of the whole table as (metric, value) rows."""
    one = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])))


def identity_key(cik: Column, gvkey: Column, name: Column, valid) -> Column:
    """CIK, else GVKEY, else NAME, with its value."""
    return F.when(valid(cik), F.concat(F.lit("CIK:"), cik)).when(valid(gvkey), F.concat(F.lit("GVKEY:"), gvkey)).otherwise(F.concat(F.lit("NAME:"), name))


def stratified(df: DataFrame, stratum: str, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """at most n rows of each stratum, chosen by a hash of the key: the same rows on every run."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")
