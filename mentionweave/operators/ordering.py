"""Positions in a global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that rows are dealt into, and values that their bounds are picked from, about.
PARTS, SAMPLE = 200, 20_000


def _literal(value: object, kind: T.DataType) -> Column:
    """A literal of any type that can be ordered, structs included."""
    if isinstance(kind, T.StructType):
        parts = [_literal(None if value is None else value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.struct(*parts) if value is not None else F.lit(None).cast(kind)
    return F.lit(value).cast(kind)


def positions(df: DataFrame, key: Column, name: str = "place", parts: int = PARTS) -> DataFrame:
    """`df` with the place of each row, from 1, in order of `key`; equal keys stand in any order, so end it with an id.

    Bounds are picked from a sample chosen by a hash of the key, the same on every run. Rows are dealt into the ranges
    between them and numbered there; a range's rows come after the counts of those before it, which are one number a range.
    Null keys come first. Where nearly all keys are equal, they are one range, as no bound parts them.
    """
    keyed = df.withColumn("__key", key)
    n = keyed.count()
    every = max(1, n // SAMPLE)
    sample: list[Row] = keyed.select("__key").where(F.pmod(F.xxhash64("__key"), F.lit(every)) == 0).distinct().orderBy("__key").collect()
    step = max(1, len(sample) // parts)
    bounds = [r["__key"] for r in sample[step::step] if r["__key"] is not None]
    kind = keyed.schema["__key"].dataType
    below = F.size(F.filter(F.array(*[_literal(b, kind) for b in bounds]), lambda b: b <= F.col("__key"))) if bounds else F.lit(0)
    dealt = keyed.withColumn("__range", F.coalesce(below, F.lit(0)))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # at most `parts` + 1 rows
    numbered = dealt.withColumn("__row", F.row_number().over(Window.partitionBy("__range").orderBy("__key")))
    placed = numbered.join(F.broadcast(before), "__range")
    return placed.withColumn(name, (F.col("__before") + F.col("__row")).cast("long")).drop("__key", "__range", "__n", "__before", "__row")
