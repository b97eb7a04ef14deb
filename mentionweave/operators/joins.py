"""Joins that the engine needs beside the plain ones. None is a theta join: every one is an equality of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import keep_first


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that raises in the task that meets a second row of a key on the right side."""
    counts = right.groupBy(*keys).agg(F.count("*").alias("__n"))
    guarded = right.join(counts, keys).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error("a key occurs twice on the right side").cast("boolean")).otherwise(True))
    return left.join(guarded.where("__ok").drop("__n", "__ok"), keys, "left")


#: Rows of one key that one side of a cell holds at most, and pairs that one task makes, about.
CELL, PAIRS = 4096, 20_000_000


def in_cells(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """left join right on left[a] = right[b], whose pairs are dealt over tasks by their number.

    Keys' rows are few bytes and their pairs many, so a key that is frequent on both sides is one long task that Spark, which goes by bytes,
    does not split. Each side's rows of a key are dealt into cells of about `CELL` rows
    by a hash of the row (equal rows share a cell), and each row is repeated for the other side's cells.
    """
    n = left.groupBy(F.col(a).alias("__k")).agg(F.count("*").alias("__l")).join(right.groupBy(F.col(b).alias("__k")).agg(F.count("*").alias("__r")).hint("merge"), "__k")
    cells = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    n = n.select("__k", (F.col("__l").cast("double") * F.col("__r")).alias("__pairs"), cells("__l").alias("__nl"), cells("__r").alias("__nr"))
    pairs = n.agg(F.sum("__pairs")).first()[0] or 0.0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.sparkSession.sparkContext.defaultParallelism, int(pairs / PAIRS) + 1)

    def dealt(df: DataFrame, side: str, key: str, own: str, other: str) -> DataFrame:
        mine, theirs = ("__i", "__j") if side == "x" else ("__j", "__i")
        counted = n.select(F.col("__k").alias(f"{side}__k"), F.col(own).alias(f"{side}__own"), F.col(other).alias(f"{side}__other"))
        met = df.withColumns({f"{side}__k": F.col(key), f"{side}__h": F.xxhash64(*df.columns)}).hint("merge").join(counted, f"{side}__k")
        cell = met.withColumn(side + mine, F.pmod(f"{side}__h", f"{side}__own").cast("int")).withColumn(side + theirs, F.explode(F.sequence(F.lit(0), F.col(f"{side}__other") - 1)))
        return cell.drop(f"{side}__h", f"{side}__own", f"{side}__other").repartition(tasks, f"{side}__k", f"{side}__i", f"{side}__j")

    x, y = dealt(left, "x", a, "__nl", "__nr"), dealt(right, "y", b, "__nr", "__nl")
    at = ("__k", "__i", "__j")
    same = (F.col("x__k") == F.col("y__k")) & (F.col("x__i") == F.col("y__i")) & (F.col("x__j") == F.col("y__j"))
    return x.hint("merge").join(y, same).drop(*[f"x{c}" for c in at], *[f"y{c}" for c in at])


def either_key(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """C11: rows that agree in any of (left column, right column, rule), one row for each, by one equality join each."""
    hits = [in_cells(left.where(F.col(a) != ""), right, a, b).withColumn("rule", F.lit(rule)) for a, b, rule in pairs]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out


def first_probe(rows: DataFrame, key: str, probes: Column, table: DataFrame, on: list[str]) -> DataFrame:
    """For each row the first of its ordered probes (structs that hold the columns `on`) that the table has."""
    spread = rows.select(key, F.posexplode(probes).alias("at", "probe")).select(key, "at", "probe.*")
    return keep_first(spread.join(table, on), [key], [F.col("at")])


def nearest_year(aliases: DataFrame, bridge: DataFrame, name: str = "name", year: str = "fyear", years: str = "years") -> DataFrame:
    """Bridge identities that share the name but none of the alias's years, with the least distance in years."""
    from ..functions.ids import year_distance

    other = [c for c in bridge.columns if c != year]
    spans = bridge.groupBy(*other).agg(F.array_sort(F.collect_set(year)).alias("bridge_years"))
    met = aliases.join(spans, name)
    apart = ~F.coalesce(F.arrays_overlap("bridge_years", years), F.lit(False)) & (F.size(years) > 0)
    return met.where(apart).withColumn("distance", year_distance(F.col("bridge_years"), F.col(years)))


def in_panel(rows: DataFrame, key: str, panel: DataFrame, ids: list[str], years: str = "years", year: str = "fyear") -> DataFrame:
    """Key and valid_years of rows of which one identifier is in the panel in one of their years."""
    spread = rows.select(key, *ids, F.explode(years).alias(year))
    hits = [spread.where(F.col(i).isNotNull()).join(panel.select(i, year).distinct(), [i, year], "left_semi").select(key, year) for i in ids]
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    return every.groupBy(key).agg(F.array_sort(F.collect_set(year)).alias("valid_years"))


def complete(population: DataFrame, found: DataFrame, keys: list[str], blanks: list[str]) -> DataFrame:
    """Every row of the population, with blanks where nothing was found."""
    return population.join(found, keys, "left").na.fill("", blanks)


def by_priority(rows: DataFrame, sources: list[tuple[str, DataFrame, list[str], str]], target: str, missing: str = "-88888") -> DataFrame:
    """The first source (label, table, keys, column) that has a value gives `target`; `<target>_source` says which.

    Each table must have one row a key at most.
    """
    out, found = rows, []
    for n, (label, table, keys, column) in enumerate(sources):
        out = out.join(table.select(*keys, F.col(column).alias(f"__{n}")), keys, "left")
        found.append((label, F.nullif(F.col(f"__{n}"), F.lit(""))))
    value = F.coalesce(*[c for _, c in found], F.lit(missing))
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(label)) for label, c in found], F.lit("missing"))
    return out.withColumns({target: value, f"{target}_source": source}).drop(*[f"__{n}" for n in range(len(sources))])


def unique_crosswalk(table: DataFrame, key: str, value: str) -> DataFrame:
    """C14: key and value for keys with exactly one distinct value."""
    return table.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__max")).where(F.col(value) == F.col("__max")).drop("__max")


def without_self(rows: DataFrame, focal: DataFrame, keys: list[str], tests: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows that agree with their focal row in any of (own column, focal column), blanks aside, are removed."""
    joined = rows.join(focal, keys, "left")
    same = F.lit(False)
    for a, b in tests:
        same = same | F.coalesce((F.col(a) == F.col(b)) & (F.col(a) != ""), F.lit(False))
    marked = joined.withColumn("__self", same)
    return marked.where("not __self").select(*rows.columns), marked.where("__self").select(*rows.columns)


def first_key(table: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """The table under every non-blank value of the columns; of rows under one key the first in order, then by column."""
    keys = F.array(*[F.struct(F.lit(n).alias("at"), F.col(c).alias("key")) for n, c in enumerate(columns)])
    spread = table.withColumn("__k", F.explode(keys)).withColumns({"key": F.col("__k.key"), "__at": F.col("__k.at")}).where("coalesce(key, '') <> ''")
    return keep_first(spread, ["key"], [*order, F.col("__at")]).drop("__k", "__at")
