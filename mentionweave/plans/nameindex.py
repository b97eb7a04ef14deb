"""The kept name index: each raw name of a bridge is normalised once, and its rows are found under any of their keys without a shuffle of theirs.

A row of the index is a row of the bridge under one key of its name. The kinds of key, and what `name` holds beside:

    row        a digest of the bridge's row, by which later runs tell what is new
    name       standard name, and its safe core where there is one; `how` says which
    candidate  the candidate stages' name
    legal      that without legal terms (`name` is the candidate name)
    exact      the recovery stages' name
    core       that without legal forms (`name` is the exact one)

The index is bucketed by (kind, key), so consumers that join or group on both read it in place, and only their own names move. A later run adds
the rows that are new by an anti-join on their digests, and works patterns out for the raw names among those alone. The matcher's
table of names and safe prefixes (`probes`) is kept the same way and made anew after rows were added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators.aggregates import spread
from ..sources import kept

BRIDGE = ("name_original", "fyear", "cik", "gvkey", "source")
_SCHEMA = "kind string, key string, name string, how string, name_original string, fyear int, cik string, gvkey string, source string"
GROUPS = {"match": ("name",), "cascade": ("candidate", "legal"), "recovery": ("exact", "core")}


def _entry(kind: str, key: Column, name: Column, how: str = "") -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), name.alias("name"), F.lit(how).alias("how"))


def keys_of(c: str, groups: tuple[str, ...]) -> Column:
    """array(struct(kind, key, name, how)) of a raw name; keys that are empty or absent are left out."""
    found = []
    if "match" in groups:
        found.append(names.let(names.standard(c), lambda n: F.array(_entry("name", n, n, "standard"), _entry("name", names.safe_core(n), n, "suffix_cleaned"))))
    if "cascade" in groups:
        found.append(names.let(names.candidate_name(c), lambda n: F.array(_entry("candidate", n, n), _entry("legal", names.without_legal_terms(n), n))))
    if "recovery" in groups:
        found.append(names.let(names.recovery_name(c), lambda n: F.array(_entry("exact", n, n), _entry("core", names.canonical(n), n))))
    return F.filter(F.concat(*found), lambda x: F.coalesce(x["key"] != "", F.lit(False)))


class NameIndex:
    """The index of a bridge (name_original, fyear, cik, gvkey, source) at a path, new or as an earlier run left it."""

    def __init__(self, spark: SparkSession, path: str | None = None, groups: tuple[str, ...] = tuple(GROUPS), buckets: int | None = None) -> None:
        self.spark, self.groups = spark, groups
        self.path = path or kept.fresh(spark, "name-index")
        self.table = kept.Bucketed(spark, f"{self.path}/{'-'.join(groups)}", _SCHEMA, ("kind", "key"), buckets)
        self._probes: kept.Bucketed | None = None

    def extend(self, bridge: DataFrame) -> NameIndex:
        """With the rows of `bridge` that are not there yet. Rows that are there are left alone."""
        digest = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in BRIDGE])), 256)
        rows = bridge.select(*BRIDGE).distinct().withColumn("key", digest)
        new = kept.written(rows.join(self.under("row").select("key"), "key", "left_anti"), "new-names")
        if new.isEmpty():
            return self
        raw = F.coalesce("name_original", F.lit(""))
        keyed = spread(new.select(raw.alias("raw")).distinct(), "raw").withColumn("keys", keys_of("raw", self.groups))
        # Of the outer kind, as from the plain one Spark infers a filter, for which it would work patterns out for every row of the bridge.
        named = new.withColumn("raw", raw).hint("merge").join(keyed, "raw").select(F.inline_outer("keys"), *BRIDGE).where("kind is not null")
        own = new.select(F.lit("row").alias("kind"), "key", F.lit("").alias("name"), F.lit("").alias("how"), *BRIDGE)
        self.table.add(named.unionByName(own))
        self._probes = None
        return self

    def under(self, *kinds: str) -> DataFrame:
        """The rows with keys of some kinds."""
        wanted = {k for g in self.groups for k in GROUPS[g]} | {"row"}
        if not set(kinds) <= wanted:
            raise ValueError(f"the index at {self.path} has keys of {sorted(wanted)}, not of {sorted(set(kinds) - wanted)}")
        return self.table.rows().where(F.col("kind").isin(*kinds))

    def probes(self, make) -> DataFrame:
        """The table of `make()`, (kind, key, years), kept until rows are added."""
        if self._probes is None:
            made = make()
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
            self._probes = kept.Bucketed(self.spark, kept.fresh(self.spark, "probes"), schema, ("kind", "key"), self.table.buckets)
            self._probes.add(made)
        return self._probes.rows()


def kept_index(bridge: DataFrame, *groups: str) -> NameIndex:
    """The index of a bridge for one run."""
    return NameIndex(bridge.sparkSession, groups=groups or tuple(GROUPS)).extend(bridge)
