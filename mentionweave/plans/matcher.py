"""The mention matcher: raw names against a year-specific bridge, by ordered readings and then by prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, names
from ..operators.aggregates import keep_first, spread
from .nameindex import NameIndex


def tier(source: Column) -> Column:
    """Rank of a source where several rows of the bridge share name and year, and in prefix recovery."""
    return F.when(F.upper(source) == "DISCERN", 1).when(F.upper(source) == "CCM_COMPUSTAT_EXTENSION", 2).otherwise(3)


def _order() -> list[Column]:
    return [tier(F.col("source")), F.col("name_original"), F.col("cik").asc_nulls_last(), F.col("gvkey").asc_nulls_last()]


def aliases(bridge: DataFrame | NameIndex) -> DataFrame:
    """name_original, fyear, cik, gvkey, source under its standard name and, where safe, the core of it; of a bridge, or as its index has them."""
    if isinstance(bridge, NameIndex):
        listed = bridge.under("name").withColumns({"cik": ids.clean_id("cik"), "gvkey": ids.clean_id("gvkey")})
        return listed.select("kind", F.col("key").alias("name"), F.col("how").alias("alias"), "name_original", "fyear", "cik", "gvkey", "source")
    # Patterns run once for each distinct raw name; a name's rows, one for each year and identity, only join what they made.
    form = lambda name, how: F.struct(name.alias("name"), F.lit(how).alias("alias"))
    raw = F.coalesce("name_original", F.lit(""))
    forms = names.let(names.standard("__raw"), lambda n: F.array(form(n, "standard"), form(names.safe_core(n), "suffix_cleaned")))
    read = spread(bridge.select(raw.alias("__raw")).distinct(), "__raw").select("__raw", F.inline(forms)).where("(alias = 'standard' and name <> '') or (alias <> 'standard' and name is not null)")
    rows = bridge.withColumns({"cik": ids.clean_id("cik"), "gvkey": ids.clean_id("gvkey"), "__raw": raw})
    return rows.hint("merge").join(read, "__raw").drop("__raw")


def prepare_bridge(bridge: DataFrame | NameIndex) -> DataFrame:
    """One row for each (name, fyear), the first by source and then by its own values."""
    if isinstance(bridge, NameIndex):  # grouped where the index's buckets already are
        return keep_first(aliases(bridge), ["kind", "name", "fyear"], [*_order(), F.col("alias")]).drop("kind")
    return keep_first(aliases(bridge), ["name", "fyear"], [*_order(), F.col("alias")])


def bridge_conflicts(bridge: DataFrame | NameIndex) -> DataFrame:
    """(name, fyear) with more than one identity, with how many rows and identities."""
    # Rows of one identity are counted before they move, so a frequent name costs as many rows as it has identities; two of them are two rows.
    each = aliases(bridge).groupBy("name", "fyear", F.coalesce("cik", F.lit("-1")).alias("cik"), F.coalesce("gvkey", F.lit("-1")).alias("gvkey")).agg(F.count("*").alias("n"))
    return each.groupBy("name", "fyear").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_identities")).where("n_identities > 1")


def prefix_table(bridge: DataFrame | NameIndex) -> DataFrame:
    """For each (prefix, fyear) that names one identity in its best tier, that identity's best row.

    The bridge is reduced to this table before any name is joined with it, so that common first words
    do not fan out.
    """
    b = prepare_bridge(bridge).withColumns({"tier": tier(F.col("source")), "prefix": F.explode(names.prefixes("name"))})
    pair = F.struct(F.coalesce("cik", F.lit("-1")).alias("c"), F.coalesce("gvkey", F.lit("-1")).alias("g"))
    row = F.struct("name", "name_original", "source", "cik", "gvkey")
    rank = F.struct(F.col("cik").isNotNull(), F.col("gvkey").isNotNull(), F.length("name"), F.col("name"))
    tiers = b.groupBy("prefix", "fyear", "tier").agg(F.min(pair).alias("low"), F.max(pair).alias("high"), F.max_by(row, rank).alias("best"), F.count("*").alias("n"))
    best = tiers.groupBy("prefix", "fyear").agg(F.min_by(F.struct("low", "high", "best", "n"), "tier").alias("t"), F.min("tier").alias("tier"))
    rule = F.when(F.col("tier") == 1, "DISCERN_PRIORITY").when(F.col("tier") == 2, "CCM_PRIORITY").otherwise("ALL_SOURCES")
    one = best.where(F.col("t.low") == F.col("t.high")).select("prefix", "fyear", rule.alias("rule"), F.col("t.n").alias("n_candidates"), "t.best.*")
    unsafe = names.unsafe_continuation(F.col("name"), F.col("prefix"))
    globally = (F.col("rule") == "ALL_SOURCES") & (F.upper("source") == "COMPUSTAT_GLOBAL")
    return one.withColumn("unsafe", F.when(globally, F.array_join(unsafe, ";")).otherwise(""))


def _probes(bridge: DataFrame | NameIndex) -> DataFrame:
    """kind (0 names, 1 safe prefixes), key, years: for each year the row that the key stands for. A key has a row a year at most."""
    row = ["name", "name_original", "source", "cik", "gvkey"]
    named = prepare_bridge(bridge).select(F.lit(0).alias("kind"), F.col("name").alias("key"), "fyear", F.lit("").alias("rule"), *row)
    safe = prefix_table(bridge).where("unsafe = ''").select(F.lit(1).alias("kind"), F.col("prefix").alias("key"), "fyear", "rule", *row)
    dated = named.unionByName(safe).where("fyear is not null")
    return dated.groupBy("kind", "key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("fyear"), F.struct("rule", *row)))).alias("years"))


def match(mentions: DataFrame, bridge: DataFrame | NameIndex) -> DataFrame:
    """Raw, fyear, method, matched_name, matched_original, source, cik, gvkey for each distinct (raw, fyear).

    A raw name is read once and years are joined after. All its keys - readings in order, then the
    prefixes of readings in order - meet one table of names and safe prefixes in one join, and the
    first hit stays. With a kept index that table stays where its buckets are.
    """
    wanted = mentions.select("raw", "fyear").distinct()
    item = lambda kind, k, key: F.struct(F.lit(kind).alias("kind"), k.alias("k"), key.alias("key"))
    keys = lambda v: F.concat(F.array(item(0, F.lit(0), v["name"])), F.transform(names.prefixes(v["name"]), lambda p, k: item(1, k, p)))
    read = spread(mentions.select("raw").distinct(), "raw").where(names.capital("raw")).select("raw", F.posexplode(names.variants("raw")).alias("place", "v"))
    probes = read.select("raw", "place", F.col("v.method").alias("reading"), F.inline(keys(F.col("v"))))
    table = bridge.probes(lambda: _probes(bridge)) if isinstance(bridge, NameIndex) else _probes(bridge)
    asked = wanted.where("fyear is not null").join(probes, "raw").join(table, ["kind", "key"])
    dated = asked.withColumn("hit", F.try_element_at("years", F.col("fyear"))).where("hit is not null").select("raw", "fyear", "reading", "kind", "place", "k", "hit.*")
    first = keep_first(dated, ["raw", "fyear"], [F.col("kind"), F.col("place"), F.col("k")])
    exact = F.col("kind") == 0
    hits = first.select(
        F.col("raw").alias("hit_raw"),
        F.col("fyear").alias("hit_year"),
        F.when(exact, F.concat(F.lit("exact_"), "reading")).otherwise(F.concat_ws("_", F.lit("parent_prefix_recovery"), "rule", "reading")).alias("method"),
        F.col("name").alias("matched_name"),
        F.col("name_original").alias("matched_original"),
        F.when(exact, F.col("source")).otherwise(F.concat_ws("_", F.lit("parent_token_recovery"), "rule", "source")).alias("source"),
        "cik",
        "gvkey",
    )
    raw, fyear = F.col("raw"), F.col("fyear")
    why = F.when(names.strip(names.text(raw)) == "", "unmatched_empty").when(fyear.isNull(), "unmatched_missing_fyear").when(~names.capital(raw), "unmatched_invalid_or_lowercase").otherwise("unmatched_after_all_candidates")
    return wanted.join(hits, raw.eqNullSafe(F.col("hit_raw")) & fyear.eqNullSafe(F.col("hit_year")), "left").select(raw, fyear, F.coalesce("method", why).alias("method"), "matched_name", "matched_original", "source", "cik", "gvkey")


def blocked(mentions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Readings whose prefix names one global parent with an unsafe continuation."""
    # A raw name is read once; its years are joined after.
    read = spread(mentions.select("raw").distinct(), "raw").withColumn("v", F.explode(names.variants("raw")))
    probes = read.select("raw", F.col("v.method").alias("method"), F.explode(names.prefixes(F.col("v.name"))).alias("prefix"))
    tried = mentions.select("raw", "fyear").distinct().hint("merge").join(probes, "raw")
    return tried.join(prefix_table(bridge).where("unsafe <> ''"), ["prefix", "fyear"]).select("raw", "fyear", "method", "prefix", "name", "source", "unsafe")
