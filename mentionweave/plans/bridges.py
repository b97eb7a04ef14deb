"""Name dictionaries, reviewed alias bridges, and the diagnostics of a matching run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, names
from ..operators.aggregates import first_nonblank, joined_in_order, joined_set, keep_first, spread
from ..operators.joins import first_key
from .matcher import prepare_bridge, tier
from .nameindex import NameIndex


def dictionary(companies: DataFrame, order: Column) -> DataFrame:
    """Name, cik, gvkey under standard name, safe core and acronym; of companies that share one the last in `order`.

    `companies` has conm, cik and gvkey. A standard name comes before a core, and that before an acronym.
    """
    std = companies.withColumn("std", names.standard("conm"))
    forms = F.array(
        F.struct(F.lit(0).alias("form"), F.col("std").alias("name")),
        F.struct(F.lit(1).alias("form"), names.safe_core("std").alias("name")),
        F.struct(F.lit(2).alias("form"), names.acronym("std").alias("name")),
    )
    spread = std.withColumns({"f": F.explode(forms), "cik": ids.clean_id("cik"), "gvkey": ids.clean_id("gvkey"), "__order": order})
    spread = spread.select("f.form", "f.name", "cik", "gvkey", "__order", "conm").where("coalesce(name, '') <> ''")
    return keep_first(spread, ["name"], [F.col("form"), F.col("__order").desc(), F.col("conm")]).select("name", "cik", "gvkey", "form")


def round_trip(companies: DataFrame, found: DataFrame) -> DataFrame:
    """Companies whose own name leads to another cik or to none."""
    own = companies.select("conm", ids.clean_id("cik").alias("cik"), names.standard("conm").alias("name"))
    back = own.join(found.select("name", F.col("cik").alias("cik_from_name")), "name", "left")
    return back.where(~F.col("cik").eqNullSafe(F.col("cik_from_name"))).select("conm", "cik", "name", "cik_from_name")


def apply_alias_bridge(mentions: DataFrame, bridge: DataFrame, columns: list[str]) -> DataFrame:
    """Mentions without a valid identifier take those that a reviewer approved for their name.

    `bridge` has approved_cik, approved_gvkey and names in `columns`, the first of which counts most; keys are
    compared by letters and digits. Whether a row was changed is in alias_applied.
    """
    keyed = bridge.select("approved_cik", "approved_gvkey", *[names.alnum_key(c).alias(c) for c in columns])
    lookup = first_key(keyed, columns, [F.col("approved_gvkey").asc_nulls_last(), F.col("approved_cik").asc_nulls_last()]).select("key", "approved_cik", "approved_gvkey")
    open_row = ~ids.valid_id("cik", "staged") & ~ids.valid_id("gvkey", "staged")
    joined = mentions.withColumn("key", names.alnum_key("name")).join(lookup, "key", "left")
    applied = open_row & (ids.valid_id("approved_cik", "staged") | ids.valid_id("approved_gvkey", "staged"))
    out = joined.withColumn("alias_applied", F.coalesce(applied, F.lit(False)))
    return out.withColumns({c: F.when(F.col("alias_applied"), ids.first_valid([f"approved_{c}"], "staged")).otherwise(F.col(c)) for c in ("cik", "gvkey")}).drop("key", "approved_cik", "approved_gvkey")


def alias_review(mentions: DataFrame, order: str) -> DataFrame:
    """One row a standard name for review: how often, in which files and years, and the first raw name."""
    return mentions.groupBy("name_std").agg(
        F.count("*").alias("frequency"), joined_set("sic_file", ";").alias("sic_files"), joined_set(F.col("fyear").cast("string"), ";").alias("years"),
        joined_in_order("raw", order, " | ", 5).alias("raw_names"), first_nonblank("raw", order).alias("first_raw"),
    )


def match_diagnostics(matched: DataFrame) -> DataFrame:
    """Mentions, names and share by method. The window without a key runs over one row a method."""
    per = matched.groupBy("method").agg(F.sum("n").alias("n_mentions"), F.count_distinct("raw").alias("n_names"))
    return per.withColumn("share", F.round(F.try_divide("n_mentions", F.sum("n_mentions").over(Window.partitionBy())), 6))


def name_diagnostics(mentions: DataFrame) -> DataFrame:
    """Each raw name with its standard form, that of its parent, its safe core, and the prefixes it is tried under."""
    rows = spread(mentions.select("raw").where(F.col("raw") != "").distinct(), "raw")
    rows = rows.withColumns({"name_std": names.standard("raw"), "parent_recovered": names.standard("raw", parent=True)})
    return rows.withColumns({"name_clean": F.coalesce(names.safe_core("name_std"), "name_std"), "parent_prefixes": F.array_join(names.prefixes("name_std"), "|")})


def prefix_diagnostics(bridge: DataFrame | NameIndex) -> DataFrame:
    """For each (prefix, fyear) its candidates and identities in all sources and in the best tier, and whether each is safe."""
    b = prepare_bridge(bridge).withColumns({"tier": tier(F.col("source")), "prefix": F.explode(names.prefixes("name"))})
    b = b.withColumns({"cik": F.coalesce("cik", F.lit("-1")), "gvkey": F.coalesce("gvkey", F.lit("-1"))})
    listed = ("name", "name_original", "source", "cik", "gvkey")
    # Tiers first, so that the sets of a common prefix are merged from three rows.
    per = b.groupBy("prefix", "fyear", "tier").agg(F.count("*").alias("n"), F.collect_set(F.struct("cik", "gvkey")).alias("pairs"), *[F.collect_set(c).alias(c) for c in listed])
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    best = F.min_by(F.struct("tier", "n", "pairs", *listed), "tier").alias("best")
    out = per.groupBy("prefix", "fyear").agg(F.sum("n").alias("n"), merged("pairs").alias("pairs"), *[merged(c).alias(c) for c in listed], best)
    rule = F.when(F.col("best.tier") == 1, "DISCERN_PRIORITY").when(F.col("best.tier") == 2, "CCM_PRIORITY").otherwise("ALL_SOURCES")
    text = lambda c: F.array_join(F.array_sort(c), "|")
    return out.select(
        "prefix", "fyear", F.col("n").alias("n_candidates_all"), F.size("pairs").alias("n_identities_all"), (F.size("pairs") == 1).alias("is_safe_all"), rule.alias("priority_rule"),
        F.col("best.n").alias("n_candidates_priority"), F.size("best.pairs").alias("n_identities_priority"), (F.size("best.pairs") == 1).alias("is_safe_priority"),
        *[text(c).alias(f"{c}s_all") for c in listed], *[text(f"best.{c}").alias(f"{c}s_priority") for c in listed],
    )


def error_rates(reviews: DataFrame, stage: str, decision: str) -> DataFrame:
    """How many reviewed, and the shares approved, rejected and unclear, by stage of review."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    d = F.lower(names.no_null_word(decision))
    return reviews.where(d != "").groupBy(stage).agg(
        F.count("*").alias("n_reviewed"), share(d.startswith("approve")).alias("approved"), share(d.contains("reject")).alias("rejected"), share(d == "unclear").alias("unclear")
    )


def ticker_candidates(aliases: DataFrame, bridge: DataFrame) -> DataFrame:
    """C20, off by default: bridge rows of an alias's years whose ticker is the alias; for diagnosis, never accepted by rule."""
    wanted = aliases.select("record_id", F.upper(names.strip("alias")).alias("tic"), F.explode("years").alias("fyear")).where("tic rlike '^[A-Z]{1,5}$'")
    return wanted.join(bridge.withColumn("tic", F.upper("tic")), ["tic", "fyear"]).withColumn("rule", F.lit("ticker_year_match"))


def prefix_candidates(aliases: DataFrame, bridge: DataFrame) -> DataFrame:
    """C20, off by default: rows of the prefix table (C07) for the alias's name itself, in its years."""
    from .matcher import prefix_table

    wanted = aliases.select("record_id", names.standard("alias").alias("prefix"), F.explode("years").alias("fyear")).where("prefix <> ''")
    return wanted.join(prefix_table(bridge), ["prefix", "fyear"]).where("unsafe = ''").select("record_id", "fyear", "name", "source", "cik", "gvkey", F.lit("parent_prefix_recovery").alias("rule_found"))
