"""Candidates for aliases from year bridges, identifier bridges and outside lists, with scores by rule and source.

Aliases have record_id, alias and years (an array). A bridge has candidate, fyear (a year bridge alone), cik, gvkey,
source; an outside list has candidate, cik, gvkey, source. Names meet by equality of their recovery names (exact) or of
those without legal forms (legal), so that every join is a hash or merge join on one key. Both keys begin with the same word, which
one cheap pattern finds in nearly any raw name, so a list is first reduced to the names whose first word an alias has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import ids, names
from ..operators.aggregates import keep_first, spread
from ..sources.kept import written
from .nameindex import NameIndex

_KEPT = ["record_id", "alias", "years", "exact", "legal", "source", "candidate", "gvkey", "cik"]


def keyed(rows: DataFrame, name: str, exact: str = "exact", legal: str = "legal") -> DataFrame:
    """`rows` with the two keys of a name."""
    return rows.withColumn(exact, names.recovery_name(name)).withColumn(legal, names.canonical(exact))


def sharing_first_word(listed: DataFrame, aliases: DataFrame, first=names.recovery_first_word, name: str = "candidate", alias: str = "alias") -> DataFrame:
    """The rows of `listed` whose name begins with the word that some alias's begins with; no other can meet one.

    A semi-join, so that a word that many names begin with is in one task as often as Spark likes, and the list's patterns run after it.
    """
    wanted = aliases.select(first(alias).alias("__first")).where("__first <> ''").distinct()
    return listed.withColumn("__first", first(name)).join(wanted, "__first", "left_semi").drop("__first")


def meets(aliases: DataFrame, listed: DataFrame | NameIndex, once: str | None = None) -> DataFrame:
    """Keyed aliases with what is listed under either key: the alias's columns, the list's, and kind (exact or legal).

    A year bridge's kept index is read where its buckets are; it has no b_legal for exact hits, which are told by their kind.
    Both sides grow with the data, and a small file of short columns may hold millions of names, so a size taken from the file must
    not make the driver collect one of them: the joins are merge joins, which Spark splits where a key is hot. With `once`, aliases
    that share that column and a key ask under it once, as the first of them.
    """
    if isinstance(listed, NameIndex):
        probe = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"))
        asked = aliases.select("*", F.inline(F.array(probe("exact", "exact"), probe("core", "legal")))).where("key <> ''")
        rows = listed.under("exact", "core").withColumnsRenamed({"name_original": "candidate", "name": "b_exact"}).drop("how")
        core = F.col("kind") == "core"
        return asked.hint("merge").join(rows, ["kind", "key"]).withColumns({"b_legal": F.when(core, F.col("key")), "kind": F.when(core, "legal").otherwise("exact")}).drop("key")
    right = keyed(sharing_first_word(listed, aliases), "candidate", "b_exact", "b_legal")
    asked = {k: aliases if once is None else keep_first(aliases, [once, k], [F.col(c) for c in aliases.columns]) for k in ("exact", "legal")}
    hits = [asked[k].hint("merge").join(right, (asked[k][k] == right[f"b_{k}"]) & (asked[k][k] != "")).withColumn("kind", F.lit(k)) for k in ("exact", "legal")]
    return hits[0].unionByName(hits[1])


def valid_in_years(hits: DataFrame, panel: DataFrame) -> DataFrame:
    """The hits of which an identifier is in the panel (cik, gvkey, fyear) in one of the alias's years."""
    spread = hits.distinct().withColumn("fyear", F.explode("years"))
    seen = [spread.where(ids.valid_id(i, "recovery")).join(panel.select(i, "fyear").distinct().hint("merge"), [i, "fyear"], "left_semi") for i in ("gvkey", "cik")]
    return seen[0].unionByName(seen[1]).drop("fyear").distinct()


def category_flags(name: Column | str) -> Column:
    """H22 of the rescue stage: struct(category, lower_category, company_signal) of a name."""
    words = names.tokens(names.recovery_name(name))
    among = lambda terms: F.size(words) == F.size(F.filter(words, lambda t: F.array_contains(names.words(terms), t)))
    ending = F.coalesce(F.try_element_at(words, F.lit(-1)).isin(*V.CATEGORY_ENDINGS), F.lit(False))
    letter = F.regexp_extract(names.text(name), r"\p{L}", 0)
    lower = (letter == "") | ((letter == F.lower(letter)) & (letter != F.upper(letter)))
    own = F.exists(words, lambda t: ~F.array_contains(names.words([*V.CATEGORY_TERMS, *V.RESCUE_SUFFIXES]), t))
    return F.struct(
        ((F.size(words) == 0) | ((F.size(words) <= 2) & among(V.CATEGORY_TERMS)) | ending).alias("category"),
        (lower & (F.size(words) > 0) & (ending | among(V.CATEGORY_TERMS))).alias("lower_category"),
        (F.arrays_overlap(words, names.words(V.COMPANY_SIGNALS)) & own).alias("company_signal"),
    )


def _scored(column: str, scores: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(names.lookup(scores), F.col(column)), F.lit(0))


def _public() -> Column:
    return ids.valid_id("gvkey", "recovery") | ids.valid_id("cik", "recovery")


def _no_ids(status: str, verified: str) -> dict[str, Column]:
    """Identifiers, and those of a verified company without any."""
    return {c: F.when(F.col(status) == verified, "-99999").otherwise(F.when(ids.valid_id(c, "recovery"), ids.clean_id(c)).otherwise("")) for c in ("gvkey", "cik")}


_LAST = ("source", "candidate", "gvkey", "cik", "rule")  # ends every order, so that none depends on that of the input


#: Pairs of records' requests and listed names that one task takes of a name, about, and records that one request is worked out for at once.
PAIRS, TOGETHER = 2_000_000, 16


def _once(rows: DataFrame, name: str, exact: str, legal: str) -> DataFrame:
    """`rows` with the two keys of a name and `group`, under which all meets that can: names are read once each, and left out if they have no key."""
    named = keyed(spread(rows.select(name).distinct(), name), name, exact, legal)
    group = F.when(F.col(legal) != "", F.col(legal)).otherwise(F.concat(F.lit("="), F.col(exact)))
    # Written, as a filter on keys would be moved below the distinct names.
    named = written(named.withColumn("group", group), "names-keyed").where(F.col(exact) != "")
    return rows.hint("merge").join(named.hint("merge"), name)


def listed_once(aliases: DataFrame, year_bridge: DataFrame | NameIndex, id_bridge: DataFrame, panel: DataFrame, outside: DataFrame, year_source: Column, id_source: Column) -> DataFrame:
    """Every identity (candidate, source, gvkey, cik) of the three lists once, with its keys, its `group` and `seen`, the years in which the bridge or the panel has it.

    `list` is year, id or out. Whether an identity counts for a record is told by its `seen` alone, so that no pair is made to find it out. The
    identifiers that results show are in `ids`, and `has_gvkey` and `has_cik` say which are valid. The table is written, as it is read more than once.
    """
    own = ["candidate", "source", "gvkey", "cik"]
    years = lambda: F.array_sort(F.collect_set(F.struct(F.col("fyear").cast("long").alias("fyear")))).alias("seen")
    none = F.array().cast("array<struct<fyear:bigint>>")
    if isinstance(year_bridge, NameIndex):
        dated = year_bridge.under("exact").withColumnRenamed("name_original", "candidate")
    else:
        dated = sharing_first_word(year_bridge, aliases)
    dated = dated.withColumn("source", year_source).groupBy(*own).agg(years()).withColumn("list", F.lit("year"))
    valid = sharing_first_word(id_bridge, aliases).withColumn("source", id_source).select(*own).distinct()
    for i in ("gvkey", "cik"):
        of = panel.where(ids.valid_id(i, "recovery")).groupBy(i).agg(years().alias(f"__{i}"))
        valid = valid.hint("merge").join(of.hint("merge"), i, "left")
    seen = F.array_sort(F.array_union(F.coalesce("__gvkey", none), F.coalesce("__cik", none)))
    valid = valid.select(*own, seen.alias("seen"), F.lit("id").alias("list")).where(F.size("seen") > 0)
    listed = sharing_first_word(outside, aliases).select(*own).distinct().select(*own, none.alias("seen"), F.lit("out").alias("list"))
    every = written(dated.unionByName(valid).unionByName(listed), "listed")
    shown = {f"has_{i}": ids.valid_id(i, "recovery") for i in ("gvkey", "cik")}
    every = _once(every, "candidate", "b_exact", "b_legal").withColumns(shown)
    # Of a verified company without any identifier both read -99999; which lists and sources those are is the stage's, so it is told there.
    clean = lambda i: F.when(F.col(f"has_{i}"), ids.clean_id(i)).otherwise("").alias(i)
    return written(every.withColumn("ids", F.struct(clean("gvkey"), clean("cik"))), "listed-once")


def _seen(years: str = "years") -> tuple[Column, Column]:
    """Whether an identity is seen in one of a record's years, and out of them."""
    inside = lambda y: F.coalesce(F.array_contains(years, y["fyear"]), F.lit(False))
    return F.exists("seen", inside), F.exists("seen", lambda y: ~inside(y))


def _kinds() -> Column:
    """How a record and an identity of one group meet: exact, legal or both."""
    kinds = F.array(F.when(F.col("exact") == F.col("b_exact"), "exact"), F.when((F.col("legal") != "") & (F.col("legal") == F.col("b_legal")), "legal"))
    return F.filter(kinds, lambda k: k.isNotNull())


def _cells(units: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with `cell`: a group of more than PAIRS pairs is dealt over several, each with some of the units and the whole list."""
    n = lambda df, name: df.groupBy("group").agg(F.count("*").alias(name)).hint("merge")
    heavy = n(units, "__u").join(n(listed, "__l"), "group").withColumn("__cells", F.least(F.ceil(F.col("__u") * F.col("__l") / PAIRS), F.col("__u")).cast("int")).where("__cells > 1")
    heavy = written(heavy.select("group", "__cells"), "groups-heavy")
    if heavy.isEmpty():
        return units.withColumn("cell", F.lit(0)), listed.withColumn("cell", F.lit(0))
    of = F.coalesce("__cells", F.lit(1))
    units = units.join(heavy.hint("merge"), "group", "left").withColumn("cell", F.pmod(F.xxhash64("unit", "alias", "years"), of).cast("int")).drop("__cells")
    return units, listed.join(heavy.hint("merge"), "group", "left").withColumn("cell", F.explode(F.sequence(F.lit(0), of - 1))).drop("__cells")


def _rescued(units: DataFrame, listed: DataFrame) -> DataFrame:
    """The candidates of units (unit, records, alias, years, exact, legal, group), by joins on group and cell."""
    units, listed = _cells(units, listed)
    met = units.hint("merge").join(listed.hint("merge"), ["group", "cell"])
    year, out = F.col("list") == "year", F.col("list") == "out"
    met = met.where(out | _seen()[0]).withColumn("kind", F.explode(_kinds())).where(~year | (F.col("kind") == "exact") | (F.col("b_exact") != F.col("b_legal")))
    rule = (
        F.when(year, F.concat("kind", F.lit("_year_specific"))).when(out, F.concat(F.lower("source"), F.lit("_"), "kind", F.when(F.col("source") == "CAPITAL_IQ", "_company_name").otherwise("_name")))
        .otherwise(F.concat(F.lit("identifier_"), "kind", F.lit("_validated")))
    )
    return met.withColumn("rule", rule).withColumn("rank_score", F.col("base") + F.when(F.col("kind") == "exact", F.col("exact_score")).otherwise(F.col("legal_score")))


def rescue(dropped: DataFrame, year_bridge: DataFrame | NameIndex, id_bridge: DataFrame, panel: DataFrame, outside: DataFrame) -> DataFrame:
    """Ranked candidates of aliases that were dropped as generic, with what they amount to and the names' category flags.

    A year bridge counts in the alias's years alone, an identifier bridge where its identifiers are in the panel in
    one of them. Candidates of an outside list without an identifier show that the company exists.

    The result grows with the product of a name's records and identities, so pairs are neither moved nor kept: records and lists are dealt by the name
    without legal forms, and meet, are ranked and are copied to the records of one alias and years (TOGETHER at a time) where they met.
    """
    listed = listed_once(dropped, year_bridge, id_bridge, panel, outside, F.coalesce("source", F.lit("YEAR_SPECIFIC_BRIDGE")), F.coalesce("source", F.lit("IDENTIFIER_LEVEL_BRIDGE")))
    public, out = F.col("has_gvkey") | F.col("has_cik"), F.col("list") == "out"
    status = F.when(public, "rescue_identifier_backed_exact").when(out & F.col("source").isNotNull(), "rescue_verified_company_no_public_id").otherwise("not_rescued_no_usable_identifier")
    base = _scored("source", V.RESCUE_SOURCE_SCORE) + F.when(F.col("has_gvkey"), 20).otherwise(0) + F.when(F.col("has_cik"), 10).otherwise(0)
    verified = F.col("rescue_status") == "rescue_verified_company_no_public_id"
    shown = {i: F.when(verified, "-99999").otherwise(F.col(f"ids.{i}")) for i in ("gvkey", "cik")}
    rule = lambda k: F.when(F.col("list") == "year", f"{k}_year_specific").when(F.col("list") == "id", f"identifier_{k}_validated").otherwise(F.concat(F.lower("source"), F.lit(f"_{k}"), F.when(F.col("source") == "CAPITAL_IQ", "_company_name").otherwise("_name")))
    scores = {f"{k}_score": F.coalesce(F.try_element_at(names.lookup(V.RESCUE_RULE_SCORE), rule(k)), F.lit(0)) for k in ("exact", "legal")}
    listed = listed.withColumns({"rescue_status": status, "base": base, **scores}).withColumns(shown)
    listed = written(listed.select("group", "list", "b_exact", "b_legal", "source", "candidate", "seen", "gvkey", "cik", "rescue_status", "base", "exact_score", "legal_score"), "rescue-listed")

    asked = dropped.select("record_id", "alias", "years").distinct().withColumn("__n", F.count("*").over(Window.partitionBy("record_id")))
    asked = written(_once(asked, "alias", "exact", "legal"), "rescue-asked")
    request = ["alias", "years", "exact", "legal", "group"]
    place = F.row_number().over(Window.partitionBy(*request).orderBy("record_id"))
    sole = asked.where("__n = 1").withColumn("__chunk", F.floor((place - 1) / TOGETHER)).groupBy(*request, "__chunk").agg(F.min("record_id").alias("unit"), F.collect_list(F.struct("record_id")).alias("records")).drop("__chunk")
    last = [F.desc("rank_score"), *map(F.asc, _LAST)]
    keep = ["alias", "source", "candidate", "gvkey", "cik", "kind", "rule", "rescue_status", "rank_score", "candidate_rank"]
    ranked = _rescued(written(sole, "rescue-units"), listed).withColumn("candidate_rank", F.row_number().over(Window.partitionBy("group", "cell", "unit").orderBy(*last)))
    found = ranked.select(F.inline("records"), *keep)
    several = asked.where("__n > 1")
    if not several.isEmpty():
        # A record of several aliases may have candidates under several names: they are ranked by record.
        units = written(several.select(F.col("record_id").alias("unit"), *request), "rescue-several")
        raw = listed.withColumn("__row", F.monotonically_increasing_id())
        met = _rescued(units, written(raw, "rescue-rows")).dropDuplicates(["unit", "alias", "__row", "rule"])
        more = met.withColumn("candidate_rank", F.row_number().over(Window.partitionBy("unit").orderBy(*last))).withColumnRenamed("unit", "record_id")
        found = found.unionByName(more.select("record_id", *keep))
    return found.withColumn("flags", category_flags("alias"))


def generic_like(name: Column | str) -> Column:
    """H22 of the residual stage: no word, at most two and all generic or legal, or a single generic one."""
    words = names.tokens(names.recovery_name(name))
    known = F.filter(words, lambda t: F.array_contains(names.words([*V.RESIDUAL_GENERIC, *V.RECOVERY_SUFFIXES]), t))
    return (F.size(words) == 0) | ((F.size(words) <= 2) & (F.size(known) == F.size(words)))


def residual(aliases: DataFrame, year_bridge: DataFrame, id_bridge: DataFrame, panel: DataFrame, outside: DataFrame) -> DataFrame:
    """Ranked candidates of unresolved aliases: in and out of their years, by validated identifiers, and from outside lists."""
    a = keyed(aliases, "alias").where("exact <> ''")
    at = lambda exact, legal: F.when(F.col("kind") == "exact", exact).otherwise(legal)
    dated = meets(a, year_bridge).withColumn("inside", F.coalesce(F.array_contains("years", F.col("fyear")), F.lit(False)))
    dated = dated.withColumns({
        "rule": F.concat("kind", F.when(F.col("inside"), "_year_specific").otherwise("_other_year")), "score": F.when(F.col("inside"), at(100, 90)).otherwise(at(80, 70)),
        "source": F.coalesce("source", F.lit("YEAR_BRIDGE")),
    })
    valid = valid_in_years(meets(a, id_bridge).select(*_KEPT, "kind"), panel).withColumns({"rule": F.format_string("identifier_%s_validated", "kind"), "score": at(65, 60), "source": F.lit("WRDS_LOOKUP")})
    listed = meets(a, outside).withColumns({"rule": F.concat(F.lower("source"), F.lit("_"), "kind", F.lit("_name")), "score": _scored("source", V.OUTSIDE_SCORE) - at(0, 5)})
    every = dated.select(*_KEPT, "rule", "score").unionByName(valid.select(*_KEPT, "rule", "score")).unionByName(listed.select(*_KEPT, "rule", "score")).distinct()
    suggestion = F.when(_public(), "recovered_public_identifier").when(F.col("source").isin(*V.OUTSIDE_SCORE), "verified_company_no_public_identifier").otherwise("manual_review_candidate")
    judged = every.withColumns({"has_public": _public(), "suggestion": suggestion, "score": F.col("score") - F.when(generic_like("candidate"), 30).otherwise(0)})
    judged = judged.withColumns(_no_ids("suggestion", "verified_company_no_public_identifier"))
    order = Window.partitionBy("record_id").orderBy(F.desc("has_public"), F.desc("score"), *_LAST)
    return judged.withColumn("candidate_rank", F.row_number().over(order)).drop("years", "exact", "legal")


def resolved(aliases: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every alias with its best candidate, what all of them say, a suggestion and its reason."""
    key = F.when(ids.valid_id("gvkey", "recovery"), F.col("gvkey")).when(ids.valid_id("cik", "recovery"), F.col("cik"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    counts = ranked.groupBy("record_id").agg(
        F.count("*").alias("n_candidates"), F.count_distinct(key).alias("n_public_ids"), F.count_distinct(F.nullif(names.recovery_name("candidate"), F.lit(""))).alias("n_names"),
        listed("source").alias("sources_all"), listed("rule").alias("rules_all"),
    )
    best = ranked.where("candidate_rank = 1").drop("candidate_rank", "alias").hint("merge").join(counts, "record_id")
    return _told(aliases, best)


def recovered(aliases: DataFrame, year_bridge: DataFrame | NameIndex, id_bridge: DataFrame, panel: DataFrame, outside: DataFrame) -> DataFrame:
    """What resolved() gives for the candidates of residual(), without a row for each of them.

    What is decided of a record and an identity depends on the record's keys and years and on the identity's name, source, years and which of its identifiers are
    valid. So requests (the keys and years of a record) meet kinds of identities with their number and the first of their identifiers. A public identifier
    counts once however many kinds have it: identifiers are counted by the set of kinds that they are in.
    """
    listed = listed_once(aliases, year_bridge, id_bridge, panel, outside, F.coalesce("source", F.lit("YEAR_BRIDGE")), F.lit("WRDS_LOOKUP"))
    like = ["group", "list", "b_exact", "b_legal", "source", "candidate", "seen", "has_gvkey", "has_cik"]
    listed = written(listed.withColumn("same", F.unhex(F.md5(F.to_json(F.struct(*like), {"ignoreNullFields": "false"})))), "residual-listed")
    kinds = listed.groupBy("same", *like).agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    generic = written(spread(kinds.select("candidate").distinct(), "candidate").withColumn("generic", generic_like("candidate")), "residual-generic")
    kinds = written(kinds.hint("merge").join(generic.hint("merge"), "candidate"), "residual-kinds")

    asked = written(_once(aliases.select("record_id", "alias", "years").distinct(), "alias", "exact", "legal").select("record_id", "exact", "legal", "group", "years").distinct(), "residual-asked")
    requests = asked.groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("exact", "legal", "group", "years"))).alias("asks")).withColumn("unit", F.unhex(F.md5(F.to_json("asks"))))
    requests = written(requests, "residual-requests")
    units = requests.groupBy("unit").agg(F.first("asks").alias("asks")).select("unit", F.inline("asks"))

    year, out, exact = F.col("list") == "year", F.col("list") == "out", F.col("kind") == "exact"
    inside, outer = _seen()
    met = units.hint("merge").join(kinds.hint("merge"), "group").where(~(F.col("list") == "id") | inside)
    met = met.withColumns({"kind": F.explode(_kinds()), "__in": inside, "__out": outer})
    years = F.filter(F.array(F.when(~year | F.col("__in"), F.lit(True)), F.when(year & F.col("__out"), F.lit(False))), lambda x: x.isNotNull())
    met = met.withColumn("inside", F.explode(years))
    at = lambda a, b: F.when(exact, a).otherwise(b)
    rule = (
        F.when(year, F.concat("kind", F.when(F.col("inside"), "_year_specific").otherwise("_other_year"))).when(out, F.concat(F.lower("source"), F.lit("_"), "kind", F.lit("_name")))
        .otherwise(F.concat(F.lit("identifier_"), "kind", F.lit("_validated")))
    )
    score = F.when(year, F.when(F.col("inside"), at(100, 90)).otherwise(at(80, 70))).when(out, _scored("source", V.OUTSIDE_SCORE) - at(0, 5)).otherwise(at(65, 60))
    public = F.col("has_gvkey") | F.col("has_cik")
    suggestion = F.when(public, "recovered_public_identifier").when(F.col("source").isin(*V.OUTSIDE_SCORE), "verified_company_no_public_identifier").otherwise("manual_review_candidate")
    met = met.withColumns({"rule": rule, "score": score - F.when(F.col("generic"), 30).otherwise(0), "has_public": public, "suggestion": suggestion})
    verified = F.col("suggestion") == "verified_company_no_public_identifier"
    met = met.withColumns({i: F.when(verified, "-99999").otherwise(F.col(f"ids.{i}")) for i in ("gvkey", "cik")})
    shown = ["source", "candidate", "gvkey", "cik", "rule", "kind", "score", "has_public", "suggestion"]
    # Requests of a record may meet a kind under one rule twice.
    met = written(met.select("unit", "same", "b_exact", "n", *shown).dropDuplicates(["unit", "same", "rule"]), "residual-met")
    order = F.struct(F.when(F.col("has_public"), 0).otherwise(1), -F.col("score"), *_LAST)
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    best = met.groupBy("unit").agg(
        F.min_by(F.struct(*shown), order).alias("best"), F.sum("n").alias("n_candidates"), F.count_distinct("b_exact").alias("n_names"), texts("source").alias("sources_all"), texts("rule").alias("rules_all")
    )
    key = F.when(ids.valid_id("ids.gvkey", "recovery"), F.col("ids.gvkey")).when(ids.valid_id("ids.cik", "recovery"), F.col("ids.cik"))
    within = listed.withColumn("key", key).where("key is not null").groupBy("group", "key").agg(F.array_sort(F.collect_set("same")).alias("kinds"))
    within = written(within.groupBy("group", "kinds").agg(F.count("*").alias("n_ids")), "residual-ids")
    of = within.withColumns({"__set": F.struct("group", "kinds"), "same": F.explode("kinds")}).select("same", "n_ids", F.unhex(F.md5(F.to_json("__set"))).alias("set"))
    counted = met.select("unit", "same").distinct().hint("merge").join(of.hint("merge"), "same").select("unit", "set", "n_ids").distinct().groupBy("unit").agg(F.sum("n_ids").alias("n_public_ids"))
    found = best.hint("merge").join(counted.hint("merge"), "unit", "left").select("unit", "best.*", "n_candidates", F.coalesce("n_public_ids", F.lit(0).cast("long")).alias("n_public_ids"), "n_names", "sources_all", "rules_all")
    return _told(aliases, requests.select("record_id", "unit").hint("merge").join(written(found, "residual-found").hint("merge"), "unit").drop("unit"))


def _told(aliases: DataFrame, best: DataFrame) -> DataFrame:
    """Every alias with its record's best candidate and counts, a suggestion and its reason."""
    suggestion = F.when(F.col("n_candidates").isNull(), "no_external_evidence").when(F.col("n_public_ids") > 1, "manual_review_candidate").otherwise(F.col("suggestion"))
    out = aliases.join(best.hint("merge"), "record_id", "left").withColumn("suggestion", suggestion)
    return out.withColumn("reason", F.coalesce(F.try_element_at(names.lookup(V.RESIDUAL_REASONS), F.col("suggestion")), F.lit("")))


def date_overlap(start: Column | str, end: Column | str, years: Column | str, open_end: int = 2026) -> Column:
    """How a listing's dates (text; no date counts as open) lie to an alias's years."""
    day = lambda c: names.strip(names.text(c)).substr(1, 10).try_cast("date")
    wanted = F.col(years) if isinstance(years, str) else years
    low, high = F.coalesce(F.year(day(start)), F.array_min(wanted)), F.coalesce(F.year(day(end)), F.lit(open_end))
    inside = F.exists(wanted, lambda y: y.between(low, high))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) < 1, "unknown_no_residual_years").when(inside, "date_overlaps_residual_year").otherwise("date_outside_residual_year")


def whole_number(c: Column | str) -> Column:
    """An id as a whole number's text, or the empty string."""
    return F.coalesce(names.text(F.col(c).cast("string")).try_cast("double").try_cast("long").cast("string"), F.lit(""))


def dated_recovery(aliases: DataFrame, listing: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Ranked candidates from a dated company listing, and which of them a crosswalk gives an identifier.

    `listing`: companyid, isin, candidate, startdate, enddate; `crosswalk`: companyid, gvkey, startdate, enddate. A
    candidate is an upgrade if the crosswalk knows its company and the listing's dates overlap the alias's years.
    """
    # What does not depend on the alias is worked out, made distinct and joined on the list, which is far smaller than what meets.
    known = crosswalk.select(whole_number("companyid").alias("company"), whole_number("gvkey").alias("ciq_gvkey"), F.col("startdate").alias("x_start"), F.col("enddate").alias("x_end")).where("company <> '' and ciq_gvkey <> ''").distinct()
    isin = F.replace(F.upper(names.text("isin")), F.lit(" "), F.lit("")).alias("isin")
    listed = listing.select("companyid", isin, "candidate", "startdate", "enddate").distinct().withColumn("company", whole_number("companyid")).join(known.hint("merge"), "company", "left")
    listed = listed.drop("company").withColumn("has_gvkey", F.col("ciq_gvkey").isNotNull())
    # Of a record's aliases of one key one stays, so each of its candidates comes once under a rule.
    a = keyed(aliases, "alias").where("exact <> ''")
    hits = meets(a, listed, once="record_id").withColumn("rule", F.when(F.col("kind") == "exact", "ciq_common_exact_name").otherwise("ciq_common_legal_name"))
    out = hits.select("record_id", "alias", "years", "candidate", "companyid", "isin", "startdate", "enddate", "rule", "ciq_gvkey", "x_start", "x_end", "has_gvkey").withColumn("overlap", date_overlap("startdate", "enddate", "years"))
    out = out.withColumns({
        "gvkey_overlap": F.when(F.col("has_gvkey"), date_overlap("x_start", "x_end", "years")), "upgrade": F.col("has_gvkey") & (F.col("overlap") == "date_overlaps_residual_year"),
    })
    near = F.when(F.col("overlap") == "date_overlaps_residual_year", 2).when(F.col("overlap").startswith("unknown"), 1).otherwise(0)
    order = Window.partitionBy("record_id").orderBy(F.desc("upgrade"), near.desc(), F.col("rule"), "candidate", "companyid", "isin", F.col("ciq_gvkey").asc_nulls_last(), "startdate", "enddate", "x_start", "x_end")
    return out.withColumn("candidate_rank", F.row_number().over(order)).drop("x_start", "x_end")
