"""Candidates for aliases that the matcher left: cascade, score, ranking, tiers, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import ids, names
from ..operators.aggregates import spread
from ..operators.joins import in_cells, in_panel
from ..sources.kept import written
from .nameindex import NameIndex


def abbreviations(spark) -> DataFrame:
    """Alias and each name to search for it under, of high confidence."""
    rows = [(names_of, search) for names_of, joined in V.ABBREVIATIONS.items() for search in joined.split("|")]
    return spark.createDataFrame(rows, "alias string, search string")


#: The rule of each stage of the cascade.
STAGES = {1: "exact_standardized_match", 2: "legal_form_normalization", 3: "approved_abbreviation_bridge_match", 4: "exact_other_year", 5: "legal_other_year", 6: "identifier_level"}


_IDENTITY = ["bridge_name", "source", "cik", "gvkey"]


def identities(bridge: DataFrame | NameIndex) -> DataFrame:
    """kind (candidate or legal), key, name, identity, bridge_years: the identities of a bridge under their two keys, with the set of their years.

    The index has both keys, and is grouped where its buckets are; a bridge's names are normalised here.
    """
    years = F.array_sort(F.collect_set("fyear")).alias("bridge_years")
    if isinstance(bridge, NameIndex):
        listed = bridge.under("candidate", "legal").withColumnRenamed("name_original", "bridge_name")
        return listed.groupBy("kind", "key", "name", *_IDENTITY).agg(years)
    key = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("key"))
    b = spread(bridge.withColumnRenamed("name_original", "bridge_name"), "bridge_name").groupBy(*_IDENTITY).agg(years)
    b = b.withColumn("name", names.candidate_name("bridge_name")).where("name <> ''")
    return b.select("name", *_IDENTITY, "bridge_years", F.inline(F.array(key("candidate", F.col("name")), key("legal", names.without_legal_terms("name"))))).where("key <> ''")


def asked_once(aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, members): aliases of the same name and years are one request, under the least of their record_ids; members tell each record's request.

    Candidates depend on name and years alone, so they are found, scored and ranked once a request, and a record's are copied last.
    """
    key = F.sha2(F.to_json(F.struct("alias", "years")), 256).alias("__request")
    requests = aliases.groupBy("alias", "years").agg(F.min("record_id").alias("record_id")).select("record_id", "alias", "years")
    members = aliases.select("record_id", key).join(requests.select(key, F.col("record_id").alias("__asked")).hint("merge"), "__request").drop("__request").distinct()
    return requests, members


def for_all(found: DataFrame, members: DataFrame) -> DataFrame:
    """What was found for requests, for every record. Few requests may be those of all records, so their pairs are dealt by number; only the last join makes them."""
    asked = written(found.withColumnRenamed("record_id", "__found"), "requests-found")
    return in_cells(asked, members, "__found", "__asked").select(*found.columns)


def alike(bridge: DataFrame | NameIndex, *marks: Column) -> tuple[DataFrame, DataFrame]:
    """(kinds, members): the kinds of a bridge's identities that no stage and no score tells apart, and the cik and gvkey of each kind's identities.

    Where a name has many aliases and many identities their pairs grow with the product, but what is decided of a pair depends on the
    identity's name, source and years, on which identifiers are valid, and on `marks` (made of cik and gvkey) alone. A kind is listed under its two
    keys, with `n`, how many identities it has, and the cik and gvkey of one of them.
    """
    marked = [x.alias(f"mark{k}") for k, x in enumerate([ids.valid_id("cik", "candidate"), ids.valid_id("gvkey", "candidate"), *marks])]
    same = F.sha2(F.to_json(F.struct("name", "bridge_name", "source", "bridge_years", *marked)), 256)
    listed = written(identities(bridge).withColumn("same", same), "cascade-identities")
    one = F.min(F.struct("cik", "gvkey"))
    kinds = listed.groupBy("kind", "key", "same").agg(one.alias("one"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("name", "bridge_name", "source", "bridge_years")])
    return kinds.select("kind", "key", "name", "same", "bridge_name", "source", "one.cik", "one.gvkey", "n", "bridge_years"), listed.where("kind = 'candidate'").select("same", "cik", "gvkey")


def first_stage(aliases: DataFrame, kinds: DataFrame, members: DataFrame, panel: DataFrame) -> DataFrame:
    """J05 by kinds of identities (`alike`): record_id's kinds of the first stage that has any.

    Each distinct alias is normalised once and meets the kinds by an equality join of names and legal keys; whether years overlap then tells the
    stages apart, a record and kind at a time. The level of identifiers comes last, so the panel is asked only about pairs by name that no stage before
    takes; it is told for each identity, whose row has no `same`.
    """
    key = lambda kind, how, name: F.struct(F.lit(kind).alias("kind"), F.lit(how).alias("how"), name.alias("key"))
    short = abbreviations(aliases.sparkSession).groupBy("alias").agg(F.collect_set("search").alias("search"))
    a = spread(aliases.select("alias").distinct(), "alias").join(short, "alias", "left").withColumn("own", names.candidate_name("alias"))
    searched = F.transform(F.coalesce("search", F.array().cast("array<string>")), lambda x: key("candidate", "abbreviation", names.candidate_name(x)))
    own = F.array(key("candidate", "name", F.col("own")), key("legal", "legal", names.without_legal_terms("own")))
    # Of the outer kind, as from the plain one Spark infers a filter, for which it would work names out again below.
    a = a.select("alias", "own", F.inline_outer(F.array_distinct(F.concat(own, searched)))).where("key <> ''")
    item = ["same", "bridge_name", "source", "cik", "gvkey", "n"]
    met = a.join(kinds, ["kind", "key"]).where((F.col("how") != "legal") | (F.col("own") != F.col("name"))).select("alias", "how", *item, "bridge_years")
    met = aliases.select("record_id", "alias", "years").join(met, "alias")
    within = F.coalesce(F.arrays_overlap("bridge_years", "years"), F.lit(False))
    apart = ~within & (F.size("years") > 0)
    how, strong = F.col("how"), F.col("source").isin(*V.STRONG_SOURCES)
    stage = (
        F.when((how == "name") & within, 1).when((how == "legal") & within, 2).when((how == "abbreviation") & within & strong, 3)
        .when((how == "name") & apart, 4).when((how == "legal") & apart, 5)
    )
    distance = F.when(within, 0).otherwise(ids.year_distance(F.col("bridge_years"), F.col("years")))
    met = written(met.select("record_id", "years", "how", *item, stage.alias("stage"), distance.alias("distance")), "cascade-met")
    found = met.where("stage is not null").groupBy("record_id", *item, "stage").agg(F.min("distance").alias("distance"))
    level = met.where((how == "name") & F.col("stage").isNull())
    if not level.isEmpty():
        level = level.drop("cik", "gvkey").join(members, "same").select("record_id", *_IDENTITY, "years").distinct()
        level = level.withColumn("__k", F.xxhash64("record_id", *_IDENTITY))
        valid = in_panel(level, "__k", panel, ["cik", "gvkey"])
        level = level.join(valid, "__k", "left_semi").select("record_id", *_IDENTITY, F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("same"), F.lit(6).alias("stage"), F.lit(0).alias("distance"))
        found = found.unionByName(level)
    first = F.min("stage").over(Window.partitionBy("record_id"))
    return found.withColumn("__first", first).where("stage = __first").drop("__first").withColumn("rule", F.try_element_at(names.lookup(STAGES), F.col("stage")))


def each_identity(found: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each identity of the kinds found. Pairs are made by this join alone, and dealt by number."""
    found = written(found.drop("n"), "kinds-found")
    met = found.where("same is not null").drop("cik", "gvkey").withColumnRenamed("same", "__same")
    out = in_cells(met, members, "__same", "same").drop("__same", "same")
    return out.unionByName(found.where("same is null").drop("same"))


def cascade(aliases: DataFrame, bridge: DataFrame | NameIndex, panel: DataFrame) -> DataFrame:
    """record_id's candidates of the first stage that has any.

    `aliases`: record_id, alias, years. `bridge`: name_original, fyear, source, cik, gvkey, or its kept index. `panel`: cik,
    gvkey, fyear. Stages are told for kinds of identities with the set of their years; identities are told apart last.
    """
    kinds, members = alike(bridge)
    found = each_identity(first_stage(aliases, kinds, members, panel), members)
    return found.select("record_id", *_IDENTITY, "stage", "distance", "rule")


def shapes(listed: DataFrame, c: str, to: str) -> DataFrame:
    """c, and a struct `to` of what score() reads of a name: the candidate stages' name, core, words, and name without legal terms; each distinct name is worked out once."""
    named = spread(listed.select(names.text(c).alias(c)).distinct(), c).withColumn("name", names.candidate_name(c))
    parts = [F.col("name"), names.strip_suffixes("name", V.LEGAL_TERMS).alias("core"), names.tokens(F.col("name")).alias("words"), names.without_legal_terms("name").alias("plain")]
    return named.select(F.col(c).alias(f"{to}_of"), F.struct(*parts).alias(to))


def score(candidates: DataFrame) -> DataFrame:
    """`candidates` with score, the sum of weights of source, priority, identifiers, rule, equality of cores, suffix and shape.

    Candidates are written once, as their distinct names, which are worked out once each, and the rows themselves read them.
    """
    look = lambda table, key, default: F.coalesce(F.try_element_at(names.lookup(table), key), F.lit(default))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    cik, gvkey = ids.valid_id("cik", "candidate"), ids.valid_id("gvkey", "candidate")
    source = F.upper("source")
    candidates = written(candidates, "judged")
    a, c = shapes(candidates, "alias", "__a").hint("merge"), shapes(candidates, "bridge_name", "__c").hint("merge")
    shaped = candidates.join(a, names.text("alias") == F.col("__a_of")).join(c, names.text("bridge_name") == F.col("__c_of"))
    core_a, core_c, words_a, words_c = (F.col(x) for x in ("__a.core", "__c.core", "__a.words", "__c.words"))
    both = (core_a != "") & (core_c != "")
    total = (
        look(V.SOURCE_SCORE, source, 0)
        + F.greatest(F.lit(0), 60 - 10 * look(V.SOURCE_PRIORITY, source, 9))
        + points(cik, 20)
        + points(gvkey, 10)
        + points(cik & gvkey, 10)
        + points(F.col("in_panel"), 5)
        + look(V.RULE_SCORE, F.col("rule"), 0)
        + F.when(both & (core_a == core_c), 80).when(both & core_c.startswith(F.concat(core_a, F.lit(" "))), 45).otherwise(0)
        + names.suffix_score("__c.name")
        + points(F.col("__a.plain") == F.col("__c.plain"), 20)
        + points(F.size(F.array_intersect(words_c, names.words([*V.LEGAL_TERMS, "LIMITED"]))) > 0, 20)
        + points(source.isin(*V.STRONG_SOURCES) | cik, 20)
        - points(F.arrays_overlap(words_c, names.words(V.GEOGRAPHIC_TERMS[:7])), 25)
        - points((F.size(words_c) >= F.size(words_a) + 2) & (core_a != core_c), 15)
    )
    return shaped.withColumn("score", total).drop("__a", "__c", "__a_of", "__c_of")


def _identifiers() -> Column:
    return ids.valid_id("cik", "candidate").cast("int") + ids.valid_id("gvkey", "candidate").cast("int")


def _order(identifiers: Column) -> list[Column]:
    """Rule, source priority, number of identifiers, panel, score, then names."""
    priority = F.coalesce(F.try_element_at(names.lookup(V.SOURCE_PRIORITY), F.upper("source")), F.lit(9))
    return [F.coalesce(F.try_element_at(names.lookup(V.RULE_RANK), F.col("rule")), F.lit(9)), priority, identifiers.desc(), F.col("in_panel").desc(), F.col("score").desc(), F.asc("source"), F.asc("bridge_name")]


def _good(identifiers: Column, margin: int) -> Column:
    """Whether a candidate, if it is the first, is recommended; `next_score` is the second's."""
    eligible = F.col("rule").isin("exact_standardized_match", "legal_form_normalization", "exact_other_year", "legal_other_year")
    wide = F.col("next_score").isNull() | (F.col("score") >= F.col("next_score") + margin)
    return (F.col("candidate_rank") == 1) & eligible & wide & (identifiers > 0)


def rank(candidates: DataFrame, margin: int = 30) -> DataFrame:
    """Rank within a record, and whether the first is recommended.

    Ranks go by rule, source priority, number of identifiers, panel, score, then names and identifiers; the margin
    compares scores of ranks 1 and 2, of which the second may score higher.
    """
    w = Window.partitionBy("record_id").orderBy(*_order(_identifiers()), F.col("cik").asc_nulls_last(), F.col("gvkey").asc_nulls_last())
    ranked = candidates.withColumns({"candidate_rank": F.row_number().over(w), "next_score": F.lead("score").over(w)})
    return ranked.withColumn("recommended", _good(_identifiers(), margin)).drop("next_score")


#: Ranks that one row gives at most before rows are dealt out anew.
RANKS = 4096


def rank_kinds(scored: DataFrame, margin: int = 30) -> DataFrame:
    """rank() of scored kinds of identities, without their identifiers: a row for each identity of a kind.

    Identities that differ in identifiers alone have ranks in a row, so kinds are ordered and their numbers added up; only then is each rank a row. Long runs of ranks are
    cut and dealt over tasks.
    """
    like = ["record_id", "bridge_name", "source", "rule", "score", "in_panel"]
    ties = scored.groupBy(*like, _identifiers().alias("__ids")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("record_id").orderBy(*_order(F.col("__ids")))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ties = ties.withColumns({"__before": before, "next_score": F.when(F.col("n") > 1, F.col("score")).otherwise(F.lead("score").over(w))})
    runs = ties.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANKS).cast("long"))))
    runs = spread(runs, "record_id", "__before", "__from")
    last = F.least(F.col("n"), F.col("__from") + RANKS)
    ranks = F.sequence(F.col("__before") + F.col("__from") + 1, F.col("__before") + last)
    ranked = runs.withColumn("candidate_rank", F.explode(ranks)).withColumn("candidate_rank", F.col("candidate_rank").cast("int"))
    return ranked.withColumn("recommended", _good(F.col("__ids"), margin)).select(*like, "candidate_rank", "recommended")


def reliability(candidates: DataFrame) -> DataFrame:
    """Distinct gvkeys of a record in year, overall and among legal matches; whether a gvkey has SEC sources only.

    The candidates are written once, as the counts and the rows themselves read them.
    """
    candidates = written(candidates, "reliability")
    in_year = F.col("distance") == 0
    gv = F.when(ids.valid_id("gvkey", "candidate"), ids.clean_id("gvkey"))
    legal = F.col("rule").isin("legal_form_normalization", "suffix_stripped_match", "legal_other_year")
    per = candidates.groupBy("record_id").agg(
        F.count_distinct(F.when(in_year, gv)).alias("n_year"), F.count_distinct(gv).alias("n_all"), F.count_distinct(F.when(legal, gv)).alias("n_legal")
    )
    sec = candidates.groupBy("record_id", F.coalesce(gv, F.lit("")).alias("gv")).agg(F.bool_and(F.upper("source").isin(*V.SEC_SOURCES)).alias("sec_only"))
    return candidates.withColumn("gv", F.coalesce(gv, F.lit(""))).join(per, "record_id").join(sec, ["record_id", "gv"]).drop("gv")


def generic_name(c: Column | str) -> Column:
    """A candidate's name that tells no company from another: empty, digits alone, two characters at most, or four fifths generic words."""

    def judged(name: Column, words: Column) -> Column:
        known = F.size(F.filter(words, lambda t: F.array_contains(names.words(V.CANDIDATE_GENERIC), t)))
        short = F.length(F.replace(name, F.lit(" "), F.lit(""))) <= 2
        return (name == "") | name.rlike(r"^\d+( \d+)*$") | short | (5 * known >= 4 * F.size(words))

    return names.let(F.struct(names.candidate_name(c).alias("name")), lambda s: judged(s["name"], names.tokens(s["name"])))


def tier(generic: Column) -> Column:
    """The acceptance tier of a candidate with reliability()'s columns."""
    priority = F.coalesce(F.try_element_at(names.lookup(V.SOURCE_PRIORITY), F.upper("source")), F.lit(999))
    strong = F.upper("source").isin(*V.STRONG_SOURCES)
    rule, one = F.col("rule"), lambda c: F.col(c) == 1
    table = [
        ("exact_standardized_match", "A", one("n_year") & F.col("in_panel")),
        ("legal_form_normalization", "B", one("n_year") & (priority <= 3) & ~F.col("sec_only")),
        ("exact_other_year", "C", one("n_all") & ((F.col("distance") <= 3) | strong)),
        ("legal_other_year", "D", one("n_legal") & ~F.col("sec_only") & ~generic),
        ("approved_abbreviation_bridge_match", "TIC-SAFE", one("n_year") & F.col("in_panel") & strong),
        ("identifier_level", "E", one("n_all") & F.col("in_panel")),
    ]
    out = F.lit("manual_review")
    for name, letter, accepted in reversed(table):
        out = F.when(rule == name, F.concat(F.lit(f"Tier {letter} "), F.when(accepted, "auto_accept").otherwise("manual_review"))).otherwise(out)
    return out


#: Scenario and the tiers it accepts; the first accepts what is recommended.
SCENARIOS = {
    "conservative_rev7_current": (),
    "auto_accept_same_year_only": ("A", "B"),
    "auto_accept_same_year_plus_unique_exact_other_year": ("A", "B", "C"),
    "auto_accept_same_year_plus_unique_exact_and_legal_other_year": ("A", "B", "C", "D"),
    "broad_recall_with_manual_flags": ("A", "B", "C", "D", "TIC-SAFE", "E"),
}


def scenarios(tiered: DataFrame, *kept: str) -> DataFrame:
    """Each record's first candidate, with its columns `kept`, under each of the five scenarios (exploded from a literal list)."""
    rows = []
    for name, letters in SCENARIOS.items():
        accepted = F.col("recommended") if not letters else F.col("tier").isin(*[f"Tier {x} auto_accept" for x in letters])
        rows.append(F.struct(F.lit(name).alias("scenario"), F.when(accepted, "auto_accept").otherwise("manual_review").alias("status")))
    return tiered.where("candidate_rank = 1").select("record_id", "rule", "tier", *kept, F.inline(F.array(*rows)))
