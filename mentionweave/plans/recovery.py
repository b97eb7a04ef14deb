"""Recovery of unresolved aliases from bridges and external sources, its refinement and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import ids, names
from .rescue import keyed, meets, sharing_first_word


def recover(aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates of one list of sources whose recovery name or its core equals the alias's, one row a rule.

    `aliases`: record_id, alias. `sources`: source, candidate, cik, gvkey, base_score.
    """
    hits = meets(keyed(aliases, "alias"), sources).withColumn("rule", F.when(F.col("kind") == "exact", "exact_name").otherwise("canonical_name"))
    bonus = F.when(F.col("rule") == "exact_name", 20).otherwise(10)
    return hits.groupBy("record_id", "alias", "source", "candidate", "cik", "gvkey").agg(F.min_by("rule", -F.col("base_score") - bonus).alias("rule"), F.max(F.col("base_score") + bonus).alias("score"))


def rank_recovered(found: DataFrame) -> DataFrame:
    """Rank of candidates by public identifier, score, source and name."""
    public = ids.valid_id("gvkey", "recovery") | ids.valid_id("cik", "recovery")
    marked = found.withColumn("has_public", public)
    w = Window.partitionBy("record_id").orderBy(F.col("has_public").desc(), F.col("score").desc(), "source", "candidate", F.col("gvkey").asc_nulls_last(), F.col("cik").asc_nulls_last())
    return marked.withColumn("candidate_rank", F.row_number().over(w))


def public_key() -> Column:
    return F.when(ids.valid_id("gvkey", "recovery"), ids.clean_id("gvkey")).when(ids.valid_id("cik", "recovery"), ids.clean_id("cik"))


def resolve(aliases: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each alias with its best candidate, how ambiguous it is, and a suggestion."""
    counts = ranked.groupBy("record_id").agg(F.count("*").alias("n_candidates"), F.count_distinct(public_key()).alias("n_public_ids"), F.count_distinct(names.recovery_name("candidate")).alias("n_names"))
    best = ranked.where("candidate_rank = 1").drop("candidate_rank", "alias").hint("merge").join(counts, "record_id")
    verdict = (
        F.when(F.col("n_candidates").isNull(), "no_external_evidence")
        .when(F.col("n_public_ids") > 1, "manual_review_candidate")
        .when(F.col("has_public"), "recovered_public_identifier")
        .otherwise("verified_company_no_public_identifier")
    )
    return aliases.join(best.hint("merge"), "record_id", "left").withColumn("suggestion", verdict)


def refine(ranked: DataFrame) -> DataFrame:
    """Refined score, rank, and gap to the second; `ranked` also has sic_files and candidate_sic."""
    suffixes = V.REFINED_SUFFIXES
    a = names.canonical(names.alnum_key("alias"), suffixes)
    c = names.alnum_key("candidate")
    core, words = names.canonical(c, suffixes), names.tokens(c)
    sic = ids.sic_support("sic_files", "candidate_sic")
    points = lambda condition, n: F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
    has = lambda terms: F.arrays_overlap(words, names.words(terms))
    equal, begins = (core == a) & (a != ""), (a != "") & c.startswith(F.concat(a, F.lit(" ")))
    refined = (
        F.col("score") + points(F.col("has_public"), 35) + points(equal, 35) + points(begins, 15)
        + points(F.try_element_at(words, F.lit(-1)).isin(*suffixes), 15) + points(has(V.STRONG_SUFFIXES), 12) + F.col("sic.bonus")
        - points(has(V.GEOGRAPHIC_TERMS), 18) - points(has(V.UNIT_TERMS), 12)
        + points(F.lower("rule").contains("year_specific"), 12) + points(F.lower("rule").contains("exact"), 8)
    )
    scored = ranked.withColumn("sic", sic).withColumns({"refined_score": refined, "strong_name": equal | begins})
    w = Window.partitionBy("record_id").orderBy(F.col("refined_score").desc(), F.col("has_public").desc(), "source", "candidate", F.col("gvkey").asc_nulls_last(), F.col("cik").asc_nulls_last())
    n_public = scored.groupBy("record_id").agg(F.count_distinct(public_key()).alias("n_public_ids"))
    best = scored.withColumns({"refined_rank": F.row_number().over(w), "gap": F.col("refined_score") - F.lead("refined_score", 1, -9999).over(w)}).where("refined_rank = 1")
    return best.join(n_public, "record_id").withColumn("sic_support", F.col("sic.support")).drop("sic", "refined_rank")


def refined_status(resolved_before: Column, verified: Column) -> Column:
    """What the refined best candidate amounts to."""
    near = F.col("strong_name") | F.col("sic_support").isin("sic4_match", "sic3_match", "sic2_match") | (F.col("gap") >= 30)
    return (
        F.when(resolved_before, "already_resolved_in_step85")
        .when(F.col("has_public") & (F.col("n_public_ids") <= 1) & near, "recovered_public_identifier_refined")
        .when(F.col("has_public"), "needs_manual_review_broad_alias")
        .when(verified, "company_evidence_public_identifier_missing")
        .otherwise("needs_manual_review_broad_alias")
    )


def partial_evidence(aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates whose core equals the alias's or begins with it; rule and score of the best reading.

    Prefixes of one to six words of the candidate's core meet the alias's core by equality.
    """
    a = aliases.withColumn("a", names.partial_name("alias")).withColumn("ac", names.canonical("a", V.PARTIAL_SUFFIXES)).withColumn("key", F.when(F.col("ac") != "", F.col("ac")).otherwise(F.col("a"))).where("a <> ''")
    c = sharing_first_word(sources, aliases, names.partial_first_word).withColumn("c", names.partial_name("candidate")).withColumn("cc", names.canonical("c", V.PARTIAL_SUFFIXES)).withColumn("body", F.when(F.col("cc") != "", F.col("cc")).otherwise(F.col("c"))).where("c <> ''")
    spread = c.withColumn("key", F.explode(names.prefixes("body", 6)))
    met = a.join(spread, "key")
    rest = F.slice(names.tokens(F.col("body")), F.size(names.tokens(F.col("key"))) + 1, F.greatest(F.size(names.tokens(F.col("body"))), F.lit(1)))
    safe = (F.size(rest) > 0) & ~F.exists(rest, lambda t: ~F.array_contains(names.words(V.SAFE_CONTINUATIONS), t))
    rule = (
        F.when(F.col("a") == F.col("c"), F.struct(F.lit("possessive_or_exact_name").alias("rule"), F.lit(100).alias("score")))
        .when(F.col("key") == F.col("body"), F.struct(F.lit("legal_canonical_name").alias("rule"), F.lit(90).alias("score")))
        .when(safe, F.struct(F.lit("alias_prefix_safe_continuation").alias("rule"), F.lit(75).alias("score")))
        .when(F.col("key").contains(" "), F.struct(F.lit("multi_token_prefix").alias("rule"), F.lit(65).alias("score")))
    )
    return met.withColumn("hit", rule).where("hit is not null").select("record_id", "alias", "source", "candidate", "cik", "gvkey", "hit.*")


def consolidate() -> Column:
    """struct(action, decision, gvkey, cik) from refined status, crosswalk evidence and pattern."""
    refined, upgrade = F.col("refined"), F.coalesce(F.col("ciq_upgrade"), F.lit(False))
    own_g, own_c, ciq = names.no_null_word("gvkey"), names.no_null_word("cik"), names.no_null_word("ciq_gvkey")
    near = F.col("sic_support").isin("sic4_match", "sic3_match", "sic2_match") | (F.coalesce("gap", F.lit(0)) >= 30)
    lit = F.lit
    rules = [
        (refined == "already_resolved_in_step85", "already_resolved_in_step85", "do_not_reprocess", own_g, own_c),
        ((refined == "recovered_public_identifier_refined") & F.col("has_public") & (F.col("n_public_ids") <= 1), "auto_recover_public_identifier", "auto_accept_candidate", own_g, own_c),
        (upgrade & refined.isin("recovered_public_identifier_refined", "company_evidence_public_identifier_missing"), "auto_recover_public_identifier_ciq_crosswalk", "auto_accept_candidate", ciq, lit("")),
        (upgrade & (refined == "no_external_evidence"), "manual_review_public_candidate_ciq_new", "manual_review", ciq, lit("")),
        (refined == "needs_manual_review_broad_alias", "manual_review_public_candidate", "manual_review", F.when(F.col("has_public"), own_g).otherwise(ciq), own_c),
        ((refined == "company_evidence_public_identifier_missing") & near, "verified_company_no_public_identifier", "auto_accept_verified_company_no_id", lit("-99999"), lit("-99999")),
        (refined == "company_evidence_public_identifier_missing", "manual_review_company_no_identifier", "manual_review", lit("-99999"), lit("-99999")),
        ((refined == "no_external_evidence") & F.col("pattern").isin("product_or_business_unit_like", "multiple_or_compound_name"), "remain_unresolved_reason_coded", "leave_unresolved", lit("-1"), lit("-1")),
        (refined == "no_external_evidence", "remain_unresolved_no_evidence", "leave_unresolved", lit("-1"), lit("-1")),
    ]
    out = F.struct(lit("manual_review_residual").alias("action"), lit("manual_review").alias("decision"), own_g.alias("gvkey"), own_c.alias("cik"))
    for condition, action, decision, gvkey, cik in reversed(rules):
        out = F.when(F.coalesce(condition, lit(False)), F.struct(lit(action).alias("action"), lit(decision).alias("decision"), gvkey.alias("gvkey"), cik.alias("cik"))).otherwise(out)
    return out
