"""Final statuses, the decision table with human overrides, and the population export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, names
from ..operators.aggregates import keep_first, status_pivot
from ..operators.joins import complete


def final_status(identifier_status: Column, resolution: Column, model_decision: Column, generic: Column) -> Column:
    """A mention's status; identifiers before reviews, reviews before the model, the model before generic names."""
    clean = names.no_null_word
    return (
        F.when(clean(identifier_status) == "public_identifier_matched", "identified_public_firm")
        .when(clean(identifier_status) == "verified_company_no_public_identifier", "identified_verified_company_no_public_id")
        .when(clean(resolution) == "unmatched_rejected", "dropped_human_rejected")
        .when(clean(resolution) == "unmatched_unclear", "unresolved_unclear")
        .when(clean(model_decision) == "drop", "dropped_llm_nonfirm_or_generic")
        .when(F.coalesce(generic, F.lit(False)), "dropped_generic_or_nonfirm_pre_step7")
        .otherwise("unresolved_no_safe_candidate")
    )


PUBLIC, VERIFIED = "identified_public_firm", "identified_verified_company_no_public_id"


#: Columns of which the first with text names the firm, by what the rule trusts.
NAMES = {
    "recovered": ("candidate_conm", "candidate_name", "candidate_original_name", "candidate_bridge_name", "suggested_alias_name"),
    "evidence": ("candidate_conm", "candidate_name", "suggested_alias_name", "candidate_input_name"),
    "candidate": ("candidate_conm", "candidate_name", "suggested_alias_name"),
    "reviewed": ("partial_candidate_name", "candidate_conm", "candidate_name", "suggested_alias_name"),
    "verified": ("partial_candidate_name", "suggested_alias_name", "competitor_name"),
    "note": ("note2",),
    "alias": ("suggested_alias_name", "candidate_input_name", "competitor_name"),
    "partial": ("partial_candidate_name", "suggested_alias_name"),
    "given": ("suggested_alias_name", "candidate_input_name", "competitor_name_standardized", "competitor_name"),
}
#: What a rule decides: (status, rule or None for the action itself, identifiers or None, included, where the
#: decision comes from, names or None). Reviews first, then actions, then extensions; of each kind the first that holds counts.
REVIEWS = (
    (VERIFIED, "manual_decision_approve_verified_company_no_id", "none", True, "step3_human_approved_verified_no_id", "alias"),
    ("unresolved_unclear", "manual_unclear", None, False, "step3_human_unclear", None),
    ("dropped_human_rejected", "manual_reject", None, False, "step3_human_rejected", None),
    (PUBLIC, "manual_decision_approve_public_id", "reviewed", True, "step2_human_approved_public_id", "reviewed"),
    (VERIFIED, "manual_decision_approve_verified_company_no_id", "none", True, "step2_human_approved_verified_no_id", "verified"),
    (VERIFIED, "reviewer_note_used_as_corrected_firm_name_no_id", "none", True, "step2_human_corrected_wrong_candidate", "note"),
    ("unresolved_rejected_wrong_partial_candidate", "manual_reject_no_corrected_name", None, False, "step2_human_rejected_candidate", None),
    ("unresolved_unclear", "manual_unclear", None, False, "step2_human_unclear", None),
)
ACTED = (
    (PUBLIC, None, "proposed", True, "step8_previously_recovered_public_id", "recovered"),
    (VERIFIED, None, "none", True, "step8_company_evidence_no_public_id", "evidence"),
    (PUBLIC, "valid_identifier_candidate_retained", "own", True, "step8_broad_public_candidate_accepted_by_wrapup", "candidate"),
    (VERIFIED, "firm_like_candidate_no_public_id", "none", True, "step8_public_candidate_without_identifier", "candidate"),
)
EXTENDED = (
    (PUBLIC, "exact_or_legal_partial_external_with_identifier_no_risk_terms", "partial", True, "step2_rule_extended_strict_public_id", "partial"),
    (VERIFIED, "exact_or_legal_partial_external_no_risk_terms", "none", True, "step2_rule_extended_verified_no_id", "partial"),
    (VERIFIED, "llm_company_like_confidence_ge_90_no_external_id", "none", True, "step3_rule_extended_high_confidence_no_id", "alias"),
    (VERIFIED, "unresolved_name_contains_legal_entity_suffix_no_public_id", "none", True, "step9_legal_suffix_verified_no_id", "alias"),
    ("unresolved_risky_partial_external_excluded", "partial_external_evidence_risky_not_exported", None, False, None, None),
)
#: What stands where no rule holds.
NO_RULE, NO_SOURCE = "no_safe_final_recovery_rule", "step9_unresolved_excluded"


def _which(conditions: list[Column]) -> Column:
    """Number of the first condition that holds, or null."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in enumerate(conditions)])


def _pick(table: tuple, which: str, field: int) -> Column:
    return F.get(F.array(*[F.lit(row[field]) for row in table]), F.col(which))


def decide(rows: DataFrame) -> DataFrame:
    """`rows` with final_status, final_rule, final_source, final_name, final_gvkey, final_cik, identifier_status and include.

    `rows` has action, dec2, note2, dec3, exactish, risky, confident, legal_suffix, and gvkey and cik of the
    candidate, of the consolidation (proposed_) and of partial evidence (partial_); ciq_gvkey and the columns of NAMES
    count as empty where they are missing. Decisions of the third review come before those of the second, those before
    the action's; rules are extended only where none of these decided. A review that names no identifiers or no firm
    keeps those of the other review or the action.
    """
    rows = rows.withColumns({c: F.lit("") for c in {"ciq_gvkey", *(c for cs in NAMES.values() for c in cs)} - set(rows.columns)})
    dec2, dec3, note, action = (names.no_null_word(c) for c in ("dec2", "dec3", "note2", "action"))
    broad, wrong = action == "manual_review_public_candidate", dec2 == "reject_wrong_match_or_nonfirm"
    left = action.isin("unresolved_no_accepted_evidence", "remain_unresolved_reason_coded")
    partly, external = action == "manual_review_public_candidate_partial_external", action == "external_partial_evidence_needs_review"
    strict = F.col("exactish") & ~F.col("risky")
    any_of = lambda *columns: F.exists(F.array(*[ids.valid_id(c) for c in columns]), lambda x: x)
    third = [dec3 == "approve_verified_company_no_id", dec3 == "unclear", dec3.contains("reject")]
    second = [dec2 == "approve_public_id", dec2 == "approve_verified_company_no_id", wrong & (note != ""), wrong, dec2 == "unclear"]
    acted = [
        action.isin("auto_recover_public_identifier", "auto_recover_public_identifier_ciq_crosswalk", "manual_review_public_candidate_ciq_new", "already_resolved_in_step85"),
        action.isin("verified_company_no_public_identifier", "manual_review_company_no_identifier"),
        broad & any_of("gvkey", "cik", "proposed_gvkey", "proposed_cik"),
        broad,
    ]
    extended = [partly & strict & any_of("partial_gvkey", "partial_cik"), external & strict, left & F.col("confident"), left & F.col("legal_suffix"), partly | external]
    marked = rows.withColumns({"__third": _which(third), "__second": _which(second) + len(third), "__act": _which(acted), "__more": _which(extended)})
    review = F.coalesce("__third", "__second")
    marked = marked.withColumns({"__review": review, "__more": F.when(review.isNull() & F.col("__act").isNull(), F.col("__more"))})
    first = lambda field: F.coalesce(_pick(REVIEWS, "__review", field), _pick(ACTED, "__act", field), _pick(EXTENDED, "__more", field))
    kept = lambda field: F.coalesce(_pick(REVIEWS, "__third", field), _pick(REVIEWS, "__second", field), _pick(ACTED, "__act", field), _pick(EXTENDED, "__more", field))
    kind = kept(2)
    clean = {c: f"__text_{c}" for c in sorted({c for cs in NAMES.values() for c in cs})}
    marked = marked.withColumns({"__named": F.coalesce(kept(5), F.lit("given"))} | {n: ids.first_text([c]) for c, n in clean.items()})
    full = lambda columns: F.coalesce(*[F.nullif(F.col(clean[c]), F.lit("")) for c in columns], F.lit(""))
    marked = marked.withColumn("final_name", F.coalesce(*[F.when(F.col("__named") == k, full(columns)) for k, columns in NAMES.items()])).drop(*clean.values())
    identified = F.when(kind == "none", "verified_company_no_public_identifier").when(kind.isNotNull(), "public_identifier_available").otherwise("unresolved_excluded")
    rule = F.when(review.isNull() & F.col("__act").isin(0, 1), action).otherwise(first(1))
    out = marked.withColumns({"final_status": F.coalesce(first(0), F.lit("unresolved_no_safe_candidate_excluded")), "final_rule": F.coalesce(rule, F.lit(NO_RULE)), "final_source": F.coalesce(first(4), F.lit(NO_SOURCE)), "identifier_status": identified, "include": F.coalesce(first(3), F.lit(False)), "__kind": kind})
    for at in ("gvkey", "cik"):
        value = (
            F.when(F.col("__kind") == "none", "-99999")
            .when(F.col("__kind") == "reviewed", ids.first_valid([f"partial_{at}", at, f"proposed_{at}"]))
            .when(F.col("__kind") == "proposed", ids.first_valid([f"proposed_{at}", at, *(["ciq_gvkey"] if at == "gvkey" else [])]))
            .when(F.col("__kind") == "own", ids.first_valid([at, f"proposed_{at}"]))
            .when(F.col("__kind") == "partial", ids.first_valid([f"partial_{at}", at]))
            .otherwise("-1")
        )
        out = out.withColumn(f"final_{at}", value)
    return out.drop("__third", "__second", "__act", "__more", "__review", "__kind", "__named")


def best_decision(decisions: DataFrame) -> DataFrame:
    """One decision a merge_key: an included one, then the most frequent, then the least record_id."""
    return keep_first(decisions, ["merge_key"], [F.col("include").desc(), F.col("frequency").desc_nulls_last(), F.col("record_id")])


def apply_decisions(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """A key's decision overrides every mention with that key, identified ones included."""
    d = best_decision(decisions).select("merge_key", F.col("final_status").alias("__s"), F.col("final_gvkey").alias("__g"), F.col("final_cik").alias("__c"))
    out = mentions.join(d, "merge_key", "left")
    return out.withColumns({"status": F.coalesce("__s", "status"), "gvkey": F.coalesce("__g", "gvkey"), "cik": F.coalesce("__c", "cik")}).drop("__s", "__g", "__c")


def edges(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each focal filing and competitor, with the first order in which it is named."""
    return mentions.groupBy(*keys).agg(F.min("competitor_order").alias("first_competitor_order"), F.count("*").alias("n_mentions"))


def coverage_audit(population: DataFrame, statuses: DataFrame, found: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """Each filing of the population with counts by status, of final competitors, and its coverage."""
    counts = status_pivot(statuses, keys, status, values)
    named = found.groupBy(*keys).agg(F.count("*").alias("n_final"))
    out = complete(population, counts, keys, []).join(named, keys, "left").na.fill(0, [*values, "n_final"])
    kind = F.when(F.col("n_final") > 0, "has_final_named_competitor").when(F.col("n_extracted") == 0, "no_names_extracted_from_competition_text").otherwise("names_extracted_but_none_identified")
    return out.withColumn("coverage", kind)


def repair_conflicts(rows: DataFrame, reference: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    """For keys with several values, the reference's value of best priority where that is one; else left as is."""
    several = rows.groupBy(*keys).agg(F.count_distinct(value).alias("__n")).where("__n > 1").select(*keys)
    best = reference.groupBy(*keys).agg(F.min(F.struct(priority, value)).alias("__low"))
    top = reference.join(best, keys).where(F.col(priority) == F.col(f"__low.{priority}"))
    one = top.groupBy(*keys).agg(F.min(value).alias("__v"), F.max(value).alias("__w")).where("__v = __w").select(*keys, "__v")
    fixed = several.join(one, keys)
    return rows.join(fixed, keys, "left").withColumn(f"{value}_repaired", F.col("__v").isNotNull()).withColumn(value, F.coalesce("__v", value)).drop("__v")
