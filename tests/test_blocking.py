"""Outside names are reduced by their first word before any pattern of the recovery stages runs over them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mentionweave.functions import names
from mentionweave.plans import recovery, rescue

ODD = [
    "Acme Inc", "  acme, inc.", "& Sons", "&Co Acme", "AND COMPANY Acme", "and co acme", "Andover Co", "Société Générale", "Société", "Soci-été", "École & Co", "Company of X", "Technologies Acme", "'Acme'",
    "nan", " None ", "None Such", "", None, "3M", "3M Company", "McDonald's", "MCDONALD'S CORP", "Wendy's", "Wendy s", "A s", "É", " Acme", "Acme Inc", "(Acme) Co", "@home", "日本 Co", "Straße AG", "ﬁrst Co",
    "a&b", "AT&T Inc", "AT & T", "x\ny", "Acmé Co", "...", "Co & Co", "Co and Company", "Group X", "ab'S", "abc's", "abc 's  ", "The Gap", "L'Oréal SA", "i̇stanbul", "ı Co", "ſ Co", "K Co",
]


@pytest.mark.parametrize("first, whole", [(names.recovery_first_word, names.recovery_name), (names.partial_first_word, names.partial_name)])
def test_first_word_is_that_of_the_whole_name(spark, first, whole):
    rng = random.Random(4)
    bits = [x for x in ODD if x] + ["&", "and", "co", "company", "s", "'", " ", "-", ",", "é", "group"]
    made = ODD + ["".join(rng.choices(bits, k=rng.randint(1, 4))) for _ in range(1500)] + [rng.choice(bits) + rng.choice([" ", "'", "&", "."]) + rng.choice(bits) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in made], "x string")
    wrong = df.select("x", first("x").alias("a"), F.split(whole("x"), " ", 2)[0].alias("b")).where("a <> b or a is null").collect()
    assert wrong == []


def test_few_outside_names_reach_the_patterns(spark):
    aliases = spark.createDataFrame([(1, "Acme Holdings", [2000]), (2, "Société Générale SA", [2000]), (3, "& Sons", [2000])], "record_id long, alias string, years array<int>")
    outside = [(f"Firm{k} Inc", "REPRISK") for k in range(500)] + [("ACME HLDG", "REPRISK"), ("Acme Foods", "REPRISK"), ("Societe Generale", "REPRISK"), ("AND SONS", "REPRISK"), (None, "REPRISK")]
    listed = spark.createDataFrame([(n, str(k), None, s) for k, (n, s) in enumerate(outside)], "candidate string, gvkey string, cik string, source string")
    left = rescue.sharing_first_word(listed, aliases)
    assert {r.candidate for r in left.collect()} == {"ACME HLDG", "Acme Foods", "Societe Generale", "AND SONS"}
    hits = rescue.meets(rescue.keyed(aliases, "alias"), listed)
    assert {(r.record_id, r.candidate, r.kind) for r in hits.collect()} == {(1, "ACME HLDG", "exact"), (1, "ACME HLDG", "legal"), (2, "Societe Generale", "legal"), (3, "AND SONS", "exact"), (3, "AND SONS", "legal")}
    found = recovery.recover(aliases.drop("years"), listed.withColumn("base_score", F.lit(40)))
    assert {(r.record_id, r.candidate, r.rule, r.score) for r in found.collect()} == {(1, "ACME HLDG", "exact_name", 60), (2, "Societe Generale", "canonical_name", 50), (3, "AND SONS", "exact_name", 60)}


def test_the_semi_join_stands_below_the_patterns(spark):
    aliases = spark.range(3).selectExpr("id as record_id", "concat('Acme', id) as alias", "array(2000) as years")
    listed = spark.range(1000).selectExpr("concat('Acme', id, ' Inc') as candidate", "cast(id as string) as gvkey", "cast(null as string) as cik", "'REPRISK' as source")
    plan = rescue.keyed(rescue.sharing_first_word(listed, aliases), "candidate")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    semi = next(k for k, x in enumerate(lines) if "LeftSemi" in x)
    assert any("COMPANY|CO" in x and "regexp_replace" in x for x in lines[:semi])  # the name's patterns are worked out above the join


def test_partial_evidence_keeps_possessives(spark):
    aliases = spark.createDataFrame([(1, "Wendys"), (2, "McDonald's Corp")], "record_id long, alias string")
    sources = spark.createDataFrame([("S", "Wendy's", "1", None), ("S", "WENDYS INTERNATIONAL", "2", None), ("S", "McDonald's", "3", None), ("S", "Other", "4", None)], "source string, candidate string, gvkey string, cik string")
    got = {(r.record_id, r.candidate) for r in recovery.partial_evidence(aliases, sources).collect()}
    assert (1, "Wendy's") in got and (1, "WENDYS INTERNATIONAL") in got and not any(c == "Other" for _, c in got)
