"""Hand-made cases of the name, identifier and list functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mentionweave.functions import ids, names
from mentionweave.functions import text as T


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (names.standard, {"Intl Game Technology": "INTL GAME TECH", "Mueller (Paul) Co": "MUELLER CO", "Smith (A.O.)": "SMITH", "Infinity Broadcasting  -CL A": "INFINITY BROADCASTING", "Businessmall.com": "BUSINESSMALLCOM", "The Acme Group": "ACME GRP", None: "", "": ""}),
        (lambda c: names.standard(c, parent=True), {"Foo's Widgets": "FOO", "Gadgets (owned by Bar Inc.)": "BAR INC", "a unit of Baz, Inc.": "BAZ"}),
        (names.owner, {"Gadgets (owned by Bar Inc.)": "Bar Inc", "a unit of Baz, Inc.": "Baz", "X's y": "X's y", "Plain": "Plain"}),
        (names.safe_core, {"ACME WIDGETS INC": "ACME WIDGETS", "ACME INC": None, "INC": None, "ABC": None}),
        (names.strip_suffixes, {"INC": "INC", "A CO LTD": "A"}),
        (names.canonical, {"INC": "", "A CO LTD": "A", "THE": ""}),
        (names.close_up, {"FOO S A R L": "FOO SARL", "FOO S A": "FOO SA", "AS BAR": "AS BAR"}),
        (names.capital, {"Acme": True, "3Com": True, "acme": False, "3 com": False, "": False, None: False, "Élan": True}),
        (names.acronym, {"General Big Motors": "GBM", "Two Words": "", "": ""}),
        (names.no_null_word, {" NaN ": "", "x ": "x", None: ""}),
        (names.partial_name, {"Wendy's": "WENDYS", "A's": "A S", "AT&T": "AT AND T"}),
        (names.recovery_name, {"Foo & Company": "FOO CO", "Bar and Co": "BAR CO", "Baz & Sons": "BAZ AND SONS", "Nestlé": "NESTLE"}),
        (names.is_category, {"commercial banks": True, "banks": False, "local widget companies": True, "Acme Bank": False}),
        (ids.clean_id, {"123.0": "123", " nan ": None, "": None, None: None, "-1": "-1"}),
        (ids.valid_id, {"123": True, "-88888": False, "-1.0": False, "": False, "None": False}),
        (ids.format_sic, {"283.0": "0283", "SIC 2834": "2834", "": "", "12345": "12345"}),
        (ids.filing_year, {"CIK1_10-K_20011231.txt": 2001, "x.txt": None}),
        (ids.confidence, {"0.9": 90.0, "1": 100.0, "7": 70.0, "85": 85.0, "150": 100.0, "x": 0.0, None: 0.0}),
        (lambda c: ids.format_years(ids.years(c)), {"2001; 1999 x2003 12001": "1999;2001", "": ""}),
        (T.split_list, {"a| b |": ["a", "b", ""], "": [], None: [], "nan": []}),
        (lambda c: F.transform(names.prefixes(c), lambda p: p), {"A B C D": ["A B C", "A B", "A"], "A": ["A"], "": []}),
        (lambda c: F.array_join(names.unsafe_continuation(c, F.lit("ACME")), ";"), {"ACME HEAVY INDUSTRIES": "", "ACME TOYS": "TOYS", "ACME": "", "OTHER CO": "OTHER"}),
    ],
)
def test_functions(spark, f, cases):
    assert column(spark, list(cases), f) == list(cases.values())


def test_variants_keep_order_and_first_name(spark):
    got = column(spark, ["Alpha Toys Inc / Beta Co", "Alpha and Beta", "Gamma Works (Delta Ltd)", "Epsilon and its affiliates", None], names.variants)
    assert [(v.name, v.method) for v in got[0]] == [
        ("ALPHA TOYS INC / BETA CO", "full_raw"), ("ALPHA TOYS INC / BETA", "full_raw_suffix_cleaned"), ("ALPHA TOYS INC", "slash_part_1"), ("ALPHA TOYS", "slash_part_1_suffix_cleaned"), ("BETA CO", "slash_part_2"),
    ]
    assert [v.method for v in got[1]] == ["full_raw", "and_part_1", "and_part_2"]
    assert [(v.name, v.method) for v in got[2]] == [("GAMMA WORKS", "full_raw"), ("DELTA LTD", "inside_parentheses")]
    assert ("EPSILON", "remove_and_affiliates") in [(v.name, v.method) for v in got[3]]
    assert got[4] == []


def test_snippets(spark):
    text = "x" * 150 + " rival " + "y" * 1500 + " rivals end\n\ncompetitiveness\n\n   \n\ncompete"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, body string")
    got = [(r.part, r.snippet) for r in T.snippets(df, ["k"], "body").orderBy("k", "part", "st").collect()]
    assert len(got) == 3 and got[0][1].startswith("...x") and got[0][1].endswith("y...") and got[1][1].endswith("rivals end") and got[2][1] == "compete"


def test_chunks_cover_text(spark):
    df = spark.createDataFrame([("abcdefghij", 3), ("", 2), ("ab", 5)], "x string, n int")
    got = [r[0] for r in df.select(T.chunks("x", F.col("n"))).collect()]
    assert got == [["abc", "def", "ghij"], [], ["a", "b"]]


def test_cascade_stages(spark):
    from mentionweave.plans import candidates as C

    aliases = spark.createDataFrame([(1, "Acme Inc", [2000]), (2, "Acme Ltd", [2000]), (3, "IBM", [2000]), (4, "Beta", [2000]), (5, "Beta Corp", [1990, 2001]), (6, "Gamma", [2000]), (7, "Acme Inc", [])], "record_id int, alias string, years array<int>")
    bridge = spark.createDataFrame(
        [("ACME INC", 2000, "DISCERN", "1", "11"), ("INTERNATIONAL BUSINESS MACHINES", 2000, "COMPUSTAT_US", "2", "22"), ("BETA", 1997, "SEC_HEADER", None, "33"), ("BETA", 2003, "SEC_HEADER", None, "33")],
        "name_original string, fyear int, source string, cik string, gvkey string",
    )
    panel = spark.createDataFrame([("1", "11", 2000)], "cik string, gvkey string, fyear int")
    got = {r.record_id: (r.stage, r.rule, r.distance) for r in C.cascade(aliases, bridge, panel).collect()}
    assert got == {1: (1, "exact_standardized_match", 0), 2: (2, "legal_form_normalization", 0), 3: (3, "approved_abbreviation_bridge_match", 0), 4: (4, "exact_other_year", 3), 5: (5, "legal_other_year", 2)}


def test_match_methods(spark):
    from mentionweave.plans import matcher

    bridge = spark.createDataFrame(
        [("ACME WIDGETS INC", 2000, "1", "11", "DISCERN"), ("ZETA PUMPS CORP", 2000, "2", "22", "CCM_COMPUSTAT_EXTENSION"), ("ZETA VALVES CORP", 2000, "3", "33", "COMPUSTAT_US"), ("OMEGA TOYS", 2000, "4", "44", "COMPUSTAT_GLOBAL"), ("SIGMA TECH", 2000, "5", "55", "COMPUSTAT_GLOBAL"), ("PI ONE", 2000, "6", "66", "DISCERN"), ("PI TWO", 2000, "7", "77", "DISCERN")],
        "name_original string, fyear int, cik string, gvkey string, source string",
    )
    raws = [("Acme Widgets, Inc.", 2000), ("Acme Widgets", 2000), ("Zeta Motors", 2000), ("Omega Games", 2000), ("Sigma Games", 2000), ("Pi Three", 2000), ("acme", 2000), ("", 2000), ("Acme", None), ("Acme Widgets", 1999)]
    got = {(r.raw, r.fyear): (r.method, r.gvkey) for r in matcher.match(spark.createDataFrame(raws, "raw string, fyear int"), bridge).collect()}
    assert got == {
        ("Acme Widgets, Inc.", 2000): ("exact_full_raw", "11"), ("Acme Widgets", 2000): ("exact_full_raw", "11"), ("Zeta Motors", 2000): ("parent_prefix_recovery_CCM_PRIORITY_full_raw", "22"),
        ("Omega Games", 2000): ("unmatched_after_all_candidates", None), ("Sigma Games", 2000): ("parent_prefix_recovery_ALL_SOURCES_full_raw", "55"), ("Pi Three", 2000): ("unmatched_after_all_candidates", None),
        ("acme", 2000): ("unmatched_invalid_or_lowercase", None), ("", 2000): ("unmatched_empty", None), ("Acme", None): ("unmatched_missing_fyear", None), ("Acme Widgets", 1999): ("unmatched_after_all_candidates", None),
    }


def test_generic_names_of_candidates(spark):
    from mentionweave.plans.candidates import generic_name

    told = {None: True, "": True, "12 34": True, "AB": True, "Holdings Group": True, "Tech Systems Capital Trust 17": True, "Tech Capital Trust 17": False, "Widget Fund": False, "Widget": False}
    rows = spark.createDataFrame([(x,) for x in told], "x string").select("x", generic_name("x").alias("g")).collect()
    assert {r.x: r.g for r in rows} == told
