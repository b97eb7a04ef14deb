"""Steps whose work must not grow faster than their input: each is held against a plain version on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionweave.functions import text as T
from mentionweave.operators import joins as J
from mentionweave.plans import candidates as C
from mentionweave.plans import matcher, nameindex, rescue
from mentionweave.sources import html


def test_parts_are_cut_in_one_pass(spark):
    def plain(x: str, n: int) -> list[str]:
        size = max(len(x) // n, 1)
        return [p for p in [x[k * size : (k + 1) * size] for k in range(n - 1)] + [x[(n - 1) * size :]] if p]

    rows = [(x, n) for x in ("", "a", "ab\ncd\r\n e", "é\U0001f600日本 x\n" * 9, "abcdefg" * 31) for n in (1, 2, 3, 7, 40)]
    df = spark.createDataFrame(rows, "x string, n int")
    assert all(r.parts == plain(r.x, r.n) for r in df.select("x", "n", T.chunks("x", F.col("n")).alias("parts")).collect())
    assert spark.createDataFrame([(None,)], "x string").select(T.chunks("x", F.lit(3)).alias("p")).first().p == []
    # The estimate stands outside what runs for each part.
    plan = df.select(T.token_chunks("x", 500))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[A-Za-z]+") <= 8 and "substr" not in plan


def _collected(df) -> list[str]:
    """The plan's joins that collect a side on the driver, but for the semi-joins on first words."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x for x in plan if "BroadcastHashJoin" in x and "__first" not in x]


def _listings(spark):
    """More names than their files' size tells: a size from the file would have them broadcast."""
    made = spark.range(200)
    aliases = made.selectExpr("id as record_id", "concat('Acme', id) as alias", "array(2000) as years")
    bridge = made.selectExpr("concat('Acme', id, ' Inc') as candidate", "2000 as fyear", "cast(id as string) as gvkey", "cast(null as string) as cik", "'CIQ_COMMON' as source")
    panel = made.selectExpr("cast(id as string) as gvkey", "cast(null as string) as cik", "2000 as fyear")
    return aliases, bridge, panel


def test_rescue_collects_no_names_on_the_driver(spark):
    aliases, bridge, panel = _listings(spark)
    listed = bridge.drop("fyear")
    found = rescue.rescue(aliases, bridge, listed, panel, listed)
    assert _collected(found) == []
    assert found.where("rule = 'legal_year_specific'").count() == 200 and found.where("rule = 'identifier_legal_validated'").count() == 200


def test_residual_collects_no_names_on_the_driver(spark):
    aliases, bridge, panel = _listings(spark)
    listed = bridge.drop("fyear")
    found = rescue.resolved(aliases.drop("years"), rescue.residual(aliases, bridge, listed, panel, listed))
    assert _collected(found) == []
    assert {(r.rule, r.score, r.suggestion) for r in found.collect()} == {("legal_year_specific", 90, "recovered_public_identifier")}


def test_pairs_of_a_hot_key_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL", 8)
    monkeypatch.setattr(J, "PAIRS", 100)
    left = spark.createDataFrame([(i, "hot" if i < 60 else "cold") for i in range(63)] + [(70, ""), (71, None)], "s int, k string")
    right = spark.createDataFrame([(i, "hot" if i < 90 else "cold") for i in range(92)] + [(99, "")], "c int, x string")
    out = J.either_key(left, right, [("k", "x", "exact")])
    each = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in each) == out.distinct().count() == 60 * 90 + 3 * 2
    assert max(r["count"] for r in each) < 1000  # in one task before


def test_dated_candidates_are_made_distinct_before_they_meet(spark):
    aliases = spark.createDataFrame([(1, "Acme Inc", [1996]), (1, "ACME, Inc.", [1996]), (2, "Acme", [2005])], "record_id long, alias string, years array<int>")
    listing = spark.createDataFrame([("7", "us 1", "Acme Inc", "1995-01-01", "1999-01-01")] * 3, "companyid string, isin string, candidate string, startdate string, enddate string")
    crosswalk = spark.createDataFrame([("7.0", "5", "1995-01-01", "1997-12-31")] * 2, "companyid string, gvkey string, startdate string, enddate string")
    found = rescue.dated_recovery(aliases, listing, crosswalk)
    rows = {(r.record_id, r.rule, r.isin, r.ciq_gvkey, r.upgrade, r.candidate_rank) for r in found.collect()}
    assert rows == {(1, "ciq_common_exact_name", "US1", "5", True, 1), (1, "ciq_common_legal_name", "US1", "5", True, 2), (2, "ciq_common_legal_name", "US1", "5", False, 1)} and found.count() == 3
    assert _collected(found) == []
    moved = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(record_id" in x and "enddate" in x.split("],")[0]]
    assert moved == []  # what met is moved by its record alone, once


def test_names_of_a_bridge_are_read_once_each(spark):
    row = [("Acme Inc", 1995, "1", "2", "X"), ("Acme Inc", 1995, None, "2", "Y"), ("ACME INC", 1995, "1", "2", "Z"), (None, 1995, "1", "2", "X"), ("Sole Ltd", 1995, "1", "2", "X")]
    bridge = spark.createDataFrame(row, "name_original string, fyear int, cik string, gvkey string, source string")
    found = matcher.bridge_conflicts(bridge)
    assert ("ACME INC", 3, 2) in {(r.name, r.n_rows, r.n_identities) for r in found.collect()} and not any(r.name.startswith("SOLE") for r in found.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and _collected(found) == []  # distinct names and their rows; four readings of the bridge before


def test_blocked_readings_are_made_once_a_name(spark):
    mentions = spark.createDataFrame([("Acme Widgets Inc", y) for y in (1995, 1996, 1997)], "raw string, fyear int")
    bridge = spark.createDataFrame([("Acme Widgets Foods", y, "1", "2", "COMPUSTAT_GLOBAL") for y in (1995, 1996)], "name_original string, fyear int, cik string, gvkey string, source string")
    found = matcher.blocked(mentions, bridge)
    assert {(r.fyear, r.prefix, r.unsafe) for r in found.collect()} >= {(1995, "ACME WIDGETS", "FOODS"), (1996, "ACME WIDGETS", "FOODS")}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    k = next(i for i, x in enumerate(plan) if "Generate explode" in x and "parent" in x)
    below = next(x for x in plan[k + 1 :] if "Aggregate [" in x)
    assert "fyear" not in below  # names are distinct without their years where they are read


def test_records_of_one_request_share_its_candidates(spark):
    aliases = spark.createDataFrame([(k, "Acme" if k % 2 else "Other Co", [1995]) for k in range(40)], "record_id long, alias string, years array<int>")
    requests, members = C.asked_once(aliases)
    assert {(r.record_id, r.alias) for r in requests.collect()} == {(0, "Other Co"), (1, "Acme")}
    bridge = spark.createDataFrame([("Acme", 1995, "DISCERN", str(k), str(k)) for k in range(30)], "name_original string, fyear int, source string, cik string, gvkey string")
    panel = spark.createDataFrame([("1", "1", 1995)], "cik string, gvkey string, fyear int")
    few = C.cascade(requests, bridge, panel)
    assert few.count() == 30  # 600 before the records' ids are joined
    both = [sorted(map(str, x.select("record_id", "bridge_name", "gvkey", "stage").collect())) for x in (C.for_all(few, members), C.cascade(aliases, bridge, panel))]
    assert both[0] == both[1] and len(both[0]) == 600


def _named_alike(spark):
    """Thirty records and two hundred identities of one name, a record that has two aliases and one that has the same alias twice."""
    rows = [(k, "Acme" if k % 2 else "Acme Inc", [1995 + k % 3]) for k in range(30)] + [(40, "Acme", [1995]), (40, "Acme Ltd", [1996]), (41, "Acme", [1995]), (41, "Acme", [1995]), (42, None, [1995]), (None, "Acme", [1995])]
    aliases = spark.createDataFrame(rows, "record_id long, alias string, years array<int>")
    bridge = [("Acme" if k % 4 else "ACME INC", 1995 + k % 5, ("DISCERN", "sec_header", None)[k % 3], str(k) if k % 7 else None, f"{k:06d}" if k % 6 else "-1") for k in range(200)]
    return aliases, spark.createDataFrame(bridge, "name_original string, fyear int, source string, cik string, gvkey string"), spark.createDataFrame([("1", "1", 1995)], "cik string, gvkey string, fyear int")


def test_stages_are_told_for_kinds_of_identities(spark, monkeypatch):
    aliases, bridge, panel = _named_alike(spark)
    kept, rows = C.written, {}

    def written(df, name):
        out = kept(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(C, "written", written)
    found = C.cascade(aliases, bridge, panel)
    assert found.count() == 690
    more = bridge.withColumns({"cik": F.concat("cik", F.lit("7")), "gvkey": F.when(F.col("gvkey") == "-1", "-1").otherwise(F.concat("gvkey", F.lit("7")))})
    met = rows["cascade-met"]
    assert C.cascade(aliases, bridge.unionByName(more), panel).count() > 1300
    assert rows["cascade-met"] == met  # twice the identities are no more kinds; a row for each pair before


def test_ranks_by_kinds_are_those_of_identities(spark, monkeypatch):
    monkeypatch.setattr(C, "RANKS", 4)
    aliases, bridge, panel = _named_alike(spark)
    inside = F.coalesce(F.col("cik").isNotNull() & (F.substring("gvkey", -1, 1) == "0"), F.lit(False))
    kinds, members = C.alike(bridge, inside)
    scored = C.score(C.first_stage(aliases, kinds, members, panel).join(aliases.select("record_id", "alias"), "record_id").withColumn("in_panel", inside))
    got, want = C.rank_kinds(scored), C.rank(C.score(C.cascade(aliases, bridge, panel).join(aliases.select("record_id", "alias"), "record_id").withColumn("in_panel", inside)))
    bag = lambda df: sorted(map(str, df.select("record_id", "bridge_name", "source", "rule", "score", "candidate_rank", "recommended").collect()))
    assert bag(got) == bag(want) == bag(C.rank(C.each_identity(scored, members))) and got.count() > 690
    assert {r.candidate_rank for r in got.where("record_id = 41").collect()} == set(range(1, got.where("record_id = 41").count() + 1))


def test_one_recommended_kind_is_one_identity(spark):
    row = ("Acme", "X", "exact_standardized_match", True)
    cases = {1: [(*row, "1", "1", 90, 1)], 2: [(*row, "1", "1", 90, 2)], 3: [(*row, "1", "1", 90, 1), (*row, "1", None, 70, 1)], 4: [(*row, "1", "1", 90, 1), (*row, "1", None, 60, 3)]}
    scored = spark.createDataFrame([(k, *x) for k, v in cases.items() for x in v], "record_id long, bridge_name string, source string, rule string, in_panel boolean, cik string, gvkey string, score int, n long")
    got = {(r.record_id, r.candidate_rank): r.recommended for r in C.rank_kinds(scored).collect()}
    assert got == {(1, 1): True, (2, 1): False, (2, 2): False, (3, 1): False, (3, 2): False, (4, 1): True, (4, 2): False, (4, 3): False, (4, 4): False}


def test_keys_of_a_bridge_are_worked_out_above_its_distinct_names(spark, monkeypatch):
    plans, add = [], nameindex.kept.Bucketed.add
    monkeypatch.setattr(nameindex.kept.Bucketed, "add", lambda self, rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or add(self, rows))
    _, bridge, _ = _named_alike(spark)
    nameindex.kept_index(bridge, "cascade")
    assert len(plans) == 1 and [x for x in plans[0].splitlines() if "Filter" in x and "regexp_replace" in x] == []


def test_pages_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    pages = spark.range(0, 200, 1, 1).selectExpr("id as page_id", "concat('<p>', id, '</p>') as html")
    got = {r.page_id: r.text for r in html.visible_text(pages, "page_id", markdown=True).collect()}
    assert got == {k: str(k) for k in range(200)} and spark.conf.get(key, None) == html.BATCH
