"""Rescue and residual recovery where a name has many records and many identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionweave.plans import rescue


def _alike(spark, copies=1):
    """Thirty records of one name, one with two aliases and one twice; identities by year, by panel and of outside lists, some in several lists."""
    rows = [(k, "Acme" if k % 2 else "Acme Inc", [1995 + k % 3]) for k in range(30)] + [(40, "Acme", [1995]), (40, "Other Co", [1996]), (41, "Acme", [1995]), (41, "Acme", [1995]), (42, None, [1995]), (43, "Inc", [1995]), (None, "Acme", [1996])]
    aliases = spark.createDataFrame(rows, "record_id long, alias string, years array<int>")
    ident = lambda k: (None if k % 3 == 0 else f"{k}.0", "-1" if k % 4 == 0 else str(k % (25 * copies)))
    name = lambda k: ("Acme", "ACME INC", "Other Limited", "Inc", None)[k % 5]
    n = range(60 * copies)
    bridge = spark.createDataFrame([(name(k), None if k % 11 == 0 else 1995 + k % 4, *ident(k), ("DISCERN", "SEC_HEADER", None)[k % 3]) for k in n], "candidate string, fyear int, cik string, gvkey string, source string")
    known = spark.createDataFrame([(name(k), *ident(k), ("WRDS_LOOKUP", None)[k % 2]) for k in n], "candidate string, cik string, gvkey string, source string")
    panel = spark.createDataFrame([(*ident(k), 1995 + k % 3) for k in n], "cik string, gvkey string, fyear int")
    outside = spark.createDataFrame([(name(k), None, f"T{k}" if k % 6 == 2 else "", ("REPRISK", "TRUCOST", "CAPITAL_IQ")[k % 3]) for k in n], "candidate string, cik string, gvkey string, source string")
    return aliases, bridge, known, panel, outside


def _bag(df) -> list[str]:
    return sorted(str(tuple(sorted((k, str(v)) for k, v in r.asDict(recursive=True).items() if k not in ("flags", "kind")))) for r in df.collect())


def test_recovered_is_what_all_candidates_say(spark, monkeypatch):
    kept, rows = rescue.written, {}

    def written(df, name):
        out = kept(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(rescue, "written", written)
    aliases, *lists = _alike(spark)
    want = rescue.resolved(aliases.drop("years"), rescue.residual(aliases.where("record_id <> 40"), *lists))
    alone = lambda df: df.where("record_id <> 40 or record_id is null").drop("years")
    columns = ["record_id", "alias", "source", "candidate", "gvkey", "cik", "rule", "score", "n_candidates", "n_public_ids", "n_names", "sources_all", "rules_all", "suggestion", "reason"]
    found = rescue.recovered(aliases, *lists)
    assert _bag(alone(found).select(columns)) == _bag(alone(want).select(columns))
    met, before = rows["residual-met"], found.agg(F.max("n_candidates")).first()[0]
    more = rescue.recovered(aliases, *_alike(spark, 4)[1:])
    assert more.agg(F.max("n_candidates")).first()[0] > 2 * before
    assert rows["residual-met"] < 1.5 * met  # more identities are few more kinds; a row for each pair before


def test_rescued_pairs_are_ranked_where_they_met(spark, monkeypatch):
    aliases, *lists = _alike(spark)
    found = rescue.rescue(aliases, *lists)
    want = _bag(found)
    sole = rescue.rescue(aliases.where("record_id < 40"), *lists)
    plan = sole._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Exchange") == plan.count("Exchange hashpartitioning(group") == 2  # records and lists alone
    monkeypatch.setattr(rescue, "PAIRS", 100)
    monkeypatch.setattr(rescue, "TOGETHER", 2)
    cut = rescue.rescue(aliases, *lists)
    assert _bag(cut) == want
    plan = rescue.rescue(aliases.where("record_id < 40"), *lists)._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan and "Exchange hashpartitioning(record_id" not in plan
    ranks = found.groupBy("record_id").agg(F.count("*").alias("n"), F.count_distinct("candidate_rank").alias("d"), F.max("candidate_rank").alias("m"))
    assert ranks.count() == 33 + 1 and ranks.where("n <> d or n <> m").count() == 0  # record 42 has no name
    assert {r.alias for r in found.where("record_id = 40").collect()} == {"Acme", "Other Co"}
