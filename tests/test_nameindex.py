"""The kept name index: same results as the bridge itself, no exchange on its side, and new names alone normalised by a later run."""

from __future__ import annotations

import re

import pytest

from mentionweave.plans import bridges, candidates, matcher, nameindex, rescue
from mentionweave.plans.derived import bridge, mentions
from mentionweave.sources import kept

from .compare import SF


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("part", "orders", "lineitem")}


@pytest.fixture(scope="module")
def listed(tables):
    return bridge(tables["part"])


@pytest.fixture(scope="module")
def index(listed):
    return nameindex.kept_index(listed)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def aliases(part):
    return part.selectExpr("p_partkey as record_id", "concat('K', p_partkey % 5000, ' ', p_name, ' Inc') as alias", "array(cast(1995 + p_partkey % 6 as int)) as years")


def panel(part):
    return part.selectExpr("concat(p_partkey, '.0') as cik", "lpad(cast(p_partkey as string), 6, '0') as gvkey", "cast(1995 + p_partkey % 8 as int) as fyear")


def test_same_results_as_from_the_bridge(tables, listed, index):
    m = mentions(tables["lineitem"], tables["orders"], tables["part"])
    assert bag(matcher.match(m, index)) == bag(matcher.match(m, listed))
    assert bag(matcher.prefix_table(index)) == bag(matcher.prefix_table(listed))
    assert bag(bridges.prefix_diagnostics(index)) == bag(bridges.prefix_diagnostics(listed))
    a, p = aliases(tables["part"]), panel(tables["part"])
    got, want = candidates.cascade(a, index, p), candidates.cascade(a, listed, p)
    assert want.count() > 0 and bag(got) == bag(want)
    keyed = rescue.keyed(a, "alias")
    columns = ["record_id", "kind", "candidate", "fyear", "cik", "gvkey", "source", "b_exact"]
    got, want = rescue.meets(keyed, index), rescue.meets(keyed, listed.withColumnRenamed("name_original", "candidate"))
    assert want.count() > 0 and bag(got.select(columns)) == bag(want.select(columns))


def below(plan: str, scan: str) -> list[str]:
    """The nodes between each scan of a table and the join or group above it."""
    lines, out = plan.splitlines(), []
    for at, line in enumerate(lines):
        if "FileScan" in line and scan in line:
            depth, k = line.index("FileScan"), at - 1
            while k >= 0:
                place = re.search(r"[A-Za-z]", lines[k])
                if place and place.start() < depth:
                    depth = place.start()
                    if re.search(r"Join|Window |Aggregate", lines[k][depth:].split("[")[0].split("(")[0]):
                        break
                    out.append(lines[k][depth:])
                k -= 1
    return out


def test_no_exchange_on_the_index_side(tables, index, no_broadcast):
    a, p = aliases(tables["part"]), panel(tables["part"])
    m = mentions(tables["lineitem"], tables["orders"], tables["part"])
    readers = {
        "match": (matcher.match(m, index), index._probes.name), "prepared": (matcher.prepare_bridge(index), index.table.name), "identities": (candidates.identities(index), index.table.name),
        "meets": (rescue.meets(rescue.keyed(a, "alias"), index), index.table.name),
    }
    for name, (df, scan) in readers.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        between = below(plan, scan)
        assert "Bucketed: true" in plan and not [x for x in between if x.startswith("Exchange")], (name, between)


def test_a_second_run_normalises_new_names_alone(spark, tmp_path, monkeypatch):
    schema = "name_original string, fyear int, cik string, gvkey string, source string"
    first = spark.createDataFrame([("Acme Holdings Inc", 2000, "1.0", None, "DISCERN"), ("Acme Holdings Inc", 2001, "1.0", None, "DISCERN"), (None, 2000, "9", None, "DISCERN"), ("Zeta Co", 2000, "2", None, None)], schema)
    path = str(tmp_path / "index")
    nameindex.NameIndex(spark, path, ("match",), buckets=4).extend(first)
    seen = []
    keys_of = nameindex.keys_of
    monkeypatch.setattr(nameindex, "spread", lambda df, *keys: seen.append({r.raw for r in df.collect()}) or df)
    monkeypatch.setattr(nameindex, "keys_of", keys_of)
    again = nameindex.NameIndex(spark, path, ("match",), buckets=16)  # buckets are those that were written
    assert again.table.buckets == 4
    again.extend(first)
    assert seen == []  # nothing is new, and no pattern runs
    later = spark.createDataFrame([("Zeta Co", 2000, "2", None, None), ("Zeta Co", 2001, "2", None, None), ("New Name Ltd", 2000, None, "7", "COMPUSTAT_US")], schema)
    again.extend(first.unionByName(later)).extend(later)
    assert seen == [{"Zeta Co", "New Name Ltd"}]
    assert bag(matcher.prepare_bridge(again)) == bag(matcher.prepare_bridge(first.unionByName(later).distinct()))
    asked = spark.createDataFrame([("New Name Limited", 2000), ("Zeta Co", 2001), ("Acme Holdings", 2001), ("Nobody", 2000)], "raw string, fyear int")
    assert bag(matcher.match(asked, again)) == bag(matcher.match(asked, first.unionByName(later).distinct()))
    with pytest.raises(ValueError, match="not of"):
        again.under("exact")


def test_an_empty_bridge(spark):
    none = spark.createDataFrame([], "name_original string, fyear int, cik string, gvkey string, source string")
    index = nameindex.kept_index(none)
    assert matcher.match(spark.createDataFrame([("A", 2000)], "raw string, fyear int"), index).first().method == "unmatched_after_all_candidates"
    assert candidates.identities(index).count() == 0 and index.under("row").count() == 0


def test_the_shared_folder(spark):
    assert kept.shared_dir(spark).startswith("file:") or kept.shared_dir(spark).startswith("/")
    assert kept.written(spark.range(3), "x").count() == 3
