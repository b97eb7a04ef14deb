"""Texts as their SQL reads them: none, empty, of other letters than ASCII's, and several of one id."""

from __future__ import annotations

import duckdb
import pytest

from mentionweave import registry

from .compare import rows

TEXTS = [
    (0, None), (1, ""), (2, "x"), (3, "é" * 2001), (None, "y"), (None, ""),
    (4, "éthe end"), (5, "theé"), (6, "中the文"), (7, "LICENſE"), (8, "the and_the the2"), (9, "the" + "x" * 3000 + " and the"), (10, "٣the"), (11, "b́and"),
    (12, "the " + "x" * 5000 + " and"), (12, "x" * 2000 + " license " + "y" * 9000 + " the"), (12, "the"), (None, "the"), (None, "z" * 4000 + " and"),
]


@pytest.mark.parametrize("name", ["chunks", "snippets"])
def test_odd_texts(spark, tmp_path, name):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    duck = duckdb.connect()
    duck.sql("set threads = 1")
    duck.sql(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert len(want) > 10 and rows(got) == rows(want)
