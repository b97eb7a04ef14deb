"""Queries read whole tables and whole texts."""

from __future__ import annotations

from mentionweave import registry

from .compare import SF

QUERIES = registry.queries()


def folder(tmp_path, spark, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
DOCUMENTS = "doc_id long, text string, lang string"


def test_generic_score_reads_whole_texts_of_all_languages(spark, tmp_path):
    late = "x" * 70 + " local zzz"
    sf = folder(tmp_path, spark, part=([(1, "red widget", "Brand#1", "STEEL", 1)], PART), documents=([(1, late, "en"), (2, late, "de"), (3, late, None)], DOCUMENTS))
    got = {r.doc_id: r.generic_score for r in QUERIES["generic_score"](spark, sf).collect()}
    assert got[1] == got[2] == got[3] == 1


def test_text_cleaning_reads_every_document(spark, tmp_path):
    sf = folder(tmp_path, spark, documents=([(1, "a", "en"), (2, "bc", "en"), (None, "def", None)], DOCUMENTS))
    got = {r.doc_id: r.n for r in QUERIES["text_cleaning"](spark, sf).collect()}
    assert set(got) == {1, 2, None} and got[None] == got[1] + 2


def test_relational_queries_read_whole_tables(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert QUERIES["mixed_sort"](spark, SF).count() == orders
    assert QUERIES["conflict_repair"](spark, SF).count() == part.count()
    assert QUERIES["recovery_resolved"](spark, SF).select("record_id").distinct().count() == part.count()
    assert QUERIES["manual_alias_bridge"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert QUERIES["first_key_fanout"](spark, SF).count() == part.selectExpr("explode(array(p_brand, p_type)) as k").distinct().count()
    assert QUERIES["unique_or_blank"](spark, SF).count() == part.select("p_name", "p_size").distinct().count()
