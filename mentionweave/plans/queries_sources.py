"""Queries that run sources and model steps on the given tables. Their results have no SQL form but for extraction's counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import html, model
from .registering import collection

query, QUERIES, ORACLES = collection()


@query("html_text")
def _(t):
    return html.visible_text(t("pages"), "page_id")


@query("html_markdown")
def _(t):
    return html.visible_text(t("pages"), "page_id", markdown=True)


@query("markdown_counts", """with b as (select page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') h from pages)
select page_id, len(regexp_extract_all(h, '<li[ >]'))::int n_items, len(regexp_extract_all(h, '<h[1-6][ >]'))::int n_headings, len(regexp_extract_all(h, '<a [^>]*href="[^"]+"'))::int n_links, len(regexp_extract_all(h, '<tr[ >]'))::int n_rows from b""")
def _(t):
    found = html.visible_text(t("pages"), "page_id", markdown=True)
    lines = F.split("text", "\n")
    having = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    rows = having(r"^ *(\* |> )*\| ") - having(r"^ *\|( --- \|)+$")
    return found.select("page_id", having(r"^ *\* \S").alias("n_items"), having("^#{1,6} ").alias("n_headings"), F.regexp_count("text", F.lit(r"\]\([^)]+\)")).alias("n_links"), rows.alias("n_rows"))


@query("extracted_names")
def _(t):
    passages = T.snippets(t("documents"), ["doc_id"], "text", ["license", "licensed", "released"], before=100, after=200)
    return model.extract_names(passages, "doc_id", "snippet")


@query("model_requests", "select ((row_number() over (order by p_name) - 1) // 25)::bigint batch, p_name from (select distinct p_name from part)")
def _(t):
    batches = T.requests(t("part").select("p_name").distinct(), "p_name", ["p_name"], 25)
    return batches.select("batch", F.explode(F.from_json("records", "array<struct<p_name: string>>")).alias("r")).select("batch", "r.p_name")


@query("classified_residuals", """select p_partkey record_id, case p_partkey % 3 when 0 then 'company' when 1 then 'technical_term' else 'unclear' end llm_classification, case p_partkey % 3 when 0 then 'accept' when 1 then 'drop' else 'manual_review' end llm_decision from part""")
def _(t):
    rows = t("part").selectExpr("p_partkey as record_id", "case p_partkey % 3 when 0 then concat(p_name, ' Inc') when 1 then 'a nanometer line' else p_name end as x")
    return model.classify(rows, "x").select("record_id", "llm_classification", "llm_decision")
