"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filteraudit, language, licenses, mixing, neardup_vectors, replytrees, simhash, suffixes, topk, toxicity, urlfilter, whitening
from .common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return judged.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.build(pages))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.components(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a tree of one branch; conversation -1 is added, beside one of that id if there is one."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    messages = replytrees.chained(turns).unionByName(replytrees.chained(added, "+"))
    return replytrees.read_back(replytrees.conversations(messages, carried=("conv_id",)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_suffixes": op4_suffixes,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_language": op7_language,
    "op8_topk": op8_topk,
    "op9_urls": op9_urls,
    "op10_vectors": op10_vectors,
    "op11_whitening": op11_whitening,
    "op12_filters": op12_filters,
    "op13_trees": op13_trees,
}

_T = licenses.Templates()

ORACLE_SQL: dict[str, str] = {
    "op6_licenses": """
with tpl(k, license, longer, least, notice) as (values """ + ", ".join(f"({k}, '{n}', {x}, {t}, '{' '.join(w)}')" for k, (n, x, t, w) in enumerate(zip(_T.names, _T.longer, _T.least, _T.terms, strict=True))) + """),
need(k, t) as (values """ + ", ".join(f"({k}, '{t}')" for k, terms in enumerate(_T.needed) for t in terms) + """), needs as (select k, count(*) needs from need group by 1),
tt as (select k, t, count(*) tf from (select k, unnest(string_split(notice, ' ')) t from tpl) group by all),
voc as (select distinct t from tt),
n as (select count(*) n from documents),
df as (select t, count(*) df from (select unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) t from documents) semi join voc using (t) group by t),
idf as (select t, ln((1 + n) / (1 + coalesce(df, 0))::double) + 1 w from voc left join df using (t), n),
vec as (select k, t, tf * w / sqrt(sum(tf * w * tf * w) over (partition by k)) w from tt join idf using (t)),
docs as (select row_number() over () r, doc_id, lower(text) x, source || '/' || lang || '/' || doc_id path, source || '/' || lang dir from documents),
kinds as (select r, 0 kind, unnest(string_split(x, chr(10))) unit from docs union all select r, 1, unnest(string_split_regex(x, '\\n[ \\t\\r]*\\n')) from docs union all select r, 2, x from docs),
un as (select distinct r, kind, unit from kinds where regexp_matches(unit, '(^|[^a-z0-9])(' || (select string_agg(t, '|') from voc) || ')([^a-z0-9]|$)')),
u as (select row_number() over () u, kind, unit from (select distinct kind, unit from un)),
lf as (select u, kind, t, count(*) tf from (select u, kind, unnest(regexp_extract_all(unit, '[a-z0-9]+')) t from u) group by all),
lw as (select u, kind, t, tf, coalesce(w, (select ln(1 + n) + 1 from n)) w from lf left join idf using (t)),
norm as (select u, sqrt(sum(tf * w * tf * w)) norm, sum(tf) terms from lw group by all),
sc as (select u, v.k, license, least, any_value(terms) terms, round(sum(l.tf * l.w * v.w) / any_value(norm), 6) score, count(need.t) held from lw l join vec v using (t) join tpl on v.k = tpl.k and longer = (kind > 0) join norm using (u) left join need on need.k = v.k and need.t = l.t group by u, v.k, license, least),
best as (select *, row_number() over (partition by u order by score desc, k) c from sc left join needs using (k) where score >= least and held = coalesce(needs, 0)),
second as (select b.u, max(o.score) score from best b join best o on b.u = o.u and b.license <> o.license where b.c = 1 group by 1),
met as (select r, un.kind, b.* from un join u using (kind, unit) join best b using (u) left join second s using (u) where c = 1 and (s.score is null or round(b.score - s.score, 6) >= """ + str(licenses.MARGIN) + """)),
per as (select r, kind, sum(terms) covered from met group by all),
own as (select m.r, arg_max(license, struct_pack(s := score, k := -k)) license, max(score) score, any_value(p.covered) covered from met m join (select r, max(covered) covered from per group by 1) p using (r) group by m.r),
judged as (select d.doc_id, path, dir, license, score, covered / len(regexp_extract_all(x, '[a-z0-9]+')) >= 0.5 speaks from docs d left join own using (r)),
files as (select dir up, license, score, row_number() over (partition by dir order by score desc, license) r from judged where license is not null and speaks),
near as (select d.dir, f.up, f.license, f.score, row_number() over (partition by d.dir order by length(f.up) desc) r
         from (select distinct dir from judged) d join files f on f.r = 1 and (d.dir = f.up or starts_with(d.dir, f.up || '/')))
select doc_id, path, coalesce(j.license, n.license) license, case when j.license is not null then 'own' when n.license is not null then 'inherited' end origin,
       coalesce(j.score, n.score) score, case when j.license is null then n.up end license_dir
from judged j left join near n on j.dir = n.dir and n.r = 1
""",
    "op8_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) i from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(c.i) + 1), lambda k: q.i[k] * c.i[k]))::bigint score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::int rank, vec_id, score from r where rank <= 5
""",
    "op9_urls": """
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end s from pages),
b as (select page_id, translate(regexp_extract(s, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(s, '^[^/?#]*([^?#]*)', 1) path from a),
r(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select page_id, h || p rule, v, row_number() over (partition by page_id order by length(h || p) desc) k
      from b join r on (host = h or host like '%.' || h) and starts_with(path, p))
select b.page_id, host, path, rule, coalesce(v, 'allow') verdict from b left join m on b.page_id = m.page_id and k = 1
""",
    "op10_vectors": """
with recursive v as (select vec_id, embedding, list_transform(embedding, lambda x: x::double) e from embeddings),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from v
      where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_sum(list_transform(range(1, len(a.e) + 1), lambda k: a.e[k] * b.e[k])) >= 0.9),
c(x, y) as (select vec_id, vec_id from v union select c.x, p.b from c join p on c.y = p.a),
n as (select a, count(*) n from p group by a), m as (select x, min(y) m from c group by x)
select vec_id, coalesce(n, 0)::bigint n_links, m component_id, vec_id = m kept from v left join n on a = vec_id join m on x = vec_id
""",
    "op12_filters": r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') words, min(doc_id) over (partition by t) least from d),
l as (select doc_id, max(coalesce(quality = 1, false)) good, max(coalesce(toxic = 1, false)) toxic from labels group by 1),
m as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
             (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int mask from w left join l using (doc_id)),
h as (select part, mask, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) f),
o as (select a.f || b.f || c.f || d.f || e.f filter_order from f a, f b, f c, f d, f e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, step, 1 << (ascii(filter_order[step]) - 65) bit, list_sum([0] || list_transform(string_split(left(filter_order, step - 1), ''), lambda x: case when x = '' then 0 else 1 << (ascii(x) - 65) end)) gone
      from o, (select unnest(range(1, 6)) step)),
r as (select part, filter_order, step, bit, coalesce(sum(n) filter (mask & bit = 0 and mask & gone = 0), 0) kept, coalesce(sum(n) filter (mask & bit <> 0 and mask & gone = 0), 0) removed,
             coalesce(sum(n) filter (mask & bit <> 0 and mask & gone <> 0), 0) redundant, coalesce(sum(n) filter (mask = bit), 0) unique_fails,
             coalesce(sum(good) filter (mask & bit <> 0 and mask & gone = 0), 0) good_lost, coalesce(sum(toxic) filter (mask & bit <> 0 and mask & gone = 0), 0) toxic_lost from h, s group by all)
select part, filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint shapley from r
""",
    "op13_trees": r"""
with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text, false added from conversations
           union all select -1, k, case when k = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]', true from range(2) r(k)),
e as (select *, len(regexp_extract_all(role || chr(10) || text, '[<\[]\\*(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)')) marks from t)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) loss_sha256,
       sum(length(role) + length(text) + marks + 17)::bigint formatted_chars
from e group by conv_id, added
""",
}
