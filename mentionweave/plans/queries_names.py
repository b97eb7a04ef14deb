"""Queries on names, identifiers, years, text and records, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import ids, names
from ..functions import synonyms as Y
from ..functions import text as T
from ..operators import aggregates as A
from ..sources import model, tables
from . import oracle as S
from .derived import COMPANIES_SQL, companies
from .queries_resolution import _split
from .registering import collection

query, QUERIES, ORACLES = collection()

_N = f"with {COMPANIES_SQL} select p_partkey, "


@query("std_names", f"{_N} {S.standard('raw')} name, {S.uniform('raw')} uniform_name from companies")
def _(t):
    return companies(t("part")).select("p_partkey", names.standard("raw").alias("name"), names.uniform("raw").alias("uniform_name"))


@query("parent_recovery", f"{_N} {S.owner('raw')} owner_name from companies")
def _(t):
    return companies(t("part")).select("p_partkey", names.owner("raw").alias("owner_name"))


@query("suffix_cleaned", f"with {COMPANIES_SQL}, s as (select p_partkey, {S.standard('raw')} n from companies) select p_partkey, {S.safe_core('n')} safe_name, {S.strip_suffixes('n')} stripped, {S.canonical('n')} canonical_name from s")
def _(t):
    s = companies(t("part")).select("p_partkey", names.standard("raw").alias("n"))
    return s.select("p_partkey", names.safe_core("n").alias("safe_name"), names.strip_suffixes("n").alias("stripped"), names.canonical("n").alias("canonical_name"))


@query("legal_removed_key", f"with {COMPANIES_SQL}, s as (select p_partkey, {S.standard('raw')} n from companies) select p_partkey, {S.without_legal('n')} legal_key from s")
def _(t):
    return companies(t("part")).select("p_partkey", names.without_legal_terms(names.standard("raw")).alias("legal_key"))


@query("alnum_key", f"{_N} {S.alnum('raw')} alnum from companies")
def _(t):
    return companies(t("part")).select("p_partkey", names.alnum_key("raw").alias("alnum"))


@query("recovery_name", f"{_N} {S.recovery('raw')} recovery_key from companies")
def _(t):
    return companies(t("part")).select("p_partkey", names.recovery_name("raw").alias("recovery_key"))


@query("legal_form_spacing", f"with s as (select p_partkey, 'K' || p_partkey || case p_partkey % 6 when 0 then ' S A R L' when 1 then ' G M B H' when 2 then ' S A' when 3 then ' P L C' when 4 then ' N  V' else ' A S B' end n from part) select p_partkey, {S.close_up('n')} closed from s")
def _(t):
    ending = F.expr("concat('K', cast(p_partkey as string), case p_partkey % 6 when 0 then ' S A R L' when 1 then ' G M B H' when 2 then ' S A' when 3 then ' P L C' when 4 then ' N  V' else ' A S B' end)")
    return t("part").select("p_partkey", names.close_up(ending).alias("closed"))


@query("capital_gate", f"{_N} {S.capital('raw')} capital from companies")
def _(t):
    return companies(t("part")).select("p_partkey", names.capital("raw").alias("capital"))


@query("acronym", f"with {COMPANIES_SQL}, s as (select p_partkey, {S.tokens('raw')} k from companies) select p_partkey, case when len(k) >= 3 then upper(array_to_string(list_transform(k, lambda w: left(w, 1)), '')) else '' end acronym from s")
def _(t):
    return companies(t("part")).select("p_partkey", names.acronym("raw").alias("acronym"))


@query("name_variants", f"with {COMPANIES_SQL}, {S.variant_ctes('companies')} select raw, place::int place, name, method from reading")
def _(t):
    c = companies(t("part")).select("raw").distinct()
    return c.select("raw", F.posexplode(names.variants("raw")).alias("place", "v")).select("raw", "place", "v.*")


@query("suffix_class", f"""with {COMPANIES_SQL}, s as (select p_partkey, {S.tokens(S.standard('raw'))}[-1] w from companies)
select p_partkey, case when w in ({', '.join(map(S.q, V.STRONG_SUFFIXES))}) then 'strong_parent_entity' when w in ({', '.join(map(S.q, V.MEDIUM_SUFFIXES))}) then 'medium_corporate_entity'
 when w in ({', '.join(map(S.q, V.LOW_SUFFIXES))}) then 'low_legal_form' else '' end suffix_class from s""")
def _(t):
    return companies(t("part")).select("p_partkey", names.suffix_class(names.standard("raw")).alias("suffix_class"))


_WORDS = "regexp_extract_all(lower(x), '[a-z]+')"


@query("generic_score", f"""with s as (select doc_id, text x from documents union all select -p_partkey, case p_partkey % 4 when 0 then 'local ' || p_name || ' companies' when 1 then 'credit unions' when 2 then p_name || ' bank' else p_type end from part)
select doc_id, len(list_filter({_WORDS}, lambda t: list_contains({S.listed(V.GENERIC_TERMS)}, t)))::int generic_score,
 len({_WORDS}) >= 2 and (list_contains({S.listed(V.CATEGORY_HEADS)}, {_WORDS}[-1]) or lower({S.strip('x')}) in ({', '.join(map(S.q, V.FINANCIAL_PHRASES))})) is_category from s""")
def _(t):
    parts = t("part").selectExpr("-p_partkey as doc_id", "case p_partkey % 4 when 0 then concat('local ', p_name, ' companies') when 1 then 'credit unions' when 2 then concat(p_name, ' bank') else p_type end as x")
    s = t("documents").select("doc_id", F.col("text").alias("x")).unionByName(parts)
    return s.select("doc_id", names.generic_score("x").alias("generic_score"), names.is_category("x").alias("is_category"))


@query("risk_flag", f"""with s as (select p_partkey, p_name || case p_partkey % 5 when 0 then ' India' when 1 then ' Income Fund' when 2 then ' Co Ltd' else ' ' || p_type end x from part)
select p_partkey, len(list_intersect(regexp_extract_all(upper(x), '[A-Z0-9]+'), {S.listed(V.RISK_TERMS)})) > 0 risky, regexp_matches(x, '(?i)\\b(?:{'|'.join(V.LEGAL_SUFFIX_WORDS)})\\b') legal from s""")
def _(t):
    s = t("part").selectExpr("p_partkey", "concat(p_name, case p_partkey % 5 when 0 then ' India' when 1 then ' Income Fund' when 2 then ' Co Ltd' else concat(' ', p_type) end) as x")
    return s.select("p_partkey", names.has_risk_term("x").alias("risky"), names.has_legal_suffix("x").alias("legal"))


def _judged(decision: str, kind: str, source: str) -> str:
    return f"{{'decision': '{decision}', 'kind': '{kind}', 'source': 'deterministic_{source}'}}"


@query("prefilter_names", f"""with s as (select p_partkey, case p_partkey % 9 when 0 then '' when 1 then '.xyz' when 2 then p_name || ' (owned by ' || p_brand || ')' when 3 then p_name || ' Inc' when 4 then '@' || p_name
 when 5 then '12 other banks' when 6 then 'a 7 nanometer line' when 7 then p_name else p_name || '''s ' || p_type end x from part), o as (select p_partkey, {S.strip('x')} x, lower({S.strip('x')}) w, {S.owner('x')} o, {S.repair('x')} r from s)
select p_partkey, unnest(case when x = '' then {_judged('drop', 'artifact', 'empty')} when w in ({', '.join(map(S.q, V.ARTIFACTS))}) then {_judged('drop', 'artifact', 'artifact')} when o <> r then {_judged('accept', 'company', 'parent_recovery')}
 when regexp_matches(w, '(?i)\\b(?:{'|'.join(V.LEGAL_SUFFIX_WORDS)})\\b') then {_judged('accept', 'company', 'legal_suffix')} when starts_with(x, '@') and not regexp_matches(w, '\\b(?:{'|'.join(V.FIRM_WORDS)})\\b') then {_judged('drop', 'social_handle', 'social_handle')}
 when regexp_matches(w, '^\\d+\\s+(?:other\\s+)?(?:{'|'.join(V.COUNTED_NOUNS)})\\b') then {_judged('drop', 'generic_phrase', 'generic_phrase')}
 when regexp_matches(w, '\\b(?:{'|'.join(V.TECHNICAL_TERMS)})\\b') then {_judged('drop', 'technical_term', 'technical_term')} else {{'decision': null::varchar, 'kind': null::varchar, 'source': null::varchar}} end) from o""")
def _(t):
    s = t("part").selectExpr("p_partkey", "case p_partkey % 9 when 0 then '' when 1 then '.xyz' when 2 then concat(p_name, ' (owned by ', p_brand, ')') when 3 then concat(p_name, ' Inc') when 4 then concat('@', p_name) when 5 then '12 other banks' when 6 then 'a 7 nanometer line' when 7 then p_name else concat(p_name, '''s ', p_type) end as x")
    return s.select("p_partkey", names.keyword_filter("x").alias("f")).select("p_partkey", "f.*")


_ID = "case c_custkey % 7 when 0 then '-1' when 1 then c_custkey || '.0' when 2 then ' nan ' when 3 then '-99999' when 4 then '-88888' when 5 then null else cast(c_custkey as varchar) end"
_ID_SPARK = "case c_custkey % 7 when 0 then '-1' when 1 then concat(cast(c_custkey as string), '.0') when 2 then ' nan ' when 3 then '-99999' when 4 then '-88888' when 5 then null else cast(c_custkey as string) end"


@query("id_clean", f"with s as (select c_custkey, {_ID} x from customer) select c_custkey, {S.clean_id('x')} clean, coalesce({S.clean_id('x')}, '-1') or_missing, case when length({S.clean_id('x')}) < 10 then lpad({S.clean_id('x')}, 10, '0') else {S.clean_id('x')} end padded from s")
def _(t):
    s = t("customer").selectExpr("c_custkey", f"{_ID_SPARK} as x")
    return s.select("c_custkey", ids.clean_id("x").alias("clean"), ids.id_or_missing("x").alias("or_missing"), ids.clean_id("x", 10).alias("padded"))


@query("valid_id_variants", f"with s as (select c_custkey, {_ID} x from customer) select c_custkey, {', '.join(f'{S.valid_id('x', k)} valid_{k}' for k in V.SENTINELS)} from s")
def _(t):
    s = t("customer").selectExpr("c_custkey", f"{_ID_SPARK} as x")
    return s.select("c_custkey", *[ids.valid_id("x", k).alias(f"valid_{k}") for k in V.SENTINELS])


@query("sic_format", r"""with s as (select s_suppkey, case s_suppkey % 4 when 0 then cast(s_suppkey as varchar) when 1 then s_suppkey || '.0' when 2 then 'SIC ' || (s_suppkey + 100) else '' end x from supplier),
d as (select s_suppkey, coalesce(cast(try_cast(try_cast(x as double) as bigint) as varchar), nullif(regexp_replace(x, '\D', '', 'g'), '')) d from s)
select s_suppkey, coalesce(case when length(d) < 4 then lpad(d, 4, '0') else d end, '') sic from d""")
def _(t):
    s = t("supplier").selectExpr("s_suppkey", "case s_suppkey % 4 when 0 then cast(s_suppkey as string) when 1 then concat(cast(s_suppkey as string), '.0') when 2 then concat('SIC ', cast(s_suppkey + 100 as string)) else '' end as x")
    return s.select("s_suppkey", ids.format_sic("x").alias("sic"))


@query("filename_parts", r"""with s as (select o_orderkey, 'CIK' || o_custkey || '_10K_' || strftime(o_orderdate, '%Y%m%d') || case when o_orderkey % 10 = 0 then '.htm' else '.txt' end f from orders)
select o_orderkey, nullif(regexp_extract(f, 'CIK(\d+)_', 1), '') focal_cik, try_cast(left(nullif(regexp_extract(f, '_(\d{8})\.txt$', 1), ''), 4) as int) fyear from s""")
def _(t):
    f = F.expr("concat('CIK', cast(o_custkey as string), '_10K_', date_format(o_orderdate, 'yyyyMMdd'), case when o_orderkey % 10 = 0 then '.htm' else '.txt' end)")
    s = t("orders").select("o_orderkey", f.alias("f"))
    return s.select("o_orderkey", ids.filing_cik("f").alias("focal_cik"), ids.filing_year("f").alias("fyear"))


@query("year_parse", r"""with s as (select o_orderkey, year(o_orderdate) || '; ' || (year(o_orderdate) - o_orderkey % 3) || ' x1999 ' || o_orderkey x from orders)
select o_orderkey, coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(x, '\b(?:19|20)\d\d\b'), lambda y: y::int))), lambda y: y::varchar), ';'), '') as years from s""")
def _(t):
    s = t("orders").selectExpr("o_orderkey", "concat(year(o_orderdate), '; ', year(o_orderdate) - o_orderkey % 3, ' x1999 ', o_orderkey) as x")
    return s.select("o_orderkey", ids.format_years(ids.years("x")).alias("years"))


@query("fiscal_year", "select o_orderkey, (year(o_orderdate) - case when month(o_orderdate) > 5 then 0 else 1 end)::int fiscal_year from orders")
def _(t):
    return t("orders").select("o_orderkey", ids.fiscal_year("o_orderdate").alias("fiscal_year"))


@query("interval_overlap", """with s as (select o_orderkey, case when o_orderkey % 4 <> 0 then o_orderdate end a, case when o_orderkey % 3 <> 0 then o_orderdate + interval 400 day end b, case when o_orderkey % 5 = 0 then [] else [1996, 1999] end y from orders)
select o_orderkey, case when len(y) = 0 then 'no_residual_years' when a is null and b is null then 'no_dates' when len(list_filter(y, lambda v: v between coalesce(year(a), list_min(y)) and coalesce(year(b), 2026))) > 0 then 'overlap' else 'no_overlap' end status from s""")
def _(t):
    s = t("orders").selectExpr("o_orderkey", "case when o_orderkey % 4 <> 0 then o_orderdate end as a", "case when o_orderkey % 3 <> 0 then o_orderdate + interval 400 day end as b", "if(o_orderkey % 5 = 0, cast(array() as array<int>), array(1996, 1999)) as y")
    return s.select("o_orderkey", ids.overlaps(F.col("a"), F.col("b"), F.col("y")).alias("status"))


@query("confidence_norm", """with s as (select event_id, case event_id % 6 when 0 then '0.9' when 1 then '7' when 2 then 'x' when 3 then '150' when 4 then cast(value as varchar) else '1' end c from events), n as (select event_id, coalesce(try_cast(c as double), 0) c from s)
select event_id, round(greatest(0, least(100, case when c between 0 and 1 then c * 100 when c > 1 and c <= 10 then c * 10 else c end)), 6)::double confidence from n""")
def _(t):
    s = t("events").selectExpr("event_id", "case event_id % 6 when 0 then '0.9' when 1 then '7' when 2 then 'x' when 3 then '150' when 4 then cast(value as string) else '1' end as c")
    return s.select("event_id", F.round(ids.confidence("c"), 6).alias("confidence"))


@query("snippets", """with a as (select doc_id, text, string_split_regex(text, '(?i)\\b(?:license|the|and)\\b') p, regexp_extract_all(text, '(?i)\\b(?:license|the|and)\\b', 0) m from documents),
b as (select doc_id, text, p, m, unnest(generate_series(1, len(m))) i from a where len(m) > 0),
c as (select doc_id, text, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint s, length(m[i]) l from b),
d as (select doc_id, text, greatest(s - 100, 0) st, least(s + l + 1000, length(text)) en from c),
e as (select *, max(en) over (partition by doc_id order by st, en rows between unbounded preceding and 1 preceding) pm from d),
f as (select *, sum(case when pm is null or st > pm then 1 else 0 end) over (partition by doc_id order by st, en rows unbounded preceding) g from e)
select doc_id, min(st)::int st, max(en)::int en from f group by doc_id, g""")
def _(t):
    return T.intervals(t("documents"), ["doc_id"], "text", ["the", "and", "license"]).select("doc_id", "st", "en")


@query("snippet_texts", r"""with pp as (select doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) x, generate_subscripts(string_split_regex(text, '\n[ \t]*\n'), 1) - 1 part from documents where doc_id is not null),
a as (select doc_id, part, x, string_split_regex(x, '(?i)\b(?:license|the|and)\b') p, regexp_extract_all(x, '(?i)\b(?:license|the|and)\b', 0) m from pp where regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''),
b as (select doc_id, part, x, p, m, unnest(generate_series(1, len(m))) i from a where len(m) > 0),
c as (select doc_id, part, x, (list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::bigint s, length(m[i]) l from b),
d as (select doc_id, part, x, greatest(s - 40, 0) st, least(s + l + 60, length(x)) en from c),
e as (select *, max(en) over (partition by doc_id, part order by st, en rows between unbounded preceding and 1 preceding) pm from d),
f as (select *, sum(case when pm is null or st > pm then 1 else 0 end) over (partition by doc_id, part order by st, en rows unbounded preceding) g from e),
h as (select doc_id, part, any_value(x) x, min(st) st, max(en) en from f group by doc_id, part, g),
k as (select doc_id, part, x, st, en, case when st > 0 then '...' || regexp_replace(substr(x, st + 1, en - st), '^\s+', '') else substr(x, st + 1, en - st) end y from h)
select doc_id, part::int part, st::int st, md5(case when en < length(x) then regexp_replace(y, '\s+$', '') || '...' else y end) digest from k""")
def _(t):
    found = T.snippets(t("documents"), ["doc_id"], "text", ["the", "and", "license"], before=40, after=60)
    return found.select("doc_id", "part", "st", F.md5(F.col("snippet").cast("binary")).alias("digest"))


@query("snippet_stats", """select doc_id, length(text)::int chars, ((length(text) - length(replace(text, chr(10) || chr(10), ''))) / 2)::int paragraphs, round(100 * least(length(text), 1100) / nullif(length(text), 0)::double, 6) share from documents""")
def _(t):
    s = T.stats("text", F.least(F.length("text"), F.lit(1100)))
    return t("documents").select("doc_id", s.alias("s")).select("doc_id", "s.chars", "s.paragraphs", F.round("s.share", 6).alias("share"))


@query("chunks", """with s as (select doc_id, text, ceil(greatest(length(text), 1) / 2000.0)::int n from documents), k as (select *, greatest(length(text) // n, 1)::int z, unnest(range(n)) i from s)
select doc_id, i::int part, length(x)::int n_chars, md5(x) digest from (select doc_id, i, case when i = n - 1 then substr(text, (i * z + 1)::bigint) else substr(text, (i * z + 1)::bigint, z) end x from k)""")
def _(t):
    # A text without a character is one part as it is, null or empty.
    parts = F.when(F.length("text") > 0, T.chunks("text", F.ceil(F.length("text") / 2000))).otherwise(F.array("text"))
    s = t("documents").select("doc_id", F.posexplode(parts).alias("part", "x"))
    return s.select("doc_id", "part", F.length("x").alias("n_chars"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query("json_props", "select event_id, cast(json_extract(props, '$.k') as int) k from events")
def _(t):
    return t("events").select("event_id", T.json_object("props", "k int")["k"].alias("k"))


@query("tolerant_json", "select event_id, case when event_id % 3 = 2 then null else cast(json_extract(props, '$.k') as int) end k, case when event_type in ('click', 'view') then event_type else 'unclear' end kind from events")
def _(t):
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("no record")
    return t("events").select("event_id", T.json_object(answer, "k int")["k"].alias("k"), T.one_of("event_type", ["click", "view"], "unclear").alias("kind"))


@query("json_arrays", """with s as (select o_custkey, list(o_orderkey order by o_orderkey) f, list(o_orderpriority order by o_orderkey) p from orders group by 1), u as (select o_custkey, unnest(f) form, unnest(p) priority from s)
select o_custkey, form, priority from u where priority in ('1-URGENT', '2-HIGH')""")
def _(t):
    by = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    doc = by.select("o_custkey", F.to_json(F.struct(F.col("s.o_orderkey").alias("form"), F.col("s.o_orderpriority").alias("priority"))).alias("j"))
    rec = F.from_json("j", "form array<bigint>, priority array<string>")
    rows = doc.select("o_custkey", rec.alias("r")).select("o_custkey", F.inline(F.arrays_zip("r.form", "r.priority")))
    return rows.where(F.col("priority").isin("1-URGENT", "2-HIGH"))


_FORM = "case o_orderkey % 4 when 0 then '10-K' when 1 then '20-F' when 2 then '8-K' else '10-K/A' end"


@query("filing_lists", f"""select o_custkey cik, {_FORM} form, o_orderdate::varchar "filingDate", 'https://host/data/' || o_custkey || '/' || o_orderkey || '/' || o_orderpriority || '.htm' href from orders where {_FORM} in ('10-K', '20-F')""")
def _(t):
    # Odd lines stand in the documents themselves, the others in the further files that these name.
    o = t("orders").selectExpr("o_custkey as cik", "o_orderkey", f"{_FORM} as form", "cast(o_orderdate as string) as filingDate", "concat(o_orderkey, '-') as accessionNumber", "concat(o_orderpriority, '.htm') as primaryDocument")
    arrays = F.array_sort(F.collect_list(F.struct("o_orderkey", "form", "filingDate", "accessionNumber", "primaryDocument")))
    held = o.groupBy("cik", (F.col("o_orderkey") % 2).alias("at")).agg(arrays.alias("s"))
    record = F.struct(*[F.col(f"s.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber", "primaryDocument")])
    docs = held.where("at = 1").select("cik", F.to_json(F.struct(F.struct(record.alias("recent")).alias("filings"))).alias("value"))
    older = held.where("at = 0").select("cik", F.to_json(record).alias("value"))
    return tables.links(tables.filings(docs, older=older), "https://host/data").select("cik", "form", "filingDate", "href")


_WIDE = "string_agg(p_name, '|' order by p_partkey) n, string_agg(p_brand, '|' order by p_partkey) filter (where p_partkey % 5 <> 0) b"


def _wide(t):
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c.alias("x")))), lambda s: s["x"]), "|")
    return t("part").groupBy((F.col("p_partkey") % 97).alias("g")).agg(joined(F.col("p_name")).alias("n"), joined(F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand"))).alias("b"))


@query("long_from_wide", f"""with w as (select p_partkey % 97 g, {_WIDE} from part group by 1), l as (select g, string_split(n, '|') n, string_split(coalesce(b, ''), '|') b from w)
select g, i::int competitor_order, n[i] n, coalesce(b[i], '-1') b from (select g, n, b, unnest(range(1, len(n) + 1)) i from l)""")
def _(t):
    return T.long_from_wide(_wide(t), ["g"], {"n": "", "b": "-1"}, "n")


@query("alignment_audit", f"""with w as (select p_partkey % 97 g, {_WIDE} from part group by 1), l as (select g, len(string_split(n, '|'))::int n_n, len(string_split(b, '|'))::int n_b from w) select * from l where n_n <> n_b""")
def _(t):
    return T.misaligned(_wide(t), ["g"], ["n", "b"])


_WORDS_MARKED = ("Nestlé", "Société Générale", "Müller & Söhne", "Łódź Å/S", "São João", "Crédit Agricole S.A.", "Škoda Žilina", "plain name")
_MARKED = "case p_partkey % 8 " + " ".join(f"when {k} then {S.q(w)}" for k, w in enumerate(_WORDS_MARKED)) + " end"


@query("accents_stripped", f"select p_partkey, strip_accents(p_name || ' ' || {_MARKED}) plain from part")
def _(t):
    return t("part").selectExpr("p_partkey", f"concat(p_name, ' ', {_MARKED}) as x").select("p_partkey", names.strip_accents("x").alias("plain"))


_BROKEN = "case p_partkey % " + str(len(V.MOJIBAKE)) + " " + " ".join(f"when {k} then {S.q(a)}" for k, (a, _) in enumerate(V.MOJIBAKE)) + " end"


@query("mojibake_repaired", f"with s as (select p_partkey, ' ' || p_name || {_BROKEN} || 's ' || p_brand || ' ' x from part) select p_partkey, {S.repair('x')} repaired from s")
def _(t):
    return t("part").selectExpr("p_partkey", f"concat(' ', p_name, {_BROKEN}, 's ', p_brand, ' ') as x").select("p_partkey", names.repair("x").alias("repaired"))


_POSSESSIVE = "case p_partkey % 6 when 0 then concat('Wendy', chr(39), 's') when 1 then concat(p_brand, chr(39), 's') when 2 then 'Al S' when 3 then concat(p_name, chr(39), 's') when 4 then 'MACY S' else concat('K', p_partkey, ' & Sons') end"


@query("possessive_names", f"with s as (select p_partkey, {_POSSESSIVE} x from part) select p_partkey, {S.partial('x')} partial_key, replace({S.partial('x')}, ' ', '') compact_key from s")
def _(t):
    s = t("part").selectExpr("p_partkey", f"{_POSSESSIVE} as x").select("p_partkey", names.partial_name("x").alias("partial_key"))
    return s.withColumn("compact_key", names.compact(F.col("partial_key")))


_ALIASED = "case p_partkey % " + str(len(V.ALIASES) + 1) + " " + " ".join(f"when {k} then {S.q(a)}" for k, a in enumerate(V.ALIASES)) + " else p_name end"


@query("alias_equivalents", f"with s as (select p_partkey, lower({_ALIASED}) x from part) select p_partkey, {S.candidate('x')} candidate_key from s")
def _(t):
    return t("part").selectExpr("p_partkey", f"lower({_ALIASED}) as x").select("p_partkey", names.candidate_name("x").alias("candidate_key"))


_FOUND = "case when p_partkey % 9 = 0 then [] else [(1995 + p_partkey % 7)::int, (1993 + p_partkey % 11)::int, (1995 + p_partkey % 7)::int] end"


@query("year_audit", f"""with s as (select p_partkey, list_sort(list_distinct({_FOUND})) f, list_sort(list_distinct([(1996 + p_partkey % 5)::int, 1999])) w from part)
select p_partkey, f[1] year_min, f[-1] year_max, array_to_string(f, ';') years_available, array_to_string(w, ';') years_requested, list_has_any(f, w) in_year,
 case when list_has_any(f, w) then 0 else list_min(list_transform(f, lambda x: list_min(list_transform(w, lambda y: abs(x - y))))) end::int distance from s""")
def _(t):
    found = F.expr("if(p_partkey % 9 = 0, cast(array() as array<int>), array(cast(1995 + p_partkey % 7 as int), cast(1993 + p_partkey % 11 as int), cast(1995 + p_partkey % 7 as int)))")
    wanted = F.expr("array(cast(1996 + p_partkey % 5 as int), 1999)")
    return t("part").select("p_partkey", ids.year_audit(found, wanted).alias("a")).select("p_partkey", "a.*")


_ANSWERS = """case p_partkey % 5 when 0 then ' company ' when 1 then 'Company' when 2 then 'person' else 'other' end as llm_classification, case p_partkey % 4 when 0 then 'drop' when 1 then 'accept_for_manual_alias_bridge' else 'maybe' end as llm_decision,
 case p_partkey % 6 when 0 then '0.95' when 1 then '9' when 2 then '88' when 3 then 'high' when 4 then '-3' else '300' end as llm_confidence, case p_partkey % 3 when 0 then ' why ' end as llm_reason, case p_partkey % 2 when 0 then 'legal_entity' else '' end as suggested_alias_scope"""
_CLASSES, _DECIDED = (", ".join(map(S.q, x)) for x in (V.CLASSES, V.DECISIONS))


@query("normalized_answers", f"""with q as (select p_partkey record_id, p_name competitor_name from part), a as (select p_partkey record_id, p_partkey % 7 > 0 answered, {_ANSWERS} from part), j as (select q.*, answered, {', '.join(f"case when answered then {c} end {c}" for c in ('llm_classification', 'llm_decision', 'llm_confidence', 'llm_reason', 'suggested_alias_scope'))} from q join a using (record_id)),
n as (select record_id, competitor_name, answered, case when trim(llm_classification) in ({_CLASSES}) then trim(llm_classification) else 'unclear' end llm_classification, case when trim(llm_decision) in ({_DECIDED}) then trim(llm_decision) else 'manual_review' end llm_decision,
 coalesce(try_cast(llm_confidence as double), 0) c, case when answered then coalesce(trim(llm_reason), '') else '{V.MISSING_ANSWER}' end llm_reason, case when suggested_alias_scope = 'legal_entity' then 'legal_entity' else 'unclear' end suggested_alias_scope from j),
m as (select * exclude (c, answered), greatest(0, least(100, case when c between 0 and 1 then c * 100 when c > 1 and c <= 10 then c * 10 else c end)) llm_confidence, '' suggested_alias_name, case when answered then '' else '{V.MISSING_ANSWER}' end suggested_alias_reason from n)
select *, llm_confidence < 85 or llm_decision = 'manual_review' needs_manual_check from m""")
def _(t):
    asked = t("part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("competitor_name"))
    answers = t("part").selectExpr("p_partkey as record_id", "p_partkey % 7 > 0 as answered", *_split(_ANSWERS)).where("answered").drop("answered")
    return model.normalized(asked, answers)


def _cost_sql(x: str) -> str:
    runs = lambda p, by: f"len(regexp_extract_all({x}, {S.q(p)}))" if by == "run" else f"length(list_aggregate(list_concat([''], regexp_extract_all({x}, {S.q(p)})), 'string_agg', ''))"
    return "(999 + " + " + ".join(f"{n} * {runs(p, by)}" for p, by, n in V.TOKEN_COST) + ") // 1000"


@query("token_chunks", f"""with e as (select doc_id, coalesce(text, '') x, ({_cost_sql("coalesce(text, '')")})::bigint tokens from documents), n as (select *, greatest(ceil(tokens / 500.0), 1)::int n from e), s as (select *, greatest(length(x) // n, 1)::int size from n)
select doc_id, tokens, n n_wanted, len(p)::int n_parts, md5(array_to_string(p, '|')) digest from (select *, list_filter(list_transform(range(n), lambda i: case when i = n - 1 then substr(x, (i * size + 1)::int) else substr(x, (i * size + 1)::int, size) end), lambda v: v <> '') p from s)""")
def _(t):
    # In steps of their own, so that estimate and parts are worked out once a text.
    e = t("documents").select("doc_id", "text", T.token_estimate("text").alias("tokens"))
    p = e.select("doc_id", "tokens", T.token_chunks("text", 500, F.col("tokens")).alias("parts"))
    wanted = F.greatest(F.ceil(F.col("tokens") / 500), F.lit(1)).cast("int")
    return p.select("doc_id", "tokens", wanted.alias("n_wanted"), F.size("parts").alias("n_parts"), F.md5(F.array_join("parts", "|").cast("binary")).alias("digest"))


_OPTIONS = Y.synonyms()
_TAILED = "concat(p_name, case p_partkey % 5 when 0 then ' /DE/' when 1 then ' Group-NEW' when 2 then ' Services /California' when 3 then ' Labs Holding Ltd' else ' Hldgs, Inc.' end)"
_TAILED_SQL = _TAILED


@query("synonym_names", f"""with recursive opt(word, r, c) as (values {", ".join(f"({S.q(w)}, {S.q(r)}, {k})" for w, others in _OPTIONS.items() for k, r in [(0, w), *[(1, o) for o in others]])}),
n as (select p_partkey, trim(regexp_replace(upper({_TAILED_SQL}), '\\s+', ' ', 'g')) x from part), t as (select *, regexp_extract_all(x, '[A-Z0-9]+|[^A-Z0-9]+') toks from n),
e(p, x, toks, i, changed, name) as (select p_partkey, x, toks, 0, 0, '' from t union all select p, x, toks, i + 1, changed + coalesce(c, 0), name || coalesce(r, toks[i + 1]) from e left join opt on word = toks[i + 1] where i < len(toks)),
f as (select p, x, changed, trim(regexp_replace(name, '\\s+', ' ', 'g')) name from e where i = len(toks))
select p p_partkey, name, min(changed)::int changed from f where name <> '' and name <> x group by 1, 2""")
def _(t):
    found = t("part").select("p_partkey", F.expr(_TAILED).alias("x"))
    return A.spread(found, "p_partkey").select("p_partkey", F.inline(Y.expanded("x", _OPTIONS, 1024))).select("p_partkey", "name", "changed")


@query("tailless_names", rf"""with n as (select p_partkey, trim(regexp_replace({_TAILED_SQL}, '\s+', ' ', 'g')) x from part), c as (select p_partkey, x, unnest(['/([^/]+/?)$', '-([^-]*)$']) tail, unnest(['^(.*)/[^/]+/?$', '^(.*)-[^-]*$']) head from n)
select distinct p_partkey, trim(regexp_extract(x, head, 1)) as name from c where length(regexp_extract(x, tail, 1)) <= 7 and trim(regexp_extract(x, head, 1)) <> ''""")
def _(t):
    return t("part").select("p_partkey", F.explode(Y.without_tail(F.expr(_TAILED))).alias("name"))
