"""Queries on dictionaries, alias bridges and diagnostics, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import names
from ..functions import text as T
from . import bridges as B
from . import matcher
from . import oracle as S
from .derived import COMPANIES_SQL, bridge, companies
from .nameindex import kept_index
from .queries_relational import _MATCH, _PREFIXES, _PREPARED, counted_mentions
from .registering import collection

query, QUERIES, ORACLES = collection()

_DICT = f"""{COMPANIES_SQL}, d0 as (select p_partkey, raw, {S.standard('raw')} std, (p_partkey % 900)::varchar cik, case when p_partkey % 4 > 0 then p_partkey::varchar end gvkey from companies),
d1 as (select 0 form, std name, * from d0 union all select 1, {S.safe_core('std')}, * from d0 union all select 2, case when len({S.tokens('std')}) >= 3 then upper(array_to_string(list_transform({S.tokens('std')}, lambda w: left(w, 1)), '')) else '' end, * from d0),
d2 as (select *, row_number() over (partition by name order by form, p_partkey desc, raw) k from d1 where coalesce(name, '') <> ''), dict as (select name, cik, gvkey, form from d2 where k = 1)"""


def _companies(t):
    return companies(t("part")).selectExpr("raw as conm", "cast(p_partkey % 900 as string) as cik", "case when p_partkey % 4 > 0 then cast(p_partkey as string) end as gvkey", "p_partkey")


@query("name_dictionary", f"with {_DICT} select * from dict")
def _(t):
    return B.dictionary(_companies(t), F.col("p_partkey"))


@query("dictionary_round_trip", f"with {_DICT} select raw conm, d0.cik, std as name, dict.cik cik_from_name from d0 left join dict on std = name where d0.cik is distinct from dict.cik")
def _(t):
    c = _companies(t)
    return B.round_trip(c, B.dictionary(c, F.col("p_partkey")))


@query("manual_alias_bridge", """with m as (select l_orderkey, l_linenumber, l_partkey, case when l_suppkey % 2 = 0 then '-1' else l_suppkey::varchar end cik, '-1' gvkey, p_name || ' ' || p_brand as name from lineitem join part on l_partkey = p_partkey),
b as (select 'A' || p_partkey approved_cik, case when p_partkey % 2 = 0 then 'G' || p_partkey else '-1' end approved_gvkey, p_name || ' ' || p_brand a, p_name || '-' || p_type c from part),
k as (select trim(regexp_replace(upper(a), '[^A-Z0-9]+', ' ', 'g')) key, 0 o, * from b union all select trim(regexp_replace(upper(c), '[^A-Z0-9]+', ' ', 'g')), 1, * from b),
f as (select * from (select *, row_number() over (partition by key order by approved_gvkey, approved_cik, o) r from k) where r = 1)
select l_orderkey, l_linenumber, l_partkey, name, case when m.cik = '-1' and f.key is not null then approved_cik else m.cik end cik, case when m.cik = '-1' and f.key is not null then approved_gvkey else m.gvkey end gvkey, m.cik = '-1' and f.key is not null alias_applied
from m left join f on trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) = f.key""")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    m = t("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "if(l_suppkey % 2 = 0, '-1', cast(l_suppkey as string)) as cik", "'-1' as gvkey").join(p, "l_partkey")
    b = t("part").selectExpr("concat('A', p_partkey) as approved_cik", "if(p_partkey % 2 = 0, concat('G', p_partkey), '-1') as approved_gvkey", "concat(p_name, ' ', p_brand) as a", "concat(p_name, '-', p_type) as c")
    return B.apply_alias_bridge(m, b, ["a", "c"])


@query("alias_review", f"""with r as (select p_partkey, {S.alnum('p_name')} name_std, p_name || ' ' || p_type raw, p_brand sic_file, (1995 + p_partkey % 5)::int fyear from part), o as (select name_std, raw, min(p_partkey) o from r group by 1, 2), q as (select name_std, raw, o, row_number() over (partition by name_std order by o) k from o)
select name_std, count(*) frequency, string_agg(distinct sic_file, ';' order by sic_file) sic_files, string_agg(distinct fyear::varchar, ';' order by fyear::varchar) years_seen,
 (select string_agg(raw, ' | ' order by o) from q where q.name_std = r.name_std and k <= 5) raw_names, arg_min(raw, p_partkey) first_raw from r group by name_std""")
def _(t):
    r = t("part").select("p_partkey", names.alnum_key("p_name").alias("name_std"), F.concat_ws(" ", "p_name", "p_type").alias("raw"), F.col("p_brand").alias("sic_file"), (1995 + F.col("p_partkey") % 5).cast("int").alias("fyear"))
    return B.alias_review(r, "p_partkey").withColumnRenamed("years", "years_seen")


@query("match_diagnostics", f"with {_MATCH}, j as (select * from mentions join matched using (raw, fyear)) select method, sum(n)::bigint n_mentions, count(distinct raw) n_names, round(sum(n) / (select sum(n) from j)::double, 6) as share from j group by 1")
def _(t):
    m = counted_mentions(t)
    return B.match_diagnostics(m.join(matcher.match(m, kept_index(bridge(t("part")), "match")).select("raw", "fyear", "method"), ["raw", "fyear"]))


@query("review_error_rates", """with s as (select event_type, case event_id % 5 when 0 then 'approve_public_id' when 1 then 'human_reject' when 2 then 'unclear' when 3 then 'nan' else 'approve_x' end d from events)
select event_type, count(*) n_reviewed, round(avg((d like 'approve%')::int), 6) approved, round(avg((d like '%reject%')::int), 6) rejected, round(avg((d = 'unclear')::int), 6) as unclear from s where d <> 'nan' group by 1""")
def _(t):
    s = t("events").selectExpr("event_type", "case event_id % 5 when 0 then 'approve_public_id' when 1 then 'human_reject' when 2 then 'unclear' when 3 then 'nan' else 'approve_x' end as d")
    return B.error_rates(s, "event_type", "d")


@query("ticker_candidates", """with a as (select s_suppkey record_id, chr((65 + s_suppkey % 26)::int) || 'X' tic, unnest([1996, 1998]) fyear from supplier), b as (select distinct chr((65 + p_partkey % 20)::int) || 'X' tic, (1995 + p_partkey % 5)::int fyear, p_brand gvkey from part)
select record_id, tic, fyear, gvkey, 'ticker_year_match' as rule from a join b using (tic, fyear)""")
def _(t):
    a = t("supplier").selectExpr("s_suppkey as record_id", "concat(chr(65 + s_suppkey % 26), 'x') as alias", "array(1996, 1998) as years")
    b = t("part").selectExpr("concat(chr(65 + p_partkey % 20), 'X') as tic", "cast(1995 + p_partkey % 5 as int) as fyear", "p_brand as gvkey").distinct()
    return B.ticker_candidates(a, b).select("record_id", "tic", "fyear", "gvkey", "rule")


@query("prefix_candidates", f"""with {_PREPARED}, {_PREFIXES}, w as (select distinct p_partkey record_id, concat('K', p_partkey % 5000, ' ', p_name) alias, y fyear from part, (values (1996), (1998)) v(y)), a as (select record_id, {S.standard('alias')} prefix, fyear from w)
select record_id, fyear, name, source, cik, gvkey, 'parent_prefix_recovery' rule_found from a join prefixes using (prefix, fyear) where unsafe = '' and prefix <> ''""")
def _(t):
    a = t("part").selectExpr("p_partkey as record_id", "concat('K', p_partkey % 5000, ' ', p_name) as alias", "array(1996, 1998) as years")
    return B.prefix_candidates(a, bridge(t("part")))


@query("text_cleaning", rf"""with s as (select doc_id, 'Table of Contents' || chr(10) || '  12 ' || chr(10) || 'Acme Inc.' || chr(10) || text || chr(10) || 'Page - 7' x from documents),
z as (select doc_id, replace(replace(x, 'Inc.' || chr(10), 'Inc. '), 'Corp.' || chr(10), 'Corp. ') x from s)
select doc_id, length(y)::int n, md5(y) digest from (select doc_id, regexp_replace(regexp_replace(regexp_replace(x, '(?im){V.CONTENTS_LINE}', '', 'g'), '(?im){V.PAGE_LINE}', '', 'g'), '\n\s*\n', chr(10), 'g') y from z)""")
def _(t):
    y = T.clean_filing_text(F.concat(F.lit("Table of Contents\n  12 \nAcme Inc.\n"), F.col("text"), F.lit("\nPage - 7")))
    return t("documents").select("doc_id", F.length(y).alias("n"), F.md5(y.cast("binary")).alias("digest"))


@query("word_sets", "select p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(translate(p_name || '/' || p_brand || '-' || p_name, '/#-', '   '), '\\s+'), lambda w: w <> ''))), ' ') as bag from part")
def _(t):
    return t("part").select("p_partkey", F.array_join(T.word_set(F.concat("p_name", F.lit("/"), "p_brand", F.lit("-"), "p_name")), " ").alias("bag"))


_MENTIONED = f"with {COMPANIES_SQL}, r as (select distinct raw from companies where raw <> ''), d as (select raw, {S.standard('raw')} name_std, {S.finish(S.owner('raw'))} parent_recovered from r)"


@query("name_diagnostics", f"""{_MENTIONED} select raw, name_std, parent_recovered, coalesce({S.safe_core('name_std')}, name_std) name_clean,
 array_to_string(list_transform(list_reverse_sort(range(1, least(3, len({S.tokens('name_std')})) + 1)), lambda k: array_to_string({S.tokens('name_std')}[1:k], ' ')), '|') parent_prefixes from d""")
def _(t):
    return B.name_diagnostics(companies(t("part")))


_LISTED = ("name", "name_original", "source", "cik", "gvkey")


@query("prefix_diagnostics", f"""with {_PREPARED}, {_PREFIXES}, q as (select prefix, fyear, tier, name, name_original, source, coalesce(cik, '-1') cik, coalesce(gvkey, '-1') gvkey from p2),
t as (select *, min(tier) over (partition by prefix, fyear) best from q)
select prefix, fyear, count(*) n_candidates_all, count(distinct (cik, gvkey))::int n_identities_all, count(distinct (cik, gvkey)) = 1 is_safe_all, case min(best) when 1 then 'DISCERN_PRIORITY' when 2 then 'CCM_PRIORITY' else 'ALL_SOURCES' end priority_rule,
 count(*) filter (where tier = best) n_candidates_priority, (count(distinct (cik, gvkey)) filter (where tier = best))::int n_identities_priority, count(distinct (cik, gvkey)) filter (where tier = best) = 1 is_safe_priority,
 {', '.join(f"string_agg(distinct {c}, '|' order by {c}) {c}s_all, string_agg(distinct {c}, '|' order by {c}) filter (where tier = best) {c}s_priority" for c in _LISTED)} from t group by 1, 2""")
def _(t):
    return B.prefix_diagnostics(kept_index(bridge(t("part")), "match"))
