"""Queries on joins, aggregates, windows, sets and the matcher, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import ids, names
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sets as U
from ..operators.ordering import positions
from ..sources.kept import written
from . import matcher
from . import oracle as S
from .derived import BRIDGE_SQL, COMPANIES_SQL, MENTIONS_SQL, bridge, mentions
from .nameindex import kept_index
from .registering import collection

query, QUERIES, ORACLES = collection()


def counted_mentions(t):
    """The mentions of all line items, counted once for all that a matching run asks of them."""
    return written(mentions(t("lineitem"), t("orders"), t("part")), "mentions")

_TIER = "case when upper(source) = 'DISCERN' then 1 when upper(source) = 'CCM_COMPUSTAT_EXTENSION' then 2 else 3 end"
_PREPARED = f"""{BRIDGE_SQL},
b1 as (select name_original, fyear, {S.clean_id('cik')} cik, {S.clean_id('gvkey')} gvkey, source, {S.standard('name_original')} name from bridge),
b2 as (select *, 'standard' alias from b1 where name <> '' union all select * replace ({S.safe_core('name')} as name), 'suffix_cleaned' from b1 where {S.safe_core('name')} is not null),
b3 as (select *, row_number() over (partition by name, fyear order by {_TIER}, name_original, cik nulls last, gvkey nulls last, alias) k from b2),
prepared as (select name_original, fyear, cik, gvkey, source, name, alias from b3 where k = 1)"""


@query("bridge_first_wins", f"with {_PREPARED} select name, fyear, name_original, source, cik, gvkey, alias from prepared")
def _(t):
    return matcher.prepare_bridge(bridge(t("part"))).select("name", "fyear", "name_original", "source", "cik", "gvkey", "alias")


@query("bridge_conflicts", f"with {_PREPARED} select name, fyear, count(*) n_rows, count(distinct coalesce(cik, '-1') || '|' || coalesce(gvkey, '-1')) n_identities from b2 group by 1, 2 having n_identities > 1")
def _(t):
    return matcher.bridge_conflicts(bridge(t("part")))


_SAFE = S.listed(V.SAFE_GLOBAL_CONTINUATIONS)
_PREFIXES = f"""p1 as (select *, {_TIER} tier, string_split(name, ' ') w from prepared),
p2 as (select *, array_to_string(w[1:k], ' ') prefix from p1, (values (1), (2), (3)) v(k) where k <= len(w)),
p3 as (select prefix, fyear, min(tier) tier from p2 group by 1, 2),
p4 as (select prefix, fyear, tier, count(distinct coalesce(cik, '-1') || '|' || coalesce(gvkey, '-1')) ids, count(*) n,
 arg_max(struct_pack(name := name, o := name_original, s := source, c := cik, g := gvkey), struct_pack(a := cik is not null, b := gvkey is not null, l := length(name), n := name)) best
 from p2 join p3 using (prefix, fyear, tier) group by 1, 2, 3),
p5 as (select prefix, fyear, case tier when 1 then 'DISCERN_PRIORITY' when 2 then 'CCM_PRIORITY' else 'ALL_SOURCES' end rule, n n_candidates, best.name name, best.o name_original, best.s source, best.c cik, best.g gvkey from p4 where ids = 1),
prefixes as (select *, case when rule = 'ALL_SOURCES' and upper(source) = 'COMPUSTAT_GLOBAL' then coalesce(array_to_string(list_filter(string_split(name, ' ')[len(string_split(prefix, ' ')) + 1:], lambda t: not list_contains({_SAFE}, t)), ';'), '') else '' end unsafe from p5)"""


@query("prefix_recovery", f"with {_PREPARED}, {_PREFIXES} select * from prefixes")
def _(t):
    return matcher.prefix_table(bridge(t("part")))


_MATCH = f"""{COMPANIES_SQL}, {MENTIONS_SQL}, {_PREPARED}, {_PREFIXES}, {S.variant_ctes('companies')},
wanted as (select distinct raw, fyear from mentions),
spread as (select w.raw, fyear, place, name, method from wanted w join reading using (raw) where {S.capital('w.raw')}),
e1 as (select s.raw, s.fyear, 'exact_' || method method, p.name matched_name, name_original matched_original, source, cik, gvkey, row_number() over (partition by s.raw, s.fyear order by place) k from spread s join prepared p on s.name = p.name and s.fyear = p.fyear),
exact as (select * exclude (k) from e1 where k = 1),
t1 as (select s.raw, s.fyear, place, method, 4 - k part, array_to_string(string_split(name, ' ')[1:k], ' ') prefix from spread s anti join exact using (raw, fyear), (values (1), (2), (3)) v(k) where k <= len(string_split(name, ' '))),
t2 as (select raw, fyear, 'parent_prefix_recovery_' || rule || '_' || method method, p.name matched_name, name_original matched_original, 'parent_token_recovery_' || rule || '_' || source source, cik, gvkey, row_number() over (partition by raw, fyear order by place, part) k
 from t1 join prefixes p using (prefix, fyear) where unsafe = ''),
hits as (select * from exact union all select * exclude (k) from t2 where k = 1),
matched as (select * from hits union all select raw, fyear, case when {S.strip('raw')} = '' then 'unmatched_empty' when fyear is null then 'unmatched_missing_fyear' when not {S.capital('raw')} then 'unmatched_invalid_or_lowercase' else 'unmatched_after_all_candidates' end, null, null, null, null, null from wanted anti join hits using (raw, fyear))"""


@query("mention_match", f"with {_MATCH} select * from matched")
def _(t):
    return matcher.match(counted_mentions(t), kept_index(bridge(t("part")), "match"))


@query("match_rate_by_year", f"""with {_MATCH} select fyear, sum(n)::bigint n_mentions, coalesce(sum(n) filter (where not starts_with(method, 'unmatched')), 0)::bigint n_matched,
 round(coalesce(sum(n) filter (where not starts_with(method, 'unmatched')), 0) / sum(n)::double, 6) match_rate from mentions join matched using (raw, fyear) group by 1""")
def _(t):
    m = counted_mentions(t)
    joined = m.join(matcher.match(m, kept_index(bridge(t("part")), "match")).select("raw", "fyear", "method"), ["raw", "fyear"])
    hit = F.coalesce(F.sum(F.when(~F.col("method").startswith("unmatched"), F.col("n"))), F.lit(0))
    out = joined.groupBy("fyear").agg(F.sum("n").alias("n_mentions"), hit.alias("n_matched"))
    return out.withColumn("match_rate", F.round(F.try_divide("n_matched", "n_mentions"), 6))


@query("prefix_blocked", f"""with {COMPANIES_SQL}, {MENTIONS_SQL}, {_PREPARED}, {_PREFIXES}, {S.variant_ctes('companies')},
wanted as (select distinct raw, fyear from mentions), t1 as (select w.raw, fyear, method, array_to_string(string_split(name, ' ')[1:k], ' ') prefix from wanted w join reading using (raw), (values (1), (2), (3)) v(k) where k <= len(string_split(name, ' ')))
select raw, fyear, method, prefix, name, source, unsafe from t1 join prefixes using (prefix, fyear) where unsafe <> ''""")
def _(t):
    return matcher.blocked(mentions(t("lineitem"), t("orders"), t("part")), bridge(t("part")))


@query("exact_year_match", f"with {BRIDGE_SQL}, s as (select distinct {S.alnum('name_original')} name, fyear, source from bridge), o as (select {S.alnum('name_original')} name, year(o_orderdate)::int fyear, count(*) n from bridge b join orders on b.fyear = year(o_orderdate) group by all) select name, fyear, source, n from s join o using (name, fyear)")
def _(t):
    b = bridge(t("part")).withColumn("name", names.alnum_key("name_original"))
    o = t("orders").select(F.year("o_orderdate").alias("fyear")).groupBy("fyear").agg(F.count("*").alias("k"))
    per = b.groupBy("name", "fyear").agg(F.count("*").alias("m")).join(o, "fyear").select("name", "fyear", (F.col("m") * F.col("k")).alias("n"))
    return b.select("name", "fyear", "source").distinct().join(per, ["name", "fyear"])


@query("nearest_other_year", """with a as (select s_suppkey, 'N' || s_suppkey % 40 as name, [1996 + s_suppkey % 3] ys from supplier), b as (select 'N' || c_custkey % 60 as name, (1995 + c_custkey % 7)::int y, c_nationkey from customer),
s as (select name, c_nationkey, list_sort(list_distinct(list(y))) bs from b group by 1, 2)
select s_suppkey, name, c_nationkey, list_min(list_transform(bs, lambda v: abs(v - ys[1])))::int distance from a join s using (name) where not list_contains(bs, ys[1]::int)""")
def _(t):
    a = t("supplier").selectExpr("s_suppkey", "concat('N', s_suppkey % 40) as name", "array(cast(1996 + s_suppkey % 3 as int)) as years")
    b = t("customer").selectExpr("concat('N', c_custkey % 60) as name", "cast(1995 + c_custkey % 7 as int) as fyear", "c_nationkey")
    return J.nearest_year(a, b).select("s_suppkey", "name", "c_nationkey", "distance")


@query("panel_semi", """with a as (select s_suppkey, case when s_suppkey % 3 > 0 then cast(s_suppkey as varchar) end cik, case when s_suppkey % 4 > 0 then cast(s_suppkey + 7 as varchar) end gvkey, unnest([1996, 1998]) fyear from supplier),
p as (select distinct cast(c_custkey as varchar) cik, cast(c_custkey + 9 as varchar) gvkey, (1995 + c_custkey % 7)::int fyear from customer),
h as (select s_suppkey, fyear from a semi join p using (cik, fyear) union select s_suppkey, fyear from a semi join p using (gvkey, fyear))
select s_suppkey, string_agg(fyear, ';' order by fyear) valid_years from h group by 1""")
def _(t):
    a = t("supplier").selectExpr("s_suppkey", "case when s_suppkey % 3 > 0 then cast(s_suppkey as string) end as cik", "case when s_suppkey % 4 > 0 then cast(s_suppkey + 7 as string) end as gvkey", "array(1996, 1998) as years")
    p = t("customer").selectExpr("cast(c_custkey as string) as cik", "cast(c_custkey + 9 as string) as gvkey", "cast(1995 + c_custkey % 7 as int) as fyear")
    return J.in_panel(a, "s_suppkey", p, ["cik", "gvkey"]).select("s_suppkey", ids.format_years(F.col("valid_years")).alias("valid_years"))


@query("or_key_union", """with a as (select s_suppkey, 'A' || s_suppkey k, 'B' || s_suppkey % 10 c from supplier), b as (select c_custkey, 'A' || c_custkey % 200 x, 'B' || c_custkey % 90 y from customer)
select s_suppkey, c_custkey, 'exact' as rule from a join b on k = x union all select s_suppkey, c_custkey, 'canonical' from a join b on c = y""")
def _(t):
    a = t("supplier").selectExpr("s_suppkey", "concat('A', s_suppkey) as k", "concat('B', s_suppkey % 10) as c")
    b = t("customer").selectExpr("c_custkey", "concat('A', c_custkey % 200) as x", "concat('B', c_custkey % 90) as y")
    return J.either_key(a, b, [("k", "x", "exact"), ("c", "y", "canonical")]).select("s_suppkey", "c_custkey", "rule")


@query("variant_probe", """with p as (select s_suppkey, unnest([1, 2, 3]) place, unnest([s_suppkey % 300 + 1400, s_suppkey % 50 + 1480, s_suppkey]) k from supplier), h as (select s_suppkey, place, k, c_name, row_number() over (partition by s_suppkey order by place) r from p join customer on k = c_custkey)
select s_suppkey, (place - 1)::int as probe, k, c_name from h where r = 1""")
def _(t):
    probes = F.expr("array(named_struct('k', s_suppkey % 300 + 1400), named_struct('k', s_suppkey % 50 + 1480), named_struct('k', s_suppkey))")
    table = t("customer").select(F.col("c_custkey").alias("k"), "c_name")
    return J.first_probe(t("supplier"), "s_suppkey", probes, table, ["k"]).withColumnRenamed("at", "probe")


@query("population_complete", "select c_custkey, c_name, coalesce(x, '') last_priority, coalesce(n, 0)::bigint n from customer left join (select o_custkey, max(o_orderpriority) x, count(*) n from orders where o_orderstatus = 'P' group by 1) on c_custkey = o_custkey")
def _(t):
    found = t("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("last_priority"), F.count("*").alias("n"))
    return J.complete(t("customer").select("c_custkey", "c_name"), found, ["c_custkey"], ["last_priority"]).na.fill(0, ["n"])


@query("anti_missing", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return U.except_keys(t("customer").select("c_custkey", "c_name"), urgent, "c_custkey")


@query("priority_coalesce", """with a as (select s_nationkey, min(s_name) x from supplier group by 1), b as (select c_nationkey, min(c_name) x from customer group by 1)
select n_nationkey, coalesce(a.x, b.x, '-88888') gvkey, case when a.x is not null then 'panel' when b.x is not null then 'bridge' else 'missing' end gvkey_source from nation left join a on n_nationkey = s_nationkey left join b on n_nationkey = c_nationkey""")
def _(t):
    a = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("x"))
    b = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("x"))
    return J.by_priority(t("nation").select("n_nationkey"), [("panel", a, ["n_nationkey"], "x"), ("bridge", b, ["n_nationkey"], "x")], "gvkey")


@query("self_removed", """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem join part on l_partkey = p_partkey where not (l_suppkey % 25 = try_cast(substr(p_brand, 7) as int))""")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("own", (F.col("l_suppkey") % 25).cast("string"))
    focal = t("part").select(F.col("p_partkey").alias("l_partkey"), F.expr("substring(p_brand, 7)").alias("focal"))
    return J.without_self(rows, focal, ["l_partkey"], [("own", "focal")])[0].drop("own")


@query("crosswalk_unique", "select p_name || '/' || p_size as key, min(p_type) p_type from part group by 1 having count(distinct p_type) = 1")
def _(t):
    return J.unique_crosswalk(t("part").select(F.concat_ws("/", "p_name", "p_size").alias("key"), "p_type"), "key", "p_type")


@query("first_key_fanout", """with k as (select p_brand as key, p_partkey, 0 c from part union all select p_type, p_partkey, 1 from part), r as (select *, row_number() over (partition by key order by p_partkey desc, c) n from k where key <> '') select key, p_partkey from r where n = 1""")
def _(t):
    return J.first_key(t("part"), ["p_brand", "p_type"], [F.col("p_partkey").desc()]).select("key", "p_partkey")


@query("full_outer_map", "select coalesce(a.k, b.k) k, x, y from (select c_nationkey k, count(*) x from customer group by 1) a full join (select s_nationkey k, count(*) y from supplier group by 1) b on a.k = b.k")
def _(t):
    a = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("x"))
    return a.join(t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("y")), "k", "full")


@query("lookup_many_to_one", "select s_suppkey, s_name, n_name from supplier left join nation on s_nationkey = n_nationkey")
def _(t):
    n = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.many_to_one(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), n, ["s_nationkey"]).drop("s_nationkey")


@query("set_concat", "select l_suppkey, string_agg(distinct l_returnflag, '|' order by l_returnflag) flags, array_to_string(list_sort(list_distinct(list(cast(year(l_shipdate) as varchar))))[1:3], ';') years3 from lineitem group by 1")
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(A.joined_set("l_returnflag").alias("flags"), A.joined_set(F.year("l_shipdate").cast("string"), ";", 3).alias("years3"))


@query("seen_order_concat", """with f as (select user_id, event_type, min(event_id) o from events group by 1, 2) select user_id, string_agg(event_type, '; ' order by o) types from f group by 1""")
def _(t):
    return t("events").groupBy("user_id").agg(A.joined_in_order("event_type", "event_id").alias("types"))


@query("mode_all", """with c as (select user_id, event_type, count(*) n from events group by 1, 2), m as (select user_id, max(n) n from c group by 1) select user_id, string_agg(event_type, '; ' order by event_type) modes, n from c join m using (user_id, n) group by user_id, n""")
def _(t):
    return A.modes(t("events"), ["user_id"], "event_type")


@query("first_nonblank", "select o_custkey, coalesce(arg_min(o_orderpriority, o_orderkey) filter (where o_orderkey % 3 > 0), '') priority from orders group by 1")
def _(t):
    return t("orders").withColumn("p", F.expr("case when o_orderkey % 3 > 0 then o_orderpriority else '' end")).groupBy("o_custkey").agg(A.first_nonblank("p", "o_orderkey").alias("priority"))


@query("unique_or_blank", "select p_name, p_size, case when count(distinct p_type) = 1 then min(p_type) else '' end p_type from part group by 1, 2")
def _(t):
    return t("part").groupBy("p_name", "p_size").agg(A.unique_or_blank("p_type").alias("p_type"))


@query("keyed_first", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice desc, l_partkey, l_suppkey, l_quantity) k from lineitem) where k = 1")
def _(t):
    order = [F.col("l_extendedprice").desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")]
    return A.keep_first(t("lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("duplicate_report", "select l_orderkey, l_linenumber, count(*) n, count(distinct l_partkey) n_parts from lineitem group by 1, 2 having n > 1")
def _(t):
    again = A.duplicated(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])
    return again.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("n_parts"))


@query("value_counts_missing", "select case when o_orderkey % 9 = 0 then '(missing)' else o_orderstatus end status, count(*) n from orders group by 1")
def _(t):
    return A.value_counts(t("orders").withColumn("status", F.expr("case when o_orderkey % 9 = 0 then 'nan' else o_orderstatus end")), "status")


@query("status_pivot", "select user_id, count(*) filter (where event_type = 'click') click, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'error') error from events group by 1")
def _(t):
    return A.status_pivot(t("events"), ["user_id"], "event_type", ["click", "view", "error"])


@query("bool_aggregates", "select l_suppkey, count(*) filter (where l_discount > 0.05) n_discounted, bool_or(l_tax > 0.07) any_taxed, count(distinct case when l_returnflag = 'R' then l_partkey end) n_returned_parts, round(count(*) filter (where l_returnflag = 'R') / nullif(count(*), 0)::double, 6) returned_share from lineitem group by 1")
def _(t):
    returned = F.count_if(F.col("l_returnflag") == "R")
    return t("lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.bool_or(F.col("l_tax") > 0.07).alias("any_taxed"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("n_returned_parts"), F.round(F.try_divide(returned, F.count("*")), 6).alias("returned_share"),
    )


_IDKEY = "case when l_suppkey % 3 = 0 then 'CIK:' || l_suppkey when l_suppkey % 3 = 1 then 'GVKEY:' || l_partkey % 50 else 'NAME:' || l_returnflag end"


@query("identity_collapse", f"select l_orderkey, {_IDKEY} identity, count(*) n_mentions, min(l_linenumber)::int first_order, string_agg(distinct l_linestatus, ' | ' order by l_linestatus) statuses from lineitem group by 1, 2")
def _(t):
    key = A.identity_key(F.expr("if(l_suppkey % 3 = 0, cast(l_suppkey as string), '-1')"), F.expr("if(l_suppkey % 3 = 1, cast(l_partkey % 50 as string), '-1')"), F.col("l_returnflag"), ids.valid_id)
    return t("lineitem").groupBy("l_orderkey", key.alias("identity")).agg(F.count("*").alias("n_mentions"), F.min("l_linenumber").alias("first_order"), A.joined_set("l_linestatus", " | ").alias("statuses"))


@query("edges", "select o_custkey, year(o_orderdate)::int fyear, l_suppkey, min(l_linenumber)::int first_order, count(*) n from orders join lineitem on o_orderkey = l_orderkey group by 1, 2, 3")
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fyear"))
    return o.join(t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "fyear", "l_suppkey").agg(F.min("l_linenumber").alias("first_order"), F.count("*").alias("n"))


@query("having_conflict", "select p_name, p_type, count(distinct p_brand) n_brands, string_agg(distinct p_brand, ';' order by p_brand) brands from part group by 1, 2 having n_brands > 1")
def _(t):
    return t("part").groupBy("p_name", "p_type").agg(F.count_distinct("p_brand").alias("n_brands"), A.joined_set("p_brand", ";").alias("brands")).where("n_brands > 1")


@query("metric_summary", "with a as (select count(*) n, count(distinct user_id) u, max(value) m from events) select 'n_events' metric, n::double as value from a union all select 'n_users', u from a union all select 'max_value', m from a")
def _(t):
    return A.summary(t("events"), {"n_events": F.count("*"), "n_users": F.count_distinct("user_id"), "max_value": F.max("value")})


@query("descriptives_grouping", "select coalesce(cast(year(o_orderdate) as varchar), 'all') fyear, o_orderstatus, count(*) n, count(distinct o_custkey) n_customers from orders group by grouping sets ((), (year(o_orderdate)), (o_orderstatus))")
def _(t):
    o = t("orders").select(F.year("o_orderdate").alias("y"), "o_orderstatus", "o_custkey")
    g = o.groupingSets([[], ["y"], ["o_orderstatus"]], "y", "o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"))
    return g.select(F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("fyear"), "o_orderstatus", "n", "n_customers")


@query("rank_best", "select l_partkey, l_orderkey, l_linenumber, l_extendedprice, rank from (select *, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_suppkey)::int as rank from lineitem) where rank <= 3")
def _(t):
    w = Window.partitionBy("l_partkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_suppkey")
    return t("lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("score_gap", "select l_partkey, l_extendedprice, round(l_extendedprice - coalesce(nx, -9999), 4) gap, l_extendedprice >= coalesce(nx, -9999) + 30 wide from (select l_partkey, l_extendedprice, lead(l_extendedprice) over w nx, row_number() over w k from lineitem window w as (partition by l_partkey order by l_extendedprice desc)) where k = 1")
def _(t):
    w = Window.partitionBy("l_partkey").orderBy(F.col("l_extendedprice").desc())
    s = t("lineitem").select("l_partkey", "l_extendedprice", F.lead("l_extendedprice", 1, -9999.0).over(w).alias("nx"), F.row_number().over(w).alias("k")).where("k = 1")
    return s.select("l_partkey", "l_extendedprice", F.round(F.col("l_extendedprice") - F.col("nx"), 4).alias("gap"), (F.col("l_extendedprice") >= F.col("nx") + 30).alias("wide"))


@query("group_min_keep", "select p_brand, p_type, p_size, count(*) n from part where p_size = (select min(q.p_size) from part q where q.p_brand = part.p_brand and q.p_type = part.p_type) group by 1, 2, 3")
def _(t):
    low = t("part").groupBy("p_brand", "p_type").agg(F.min("p_size").alias("p_size"))
    return t("part").join(low, ["p_brand", "p_type", "p_size"], "left_semi").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"))


@query("topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("stratified_sample")
def _(t):
    return A.stratified(t("events").select("event_id", "event_type", "value"), "event_type", "event_id", 100)


@query("surrogate_ids", "select 'step7_residual_' || lpad(cast(row_number() over (order by n desc, p_name) as varchar), 6, '0') record_id, p_name, n from (select p_name, count(*) n from part group by 1)")
def _(t):
    g = t("part").groupBy("p_name").agg(F.count("*").alias("n"))
    placed = positions(g, F.struct((-F.col("n")).alias("n"), "p_name"))
    return placed.select(F.format_string("step7_residual_%06d", F.col("place")).alias("record_id"), "p_name", "n")


@query("explode_alternatives", "select p_partkey, unnest(string_split(p_name || '|' || p_type || '|' || p_name, '|')) alternative from part")
def _(t):
    return t("part").select("p_partkey", F.explode(F.split(F.concat_ws("|", "p_name", "p_type", "p_name"), r"\|")).alias("alternative"))


@query("run_diff", """with a as (select o_orderkey, o_orderstatus s from orders where o_orderkey % 10 <> 1), b as (select o_orderkey, case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end s from orders where o_orderkey % 10 <> 2)
select coalesce(a.o_orderkey, b.o_orderkey) o_orderkey, a.s as before, b.s as after, case when a.s is null then 'added' when b.s is null then 'removed' when a.s = b.s then 'same' else 'changed' end change from a full join b on a.o_orderkey = b.o_orderkey""")
def _(t):
    a = t("orders").where("o_orderkey % 10 <> 1").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    b = t("orders").where("o_orderkey % 10 <> 2").select("o_orderkey", F.expr("case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end").alias("s"))
    return U.diff_runs(a, b, "o_orderkey", "s")


@query("run_diff_summary", """with a as (select o_orderkey, o_orderstatus s from orders where o_orderpriority <> '1-URGENT'), b as (select o_orderkey, case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end s from orders where o_orderpriority <> '5-LOW'),
c as (select coalesce(a.o_orderkey, b.o_orderkey) k, case when a.s is null then 'added' when b.s is null then 'removed' when a.s = b.s then 'same' else 'changed' end change from a full join b on a.o_orderkey = b.o_orderkey),
l as (select o_orderstatus as layer, change, k, row_number() over (partition by o_orderstatus, change order by k) r from c join orders on k = o_orderkey)
select layer, change, count(*) n, string_agg(k, ';' order by k) filter (where r <= 3) spots from l group by 1, 2""")
def _(t):
    o = t("orders")
    a = o.where("o_orderpriority <> '1-URGENT'").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    b = o.where("o_orderpriority <> '5-LOW'").select("o_orderkey", F.expr("case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end").alias("s"))
    changes = U.diff_runs(a, b, "o_orderkey", "s").join(o.select("o_orderkey", F.col("o_orderstatus").alias("layer")), "o_orderkey")
    return U.diff_summary(changes, "layer", "o_orderkey")


@query("count_difference", """with a as (select o_orderpriority, count(*) n from orders where o_orderkey % 2 = 0 group by 1), b as (select o_orderpriority, count(*) n from orders where o_orderkey % 3 = 0 group by 1)
select coalesce(a.o_orderpriority, b.o_orderpriority) o_orderpriority, coalesce(a.n, 0) n_before, coalesce(b.n, 0) n_after, coalesce(b.n, 0) - coalesce(a.n, 0) difference from a full join b on a.o_orderpriority = b.o_orderpriority""")
def _(t):
    return U.count_difference(t("orders").where("o_orderkey % 2 = 0"), t("orders").where("o_orderkey % 3 = 0"), "o_orderpriority")


@query("intersect_ids", "select o_custkey from orders where o_orderpriority = '1-URGENT' intersect select o_custkey from orders where o_orderstatus = 'F'")
def _(t):
    return U.intersect_keys(t("orders").where("o_orderpriority = '1-URGENT'"), t("orders").where("o_orderstatus = 'F'"), "o_custkey")


@query("except_ids", "select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'F'")
def _(t):
    return U.except_keys(t("customer").select("c_custkey"), t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("union_all_missing_cols", "select s_suppkey k, s_name as name, '' segment from supplier union all select c_custkey, c_name, c_mktsegment from customer")
def _(t):
    return U.union_all([t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))], "")


@query("upsert", "select k, v from (select o_custkey k, o_orderpriority v, o_orderkey % 2 s, row_number() over (partition by o_custkey order by o_orderkey % 2 desc, o_orderkey desc) r from orders) where r = 1")
def _(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    return U.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["k"], [F.col("o_orderkey").desc()]).select("k", "v")


@query("year_window", "select o_orderkey, o_custkey, year(o_orderdate)::int fyear from orders where year(o_orderdate) between 1996 and 1999 and not contains(lower(o_orderpriority), 'low')")
def _(t):
    return t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fyear"), "o_orderpriority").where(F.col("fyear").between(1996, 1999) & ~F.lower("o_orderpriority").contains("low")).drop("o_orderpriority")


@query("mixed_sort", "select o_orderkey, o_orderstatus, o_totalprice, row_number() over (order by o_orderstatus, o_totalprice desc nulls last, o_orderkey)::int as place from orders")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    order = F.struct(F.col("o_orderstatus").isNull().alias("a"), "o_orderstatus", F.col("o_totalprice").isNull().alias("b"), (-F.col("o_totalprice")).alias("c"), "o_orderkey")
    return positions(o, order).withColumn("place", F.col("place").cast("int"))


@query("worklist", "select distinct p_brand from part where p_brand is not null union select trim(x) from (select unnest(string_split('Brand#1, Brand#2,Brand#99', ',')) x)")
def _(t):
    listed = t("part").sparkSession.createDataFrame([("Brand#1, Brand#2,Brand#99",)], "x string").select(F.explode(F.transform(F.split("x", ","), lambda b: F.trim(b))).alias("p_brand"))
    return t("part").select("p_brand").where("p_brand is not null").union(listed).distinct()
