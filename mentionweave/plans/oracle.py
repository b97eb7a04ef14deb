"""The name functions as SQL text, for the oracles. Written from their definitions, apart from the Columns."""

from __future__ import annotations

from collections.abc import Iterable

from .. import vocab as V


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(terms: Iterable[str]) -> str:
    return "[" + ", ".join(map(q, terms)) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def repair(x: str) -> str:
    x = f"coalesce({x}, '')"
    for a, b in V.MOJIBAKE:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return strip(x)


def uniform(x: str) -> str:
    return strip(rf"translate(upper(regexp_replace(coalesce({x}, ''), '\([^)]*\)', '', 'g')), '-,.', ' ')")


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda t: t <> '')"


def mapped(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"when {q(a)} then {q(b)}" for a, b in table.items())
    return f"coalesce(array_to_string(list_transform({tokens(x)}, lambda t: case t {cases} else t end), ' '), '')"


def close_up(x: str) -> str:
    for f in V.SPACED_FORMS:
        x = rf"regexp_replace({x}, '\b{r'\s+'.join(f.split())}\b', '{f.replace(' ', '')}', 'g')"
    return x


def finish(x: str) -> str:
    x = f"replace({close_up(uniform(x))}, 'PRO FORMA', '')"
    return mapped(rf"regexp_replace(regexp_replace({x}, '\bCL [A-Z]\b', '', 'g'), '\bTHE\b', '', 'g')", V.STANDARD_TOKENS)


def standard(x: str) -> str:
    return finish(repair(x))


def owner(x: str) -> str:
    r = repair(x)
    owned = rf"regexp_replace(regexp_extract({r}, '(?i)\(\s*owned by\s+([^()]+)\s*\)\s*$', 1), '^[ .;,)]+|[ .;,)]+$', '', 'g')"
    holder = rf"regexp_replace(regexp_extract({r}, '^(.+?)[''’]s\s+.+$', 1), '^[ .;,]+|[ .;,]+$', '', 'g')"
    unit = rf"regexp_extract({r}, '(?i)(?:,\s*)?(?:a\s+)?(?:division|unit|subsidiary|business|brand)\s+of\s+(.+)$', 1)"
    unit = strip(rf"regexp_extract(regexp_replace({unit}, '^[ .;,)]+|[ .;,)]+$', '', 'g'), '^([^,(;]*)', 1)")
    return f"case when {owned} <> '' then {owned} when length({holder}) > 2 then {holder} when length({unit}) > 2 then {unit} else {r} end"


def ends(suffixes: Iterable[str], empty: bool = False) -> str:
    return ("(?:(?:^| )(?:" if empty else "(?: (?:") + "|".join(sorted(suffixes, key=lambda s: (-len(s), s))) + "))+$"


def strip_suffixes(x: str, suffixes: Iterable[str] = V.REMOVABLE_SUFFIXES) -> str:
    return f"regexp_replace({x}, '{ends(suffixes)}', '')"


def canonical(x: str, suffixes: Iterable[str] = V.RECOVERY_SUFFIXES) -> str:
    return f"regexp_replace({x}, '{ends(suffixes, True)}', '')"


def safe_core(x: str) -> str:
    c = strip_suffixes(x)
    return rf"case when {c} = {x} or length({c}) < 4 or regexp_matches(replace({c}, ',', ''), '^\d+$') or (contains({x}, ' ') and not contains({c}, ' ')) then null else {c} end"


def without_legal(x: str) -> str:
    return f"coalesce(array_to_string(list_filter({tokens(x)}, lambda t: not list_contains({listed(V.LEGAL_TERMS)}, t)), ' '), '')"


def alnum(x: str) -> str:
    return f"trim(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]+', ' ', 'g'))"


def null_word(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"case when lower({s}) in ('nan', 'none', 'null', '<na>') then '' else {s} end"


def recovery(x: str) -> str:
    x = f"upper({null_word(x)})"
    x = rf"regexp_replace(regexp_replace({x}, '\bAND\s+(?:COMPANY|CO)\b', ' CO ', 'g'), '&\s*(?:COMPANY|CO)\b', ' CO ', 'g')"
    return mapped(f"regexp_replace(replace({x}, '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')", V.RECOVERY_TOKENS)


def clean_id(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return rf"case when {s} <> '' and lower({s}) not in ('nan', 'none') then regexp_replace({s}, '\.0$', '') end"


def valid_id(x: str, stage: str) -> str:
    s = strip(f"coalesce({x}, '')")
    low = s if stage == "long" else f"lower({s})"
    return f"({s} <> '' and {low} not in ({', '.join(map(q, V.SENTINELS[stage]))}))"


def capital(x: str) -> str:
    return rf"regexp_matches({strip(f'coalesce({x}, {q(str())})')}, '^(?:\p{{Lu}}|\d+[A-Za-z])')"


def variants(x: str) -> str:
    """Ordered list of {name, method} as in the matcher's definition."""
    r = repair(x)
    edge = lambda y: rf"regexp_replace({y}, '^[ .;,]+|[ .;,]+$', '', 'g')"
    raw = f"coalesce({x}, '')"
    one = lambda n, m, p="false": f"[struct_pack(name := {n}, method := {m}, parent := {p})]"
    none = one("''", "''") + "[1:0]"
    slash = rf"list_filter(list_transform(string_split_regex({r}, '\s*/\s*'), lambda p: {edge('p')}), lambda p: p <> '')"
    ands = rf"list_filter(list_transform(string_split_regex({r}, '(?i)\s+and\s+'), lambda p: {edge('p')}), lambda p: p <> '')"
    left, right = (edge(rf"regexp_extract({r}, '(?i)^(.+?)\s+and\s+(.+?)\s+affiliates?$', {k})") for k in (1, 2))
    bracket = r"^(.+?)\s*\(([^()]+)\)\s*$"
    parts = [
        one(raw, "'full_raw'"),
        one(edge(f"regexp_extract({r}, '{bracket}', 1)"), "'outside_parentheses'"),
        one(edge(f"regexp_extract({r}, '{bracket}', 2)"), "'inside_parentheses'"),
        one(raw, "'parent_or_owner_recovery'", "true"),
        f"case when contains({r}, '/') and len({slash}) >= 2 then list_transform({slash}, lambda p, i: struct_pack(name := p, method := 'slash_part_' || i, parent := false)) else {none} end",
        one(edge(rf"regexp_extract({r}, '(?i)^(.+?)\s+and\s+(?:its\s+|their\s+)?affiliates?$', 1)"), "'remove_and_affiliates'"),
        f"case when {left} <> '' and lower({left}) = lower({right}) then {one(left, q('remove_repeated_and_affiliates'))} else {none} end",
        rf"case when regexp_matches({r}, '(?i)\s+and\s+') and not contains(lower({r}), 'affiliate') and len({ands}) = 2 then list_transform({ands}, lambda p, i: struct_pack(name := p, method := 'and_part_' || i, parent := false)) else {none} end",
    ]
    return "list_filter(list_concat(" + ", ".join(parts) + "), lambda v: v.name <> '')"


def variant_ctes(source: str, key: str = "raw") -> str:
    """CTEs that end in `reading`: key, place (from 0), name, method; the first of equal names."""
    return f"""
v0 as (select distinct {key} from {source}),
v1 as (select {key}, unnest({variants(key)}) v, generate_subscripts({variants(key)}, 1) i from v0),
v2 as (select {key}, i, v.method m, case when v.parent then {owner('v.name')} else v.name end nm from v1),
v3 as (select {key}, i, m, {standard('nm')} s from v2),
v4 as (select {key}, i * 2 i, m, s from v3 union all select {key}, i * 2 + 1, m || '_suffix_cleaned', {safe_core('s')} from v3),
v5 as (select {key}, i, m, s, row_number() over (partition by {key}, s order by i) k from v4 where coalesce(s, '') <> ''),
reading as (select {key}, row_number() over (partition by {key} order by i) - 1 place, s name, m method from v5 where k = 1)"""


def candidate(x: str) -> str:
    """The candidate stage's name; ASCII input."""
    x = rf"replace(regexp_replace({repair(x)}, '[\[\](){{}}]', ' ', 'g'), '&', ' AND ')"
    x = squeeze(f"regexp_replace({x}, '[-/\\\\,.;:''\"`’‘“”]+', ' ', 'g')")
    x = squeeze(rf"regexp_replace(regexp_replace({x}, '(?i)\bAND\s+CO(?:MPANY)?\b', ' CO ', 'g'), '(?i)\bCOMPANY\b', ' CO ', 'g')")
    x = finish(x)
    return f"case {x} " + " ".join(f"when {q(a)} then {q(b)}" for a, b in V.ALIASES.items()) + f" else {x} end"


def partial(x: str) -> str:
    x = f"trim(regexp_replace(replace(upper({null_word(x)}), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'))"
    return rf"case when regexp_matches({x}, '^\S{{3,}} S$') then regexp_replace({x}, ' S$', 'S') else {x} end"
