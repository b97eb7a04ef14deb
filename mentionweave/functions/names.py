"""Company names as Column expressions: repair, standard form, legal forms, parents, variants, shapes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V



def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(_c(c), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words between single spaces; none for an empty name."""
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def words(terms: Iterable[str]) -> Column:
    return F.array(*map(F.lit, terms))


def lookup(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def mapped(c: Column, table: dict[str, str]) -> Column:
    """Each word replaced by what the table has for it."""
    m = lookup(table)
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(m, t), t)), " ")


def repair(c: Column | str, drop_tm: bool = True) -> Column:
    """Wrongly decoded strings put right; `drop_tm` also deletes TM inside words, as results require."""
    pairs = [(a, b) for a, b in V.MOJIBAKE if drop_tm or a != "TM"]
    return strip(reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text(c)))


def uniform(c: Column | str, strip_suffixes: bool = False) -> Column:
    """Parentheses dropped with their content, upper case, no commas or dots, hyphens as spaces."""
    x = F.upper(F.regexp_replace(text(c), r"\([^)]*\)", ""))
    x = strip(F.translate(x, "-,.", " "))
    if not strip_suffixes:
        return x
    end = "|".join(sorted(V.UNIFORM_SUFFIXES, key=len, reverse=True))
    return F.array_join(tokens(F.regexp_replace(squeeze(x), rf"(?:(?:^| )(?:{end}))+$", "")), " ")


def close_up(c: Column) -> Column:
    """Spelled legal forms closed up, in the fixed order; only where single letters stand together."""
    done = lambda v: reduce(lambda x, f: F.regexp_replace(x, r"\b" + r"\s+".join(f.split()) + r"\b", f.replace(" ", "")), V.SPACED_FORMS, v)
    return let(c, lambda v: F.when(v.rlike(r"\b[A-Z]\s+[A-Z]\b"), done(v)).otherwise(v))


def owner(c: Column | str) -> Column:
    """The owner or parent that a name mentions, else the repaired name."""
    edge = lambda y: F.regexp_replace(y, r"^[ .;,)]+|[ .;,)]+$", "")
    owned = lambda x: edge(F.regexp_extract(x, r"(?i)\(\s*owned by\s+([^()]+)\s*\)\s*$", 1))
    holder = lambda x: F.regexp_replace(F.regexp_extract(x, r"^(.+?)['’]s\s+.+$", 1), r"^[ .;,]+|[ .;,]+$", "")
    unit = lambda x: F.regexp_extract(x, r"(?i)(?:,\s*)?(?:a\s+)?(?:division|unit|subsidiary|business|brand)\s+of\s+(.+)$", 1)
    part = lambda x: strip(F.regexp_extract(edge(unit(x)), r"^([^,(;]*)", 1))
    long = lambda f, n: lambda x: let(f(x), lambda y: F.when(F.length(y) > n, y))
    return let(repair(c), lambda x: F.coalesce(long(owned, 0)(x), long(holder, 2)(x), long(part, 2)(x), x))


def standard(c: Column | str, parent: bool = False) -> Column:
    """The standard name; with `parent`, of the owner that the name mentions."""
    x = close_up(uniform(owner(c) if parent else repair(c)))
    x = F.replace(x, F.lit("PRO FORMA"), F.lit(""))
    x = F.regexp_replace(F.regexp_replace(x, r"\bCL [A-Z]\b", ""), r"\bTHE\b", "")
    return mapped(x, V.STANDARD_TOKENS)


def suffix_pattern(suffixes: Iterable[str], may_empty: bool = False) -> str:
    alternatives = "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))
    return rf"(?:(?:^| )(?:{alternatives}))+$" if may_empty else rf"(?: (?:{alternatives}))+$"


def strip_suffixes(c: Column | str, suffixes: Iterable[str] = tuple(V.REMOVABLE_SUFFIXES)) -> Column:
    """Legal forms off the end, to a fixpoint; one word stays."""
    return F.regexp_replace(_c(c), suffix_pattern(suffixes), "")


def canonical(c: Column | str, suffixes: Iterable[str] = tuple(V.RECOVERY_SUFFIXES)) -> Column:
    """Legal forms off the end, to the empty name if need be."""
    return F.regexp_replace(_c(c), suffix_pattern(suffixes, may_empty=True), "")


def safe_core(c: Column | str) -> Column:
    """The name without its legal forms, or null where that is not safe or changes nothing."""
    name = _c(c)

    def judged(core: Column) -> Column:
        unsafe = (core == name) | (F.length(core) < 4) | F.replace(core, F.lit(","), F.lit("")).rlike(r"^\d+$") | (name.contains(" ") & ~core.contains(" "))
        return F.when(~unsafe, core)

    return let(strip_suffixes(name), judged)


def without_legal_terms(c: Column | str) -> Column:
    """Legal terms removed anywhere in the name."""
    legal = words(V.LEGAL_TERMS)
    return F.array_join(F.filter(tokens(_c(c)), lambda t: ~F.array_contains(legal, t)), " ")


def _plain_letters() -> tuple[str, str]:
    """Characters that are a plain ASCII one with marks or in another form, and that one, by Unicode's compatibility decomposition."""
    found = {}
    for code in range(0xA0, 0x10000):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii():
            found[chr(code)] = plain
    return "".join(found), "".join(found.values())


MARKED, PLAIN = _plain_letters()


def strip_accents(c: Column | str) -> Column:
    """Letters without their marks and in their plain form; marks on their own go."""
    return F.regexp_replace(F.translate(_c(c), MARKED, PLAIN), r"\p{Mn}+", "")


def alnum_key(c: Column | str, accents: bool = False) -> Column:
    """Upper case letters and digits, anything else as one space."""
    x = text(c)
    return F.trim(F.regexp_replace(F.upper(strip_accents(x) if accents else x), "[^A-Z0-9]+", " "))


def recovery_name(c: Column | str) -> Column:
    """The recovery stages' name: CO for `and company`, AND for &, letters and digits only, words mapped."""
    x = F.upper(strip_accents(no_null_word(c)))
    x = F.regexp_replace(x, r"\bAND\s+(?:COMPANY|CO)\b", " CO ")
    x = F.regexp_replace(x, r"&\s*(?:COMPANY|CO)\b", " CO ")
    x = F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " ")
    return mapped(x, V.RECOVERY_TOKENS)


#: A name whose first word no pattern of the recovery stages can change: ASCII letters and digits, after nothing but ASCII marks other than &.
_HEAD = r"^[\x00-\x25\x27-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+([A-Za-z0-9]++)(?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|\z)"


def _first_word(c: Column | str, table: dict[str, str], whole) -> Column:
    """The first word of whole(c), which is worked out for the few names alone that one cheap pattern can't read."""

    def judged(head: Column) -> Column:
        plain = (head != "") & (head != "AND") & ~F.lower(strip(text(c))).isin(*V.NULL_WORDS)
        return F.when(plain, F.coalesce(F.try_element_at(lookup(table), head), head) if table else head).otherwise(F.split(whole(c), " ", 2)[0])

    return let(F.upper(F.regexp_extract(text(c), _HEAD, 1)), judged)


def recovery_first_word(c: Column | str) -> Column:
    """The first word of the recovery name."""
    return _first_word(c, V.RECOVERY_TOKENS, recovery_name)


def partial_first_word(c: Column | str) -> Column:
    """The first word of the partial-evidence name, which a possessive S may have been glued to."""
    possessive = text(c).rlike(r"(?i)[^A-Z0-9]S[^A-Z0-9]*\z")
    return F.when(possessive, F.split(partial_name(c), " ", 2)[0]).otherwise(_first_word(c, {}, partial_name))


def candidate_name(c: Column | str) -> Column:
    """H12 of the candidate stage: separators as spaces, COMPANY as CO, words mapped, aliases applied."""
    x = strip_accents(repair(c))
    x = squeeze(F.regexp_replace(F.replace(F.regexp_replace(x, r"[\[\](){}]", " "), F.lit("&"), F.lit(" AND ")), "[-/\\\\,.;:'\"`’‘“”]+", " "))
    x = squeeze(F.regexp_replace(F.regexp_replace(x, r"(?i)\bAND\s+CO(?:MPANY)?\b", " CO "), r"(?i)\bCOMPANY\b", " CO "))
    x = F.replace(close_up(uniform(x)), F.lit("PRO FORMA"), F.lit(""))
    x = mapped(F.regexp_replace(F.regexp_replace(x, r"\bCL [A-Z]\b", ""), r"\bTHE\b", ""), V.STANDARD_TOKENS)
    return F.coalesce(F.try_element_at(lookup(V.ALIASES), x), x)


def partial_name(c: Column | str) -> Column:
    """The partial-evidence name; a single possessive S is glued to the word before it."""
    x = F.upper(strip_accents(no_null_word(c)))
    x = F.trim(F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "))
    return F.when(x.rlike(r"^\S{3,} S$"), F.regexp_replace(x, " S$", "S")).otherwise(x)


def compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def no_null_word(c: Column | str) -> Column:
    """Stripped; null and the words that stand for it are empty."""
    x = strip(text(_c(c).cast("string")))
    return F.when(F.lower(x).isin(*V.NULL_WORDS), "").otherwise(x)


def capital(c: Column | str) -> Column:
    """Begins with a capital, or with digits and a letter."""
    return strip(text(c)).rlike(r"^(?:\p{Lu}|\d+[A-Za-z])")


def acronym(c: Column | str) -> Column:
    """First letters of a name of three words or more, else empty."""
    t = tokens(text(c))
    return F.when(F.size(t) >= 3, F.upper(F.array_join(F.transform(t, lambda w: F.left(w, F.lit(1))), ""))).otherwise("")


def _latin(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z]+"), F.lit(0))


def generic_score(c: Column | str) -> Column:
    """Number of generic words."""
    generic = words(V.GENERIC_TERMS)
    return F.size(F.filter(_latin(c), lambda t: F.array_contains(generic, t)))


def is_category(c: Column | str) -> Column:
    """Two words or more that end in a category's head noun, or a known phrase."""
    t = _latin(c)
    return (F.size(t) >= 2) & (F.array_contains(words(V.CATEGORY_HEADS), F.try_element_at(t, F.lit(-1))) | F.lower(strip(text(c))).isin(*V.FINANCIAL_PHRASES))


def has_risk_term(c: Column | str) -> Column:
    """Holds a word that makes external evidence risky."""
    return F.arrays_overlap(F.regexp_extract_all(F.upper(text(c)), F.lit("[A-Z0-9]+"), F.lit(0)), words(V.RISK_TERMS))


def has_legal_suffix(c: Column | str) -> Column:
    """Holds a legal form as a word."""
    return text(c).rlike(r"(?i)\b(?:" + "|".join(V.LEGAL_SUFFIX_WORDS) + r")\b")


def suffix_class(c: Column | str) -> Column:
    """Strong, medium or low class of the last word of a standard name, else empty."""
    last = F.try_element_at(tokens(_c(c)), F.lit(-1))
    chain = F.when(last.isin(*V.STRONG_SUFFIXES), "strong_parent_entity").when(last.isin(*V.MEDIUM_SUFFIXES), "medium_corporate_entity")
    return chain.when(last.isin(*V.LOW_SUFFIXES), "low_legal_form").otherwise("")


def suffix_score(c: Column | str) -> Column:
    """25, 15, 5 or 0 by class."""
    kind = suffix_class(c)
    return F.when(kind == "strong_parent_entity", 25).when(kind == "medium_corporate_entity", 15).when(kind == "low_legal_form", 5).otherwise(0)


def prefixes(c: Column | str, most: int = 3) -> Column:
    """The first one to `most` words, the longest first."""
    t = F.slice(tokens(_c(c)), 1, most)
    return F.when(F.size(t) > 0, F.transform(F.sequence(F.size(t), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(t, F.lit(1), k), " "))).otherwise(F.array().cast("array<string>"))


def continuation(parent: Column, prefix: Column) -> Column:
    """The words of `parent` after `prefix`, or all of them if it does not begin so."""
    p, q = tokens(parent), tokens(prefix)
    begins = F.slice(p, F.lit(1), F.greatest(F.size(q), F.lit(1))) == q
    return F.when((F.size(q) > 0) & begins, F.slice(p, F.size(q) + 1, F.greatest(F.size(p), F.lit(1)))).otherwise(p)


def unsafe_continuation(parent: Column, prefix: Column) -> Column:
    """Words after the prefix that are not known to be harmless."""
    safe = words(V.SAFE_GLOBAL_CONTINUATIONS)
    return F.filter(continuation(parent, prefix), lambda t: ~F.array_contains(safe, t))


def _readings(given: Column, x: Column) -> Column:
    edge = lambda y: F.regexp_replace(y, r"^[ .;,]+|[ .;,]+$", "")
    item = lambda name, method, parent=False: F.struct(name.alias("name"), method.alias("method"), F.lit(parent).alias("parent"))
    bracket = r"^(.+?)\s*\(([^()]+)\)\s*$"
    one = lambda name, method: F.array(item(name, F.lit(method)))
    none = F.array().cast("array<struct<name:string,method:string,parent:boolean>>")
    parts = lambda pattern: F.filter(F.transform(F.split(x, pattern), edge), lambda p: p != "")
    counted = lambda array, label: F.transform(array, lambda p, i: item(p, F.concat(F.lit(label), (i + 1).cast("string"))))
    slashed = F.when(x.contains("/"), let(parts(r"\s*/\s*"), lambda a: F.when(F.size(a) >= 2, counted(a, "slash_part_")).otherwise(none))).otherwise(none)
    twice = r"(?i)^(.+?)\s+and\s+(.+?)\s+affiliates?$"
    repeated = let(
        F.struct(edge(F.regexp_extract(x, twice, 1)).alias("l"), edge(F.regexp_extract(x, twice, 2)).alias("r")),
        lambda s: F.when((s["l"] != "") & (F.lower(s["l"]) == F.lower(s["r"])), one(s["l"], "remove_repeated_and_affiliates")).otherwise(none),
    )
    split_and = let(parts(r"(?i)\s+and\s+"), lambda a: F.when(F.size(a) == 2, counted(a, "and_part_")).otherwise(none))
    both = x.rlike(r"(?i)\s+and\s+") & ~F.lower(x).contains("affiliate")
    every = [
        one(given, "full_raw"),
        one(edge(F.regexp_extract(x, bracket, 1)), "outside_parentheses"),
        one(edge(F.regexp_extract(x, bracket, 2)), "inside_parentheses"),
        F.array(item(given, F.lit("parent_or_owner_recovery"), True)),
        slashed,
        one(edge(F.regexp_extract(x, r"(?i)^(.+?)\s+and\s+(?:its\s+|their\s+)?affiliates?$", 1)), "remove_and_affiliates"),
        repeated,
        F.when(both, split_and).otherwise(none),
    ]
    return F.filter(F.concat(*every), lambda v: v["name"] != "")


def raw_variants(c: Column | str) -> Column:
    """(name, method, parent) readings of a raw name, in order; empty ones are left out."""
    return let(F.struct(text(c).alias("g"), repair(c).alias("x")), lambda s: _readings(s["g"], s["x"]))


def variants(c: Column | str) -> Column:
    """Ordered (name, method) candidates of a raw name: each reading's standard name, then its safe core; the first of equal names stays."""
    item = lambda name, method: F.struct(name.alias("name"), method.alias("method"))

    def both(v: Column) -> Column:
        name = standard(F.when(v["parent"], owner(v["name"])).otherwise(v["name"]))
        return let(name, lambda n: F.array(item(n, v["method"]), item(F.coalesce(safe_core(n), F.lit("")), F.concat(v["method"], F.lit("_suffix_cleaned")))))

    every = F.filter(F.flatten(F.transform(raw_variants(c), both)), lambda v: v["name"] != "")
    return F.aggregate(
        every,
        F.array().cast("array<struct<name:string,method:string>>"),
        lambda acc, v: F.when(F.exists(acc, lambda a: a["name"] == v["name"]), acc).otherwise(F.array_append(acc, v)),
    )


def keyword_filter(c: Column | str) -> Column:
    """What a raw name is by rule alone, before any model: struct(decision, kind, source), or null for the model to judge."""
    name = strip(text(c))
    low = F.lower(name)
    found = owner(name)
    item = lambda decision, kind, source: F.struct(F.lit(decision).alias("decision"), F.lit(kind).alias("kind"), F.lit(source).alias("source"))
    firm, counted, technical = (rf"{before}(?:{'|'.join(w)})\b" for before, w in ((r"\b", V.FIRM_WORDS), (r"^\d+\s+(?:other\s+)?", V.COUNTED_NOUNS), (r"\b", V.TECHNICAL_TERMS)))
    return (
        F.when(name == "", item("drop", "artifact", "deterministic_empty"))
        .when(low.isin(*V.ARTIFACTS), item("drop", "artifact", "deterministic_artifact"))
        .when(found != repair(name), item("accept", "company", "deterministic_parent_recovery"))
        .when(has_legal_suffix(low), item("accept", "company", "deterministic_legal_suffix"))
        .when(name.startswith("@") & ~low.rlike(firm), item("drop", "social_handle", "deterministic_social_handle"))
        .when(low.rlike(counted), item("drop", "generic_phrase", "deterministic_generic_phrase"))
        .when(low.rlike(technical), item("drop", "technical_term", "deterministic_technical_term"))
    )
