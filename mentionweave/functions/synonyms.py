"""Names under the synonyms of their words, and without their tails.

Words are looked up once a name, where they stand between characters that are neither letters nor digits; a name's variants are the products
of what its words may be, the fewest changes first, and no more than a bound of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from .names import let, lookup, squeeze, text


def synonyms(table: dict[str, str] = V.STANDARD_TOKENS, dropped: Iterable[str] = tuple(V.REMOVABLE_SUFFIXES)) -> dict[str, list[str]]:
    """What else each word may be, in order: the words that are written as the same token, that token, and nothing."""
    groups: dict[str, set[str]] = {}
    for word, token in table.items():
        groups.setdefault(token, {token}).add(word)
    for word in dropped:
        groups.setdefault(word, {word})
    return {word: ["", *sorted(group - {word})] for _, group in sorted(groups.items()) for word in sorted(group)}


def expanded(c: Column | str, options: dict[str, list[str]], most: int = 64) -> Column:
    """array(struct(changed, name)): upper-case variants of a name, those of fewest changed words first, then by name; at most `most` on the way and in the end.

    The name itself and empty ones are left out.
    """
    name = squeeze(F.upper(text(c)))
    known = lookup({k: "|".join(v) for k, v in options.items()})
    none = F.array().cast("array<string>")
    item = lambda changed, x: F.struct(changed.alias("changed"), x.alias("name"))

    def step(acc: Column, word: Column) -> Column:
        others = F.coalesce(F.split(F.try_element_at(known, word), r"\|", -1), none)
        grown = F.flatten(F.transform(acc, lambda a: F.concat(F.array(item(a["changed"], F.concat(a["name"], word))), F.transform(others, lambda o: item(a["changed"] + 1, F.concat(a["name"], o))))))
        return F.when(F.size(others) > 0, F.slice(F.array_sort(grown), 1, most)).otherwise(F.transform(acc, lambda a: item(a["changed"], F.concat(a["name"], word))))

    def product(x: Column) -> Column:
        words = F.regexp_extract_all(x, F.lit("[A-Z0-9]+|[^A-Z0-9]+"), F.lit(0))
        every = F.aggregate(words, F.array(item(F.lit(0), F.lit(""))), step)
        return F.array_sort(F.transform(every, lambda a: item(a["changed"], squeeze(a["name"]))))

    def first_of_equals(found: Column) -> Column:
        given = F.transform(found, lambda a: a["name"])
        return F.filter(found, lambda a, i: (F.array_position(given, a["name"]) == i + 1) & (a["name"] != ""))

    return let(name, lambda x: F.filter(let(product(x), first_of_equals), lambda a: a["name"] != x))


def without_tail(c: Column | str, longest: int = 7) -> Column:
    """array: the name before its last slash, backslash or hyphen, where no more than `longest` characters come after; a slash at the very end does not count."""
    x = squeeze(text(c))
    signs = (("/", "[^/]+/?"), (r"\\", r"[^\\]+\\?"), ("-", "[^-]*"))
    cut = [F.when(F.length(F.regexp_extract(x, rf"^.*{sign}({tail})$", 1)) <= longest, F.trim(F.regexp_extract(x, rf"^(.*){sign}{tail}$", 1))).otherwise("") for sign, tail in signs]
    return F.array_distinct(F.filter(F.array(*cut), lambda v: v != ""))
