"""Identifiers, industry codes and years as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from .names import no_null_word, strip, text


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_id(c: Column | str, width: int | None = None) -> Column:
    """Stripped, without a trailing .0, zero-padded to `width`; null for empty and null words."""
    x = strip(text(_c(c).cast("string")))
    x = F.when((x != "") & ~F.lower(x).isin("nan", "none"), F.regexp_replace(x, r"\.0$", ""))
    return x if width is None else F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def id_or_missing(c: Column | str, missing: str = "-1") -> Column:
    return F.coalesce(clean_id(c), F.lit(missing))


def valid_id(c: Column | str, stage: str = "final") -> Column:
    """Neither empty nor one of the stage's sentinels."""
    x = strip(text(_c(c).cast("string")))
    low = F.lower(x) if stage != "long" else x
    return (x != "") & ~low.isin(*V.SENTINELS[stage])


def first_valid(columns: list[Column | str], stage: str = "final", missing: str = "-1") -> Column:
    """The first valid identifier, or `missing`."""
    return F.coalesce(*[F.when(valid_id(c, stage), clean_id(c)) for c in columns], F.lit(missing))


def first_text(columns: list[Column | str]) -> Column:
    """The first value that is not blank, or the empty string."""
    return F.coalesce(*[F.nullif(no_null_word(c), F.lit("")) for c in columns], F.lit(""))


def format_sic(c: Column | str) -> Column:
    """Numbers as integers of four digits at least, else the digits alone, else empty."""
    x = strip(text(_c(c).cast("string")))
    number = x.try_cast("double").try_cast("long").cast("string")
    digits = F.coalesce(number, F.nullif(F.regexp_replace(x, r"\D", ""), F.lit("")))
    return F.coalesce(F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(""))


def sic_codes(c: Column | str) -> Column:
    """All codes of two to four digits in a text, padded to four, sorted and distinct."""
    found = F.regexp_extract_all(no_null_word(c), F.lit(r"\d{2,4}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.lpad(t, 4, "0"))))


def sic_support(focal: Column | str, candidate: Column | str) -> Column:
    """8.7b: struct(support, bonus) of a candidate's code against the focal codes."""
    codes, digits = sic_codes(focal), F.regexp_replace(no_null_word(candidate), r"\D", "")
    code = F.right(F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(4))
    item = lambda name, bonus: F.struct(F.lit(name).alias("support"), F.lit(bonus).alias("bonus"))
    near = lambda n: F.exists(codes, lambda s: F.left(s, F.lit(n)) == F.left(code, F.lit(n)))
    return (
        F.when((F.size(codes) == 0) | (digits == ""), item("no_sic_available", 0))
        .when(F.array_contains(codes, code), item("sic4_match", 20))
        .when(near(3), item("sic3_match", 12))
        .when(near(2), item("sic2_match", 8))
        .otherwise(item("sic_mismatch", -8))
    )


def filing_year(c: Column | str) -> Column:
    """The year in `..._yyyymmdd.txt`, or null."""
    return F.left(F.nullif(F.regexp_extract(_c(c), r"_(\d{8})\.txt$", 1), F.lit("")), F.lit(4)).cast("int")


def filing_cik(c: Column | str) -> Column:
    """The digits in `CIK..._`, or null."""
    return F.nullif(F.regexp_extract(_c(c), r"CIK(\d+)_", 1), F.lit(""))


def years(c: Column | str) -> Column:
    """Years 1900 to 2099 in a text, sorted and distinct."""
    found = F.regexp_extract_all(text(c), F.lit(r"\b(?:19|20)\d\d\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def format_years(c: Column) -> Column:
    """Sorted distinct years joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(c)), lambda y: y.cast("string")), ";")


def year_distance(a: Column, b: Column) -> Column:
    """The least difference between a year of `a` and one of `b`; null if either has none."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))))


def year_audit(found: Column, wanted: Column) -> Column:
    """struct(year_min, year_max, years_available, years_requested, distance, in_year) of a candidate's years against those asked for."""
    have, asked = F.array_sort(F.array_distinct(F.array_compact(found))), F.array_sort(F.array_distinct(F.array_compact(wanted)))
    inside = F.coalesce(F.arrays_overlap(have, asked), F.lit(False))
    return F.struct(
        F.array_min(have).alias("year_min"), F.array_max(have).alias("year_max"), format_years(have).alias("years_available"), format_years(asked).alias("years_requested"),
        F.when(inside, 0).otherwise(year_distance(have, asked)).alias("distance"), inside.alias("in_year"),
    )


def fiscal_year(c: Column | str) -> Column:
    """June to December belong to their year, January to May to the one before."""
    return F.year(_c(c)) - F.when(F.month(_c(c)) > 5, 0).otherwise(1)


def overlaps(start: Column, end: Column, wanted: Column, open_end: int = 2026) -> Column:
    """Whether any wanted year lies between two dates, open ends reaching to the first wanted year and to `open_end`."""
    low = F.coalesce(F.year(start), F.array_min(wanted))
    high = F.coalesce(F.year(end), F.lit(open_end))
    return (
        F.when(F.size(wanted) == 0, "no_residual_years")
        .when(start.isNull() & end.isNull(), "no_dates")
        .when(F.exists(wanted, lambda y: y.between(low, high)), "overlap")
        .otherwise("no_overlap")
    )


def confidence(c: Column | str) -> Column:
    """0 to 1 as a share, over 1 to 10 as tenths, clamped to 0..100; not a number is 0."""
    x = F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0))
    x = F.when(F.isnan(x), 0.0).when(x.between(0, 1), x * 100).when((x > 1) & (x <= 10), x * 10).otherwise(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
