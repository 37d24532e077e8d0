"""Column expressions: rounding, dates, numbers in text, labels, rules. All run inside code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounding with ties to the even digit."""
    return F.bround(c, digits)


def weekday(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def month_of(text: Column) -> Column:
    """'Apr-23' as the first of the month, years 69 to 99 in the last century; null for anything else."""
    d = F.to_date(F.try_to_timestamp(F.initcap(F.trim(text)), F.lit("MMM-yy")))
    return F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)


def number_in(text: Column) -> Column:
    """The number in a text with digit groups (also by twos), blanks, units or signs around; null if there is none."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def band_number(text: Column) -> Column:
    """'very low' ... 'very high' as 0 to 4; null for other texts."""
    names = ("very low", "low", "medium", "high", "very high")
    m = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    return m[F.lower(F.trim(text))]


def hour_label(h: Column) -> Column:
    return F.format_string("%02d:00", h)


def padded(c: Column, n: int = 2) -> Column:
    return F.lpad(c, n, "0")


def words_of_camel(c: Column) -> Column:
    """'noOfCashTickets' as 'Cash Tickets'."""
    return F.regexp_replace(F.regexp_replace(c, "^noOf", ""), "([a-z])([A-Z])", "$1 $2")


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def stem(name: Column) -> Column:
    """A name without its last ordinal and then without its last role word."""
    bare = F.regexp_replace(name, r"\s+(?:I{1,3}|IV|V|\d+)\s*$", "")
    return F.trim(F.regexp_replace(bare, r"(?i)\s+(?:depot|market|north|south|east|west|inner|outer|bus stand|junction)\s*$", ""))


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where ``b`` is 0."""
    return F.try_divide(a, b)


def clipped(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Within ``lo`` and ``hi``; null stays null."""
    c = F.when(c.isNotNull(), F.greatest(c, F.lit(lo))) if lo is not None else c
    return F.when(c.isNotNull(), F.least(c, F.lit(hi))) if hi is not None else c


def finite(c: Column) -> Column:
    """Null in place of NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def interpolated(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear between two points, constant beyond."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - x0) / (x1 - x0)))
    return F.lit(y0) + t * (y1 - y0)


def tier(c: Column, bounds: Iterable[float], labels: Iterable[str]) -> Column:
    """The label of the first bound above ``c``; the last label beyond all bounds."""
    *steps, last = labels
    out = F.lit(last)
    for b, name in reversed(list(zip(bounds, steps))):
        out = F.when(c < b, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def quadrant(a: Column, b: Column, a_mid: Column, b_mid: Column) -> Column:
    """Which side of two medians; the median itself is high."""
    hi_a, hi_b = a >= a_mid, b >= b_mid
    name = F.when(hi_a & hi_b, "high_high").when(hi_a, "high_low").when(hi_b, "low_high").otherwise("low_low")
    return F.when(a.isNotNull() & b.isNotNull(), name)


def mapped(c: Column, names: dict[str, str], default: Column) -> Column:
    """``names[c]``, else ``default``."""
    m = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(m[c], default)


def first_rule(c: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The label of the first pattern found in ``c``; else ``default``, or ``c`` itself."""
    out = c if default is None else default
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(pattern), label).otherwise(out)
    return out


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Any of the words, as they stand, ignoring case; null is False."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


#: Land-use groups in the order in which their words are looked for. Fixed values.
LAND_USE = {
    "Built-up": ["built"],
    "Agriculture": ["agriculture", "crop", "fallow"],
    "Forest/Scrub": ["forest", "scrub"],
    "Water/Wetland": ["wetland", "water", "river", "lake"],
    "Barren/Open": ["barren", "waste", "sandy"],
}


def land_use(c: Column, open_by_default: bool = False) -> Column:
    """The group of a land-use description. What fits none, and null, is 'Other', or if ``open_by_default`` 'Barren/Open'."""
    out = F.lit("Barren/Open" if open_by_default else "Other")
    for group, words in reversed(LAND_USE.items()):
        out = F.when(contains_any(c, words), group).otherwise(out)
    return out


def tags_of(c: Column) -> Column:
    """``"k"=>"v","k2"=>"v2"`` as a map; quotes inside are escaped by a backslash. Null gives an empty map."""
    pairs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'"((?:[^"\\]|\\.)*)"\s*=>\s*"((?:[^"\\]|\\.)*)"'), F.lit(0))
    part = lambda x, i: F.regexp_replace(F.regexp_extract(x, r'^"((?:[^"\\]|\\.)*)"\s*=>\s*"((?:[^"\\]|\\.)*)"$', i), r"\\(.)", "$1")
    entries = F.transform(pairs, lambda x: F.struct(part(x, 1).alias("key"), part(x, 2).alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    # of a repeated key the first entry stays
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def has_tag(tags: Column, key: str, values: Iterable[str] | None = None) -> Column:
    """The tag is there, with one of ``values`` if given; never null."""
    v = tags[key]
    return F.coalesce(v.isin(*values) if values else v.isNotNull(), F.lit(False))
