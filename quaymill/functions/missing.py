"""What counts as a missing value: nulls, NaN and the stand-ins people type for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that name nothing, compared after trimming and lower-casing.
NO_NAME = (
    "n/a", "n.a.", "n.a", "na", "nan", "nil", "none", "null", "not available", "not known", "not applicable",
    "missing", "no", "tba", "tbc", "tbd", "undefined", "unassigned", "unk", "unknown", "to be decided",
)
#: No place on earth has more people per square kilometre.
MOST_PER_KM2 = 1_000_000.0
#: No count within 500 m comes near.
MOST_COUNT = 5_000.0


def no_text(c: Column) -> Column:
    """True for null, blank, punctuation only, or a stand-in of ``NO_NAME``, also beside the word "line"; never null."""
    plain = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    name = F.regexp_replace(plain, r"(?U)^line\b\W*|\W*\bline$", "")
    return F.coalesce(~name.rlike(r"[\p{L}\p{N}]") | plain.isin(*NO_NAME) | name.isin(*NO_NAME), F.lit(True))


def no_number(c: Column, most: float, least: float = 0.0) -> Column:
    """True for null, NaN, and for numbers outside ``least`` to ``most``; never null."""
    d = c.cast("double")
    return F.coalesce(F.isnan(d) | (d < least) | (d > most), F.lit(True))


def no_value(c: Column) -> Column:
    """True for null and NaN; never null."""
    d = c.cast("double")
    return d.isNull() | F.isnan(d)  # isnan of null is False
