"""Column expressions for names, seasons and labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import exact_round

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(col) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def clean_name(col) -> Column:
    """Stripped lower-case form; NULL for an empty name."""
    return F.nullif(F.lower(strip(F.col(col) if isinstance(col, str) else col)), F.lit(""))


def season_number(col) -> Column:
    """Integer before the first slash ("2007/08" -> 2007), NULL if there is none."""
    return strip(F.split_part(col.cast("string"), F.lit("/"), F.lit(1))).try_cast("int")


def words(col) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.filter(F.split(col, r"\s+"), lambda w: w != ""))


def percent_label(rate) -> Column:
    """0.4567 -> "45.7%"."""
    return F.format_string("%.1f%%", exact_round(rate * 100, 1))
