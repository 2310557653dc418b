"""Text expressions shared by the scans, the masks and the tokenisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in Unicode text.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def words(text: Column) -> Column:
    """White-space separated words, none of them empty."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def characters(text: Column) -> Column:
    """One element per character."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def normalize_bundle(text: Column) -> Column:
    """Unify line ends, drop trailing blanks of every line, strip the whole."""
    unified = F.regexp_replace(text, "\r\n|\r", "\n")
    return strip(F.regexp_replace(unified, rf"(?m)(?:(?!\n){SPACE_CLASS})+$", ""))


def clip_text(text: Column, limit: int, marker: str = "\n…(truncated)…") -> Column:
    """Shorten long text and say so; shorter text is unchanged."""
    if limit <= 0:
        return F.lit("")
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit(marker))
    )


def to_finite(text: Column) -> Column:
    """Number from text; junk, NaN and infinities become NULL."""
    value = text.try_cast("double")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def safe_divide(top: Column, bottom: Column) -> Column:
    """Quotient, NULL when either side is NULL or the divisor is 0."""
    return F.when(bottom != 0, top / bottom)


def general_format(value: Column, digits: int = 6) -> Column:
    """Shortest text with that many significant digits, as printf's %g gives."""
    wide = value.cast("double")
    scientific = F.format_string(f"%.{digits - 1}e", wide)
    power = F.substring_index(scientific, "e", -1).cast("int")
    mantissa = F.substring_index(scientific, "e", 1)
    trimmed = F.regexp_replace(mantissa, r"\.?0+$", "")
    trimmed = F.when(mantissa.contains("."), trimmed).otherwise(mantissa)
    exponent = F.substring_index(scientific, "e", -1)
    places = F.lit(digits - 1) - power
    plain = F.call_function(
        "format_string", F.concat(F.lit("%."), places.cast("string"), F.lit("f")), wide
    )
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return (
        F.when(wide == 0, F.lit("0"))
        .when((power < -4) | (power >= digits), F.concat(trimmed, F.lit("e"), exponent))
        .otherwise(plain)
    )
