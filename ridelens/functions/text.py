"""Text cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelens.schema import MISSING_TOKENS

# Every character that counts as white space in Unicode text, the ASCII
# separators \x1c-\x1f included.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A run of two or more, or a single one that is not a plain space.
_COLLAPSIBLE = f"[{WHITESPACE}]{{2,}}|[{WHITESPACE[1:]}]"
_UNPRINTABLE = "[^ -~]"
_DOUBLE, _SINGLE = '"', "'"


# Trimming by a wide set and replacing by a regular expression cost microseconds per value
# and almost no value needs them. ``needs_full_clean`` is one scan; asked once per row over
# all its columns it lets ordinary rows take the short way.


def has_rare_space(col: Column) -> Column:
    """Any character but the printable ones of ASCII, so every white space but a plain one."""
    return col.rlike(_UNPRINTABLE)


def needs_full_clean(*cols: Column) -> Column:
    """Whether any of the texts may hold more than edge spaces and quotes."""
    row = F.concat_ws("|", *cols)
    return has_rare_space(row) | row.contains("  ")


def _unquote(stripped: Column) -> Column:
    return F.btrim(F.btrim(stripped, F.lit(_DOUBLE)), F.lit(_SINGLE))


def _trim_unquote(col: Column) -> Column:
    # Trimming by a stated set lists all characters of a value first; few hold a quote.
    quoted = col.contains(_DOUBLE) | col.contains(_SINGLE)
    return F.when(quoted, _unquote(F.trim(col))).otherwise(F.trim(col))


def strip_space(col: Column) -> Column:
    """Strip white space of any kind from both ends (``trim`` takes only spaces)."""
    return F.btrim(col, F.lit(WHITESPACE))


def strip_quotes(col: Column, full: Column | None = None) -> Column:
    """Strip white space, then runs of double quotes, then runs of single quotes."""
    full = has_rare_space(col) if full is None else full
    return F.when(full, _unquote(strip_space(col))).otherwise(_trim_unquote(col))


def clean_text(col: Column, full: Column | None = None) -> Column:
    """``strip_quotes`` and inner white space collapsed to single spaces.

    Padding found inside the quotes is collapsed, not stripped again. ``full``
    says whether the long way is needed; by default the value itself is asked.
    """
    full = needs_full_clean(col) if full is None else full
    collapsed = F.regexp_replace(_unquote(strip_space(col)), _COLLAPSIBLE, " ")
    return F.when(full, collapsed).otherwise(_trim_unquote(col))


def missing_to_null(col: Column, then: Column | None = None) -> Column:
    """NULL for every spelling of "no value", else ``then`` (by default the text itself)."""
    return F.when(~col.isin(MISSING_TOKENS), col if then is None else then)


def is_nonblank(stripped: Column, also: tuple[str, ...] = ()) -> Column:
    """True where a stripped text is present, not empty and not the word "nan"."""
    known = stripped.isNotNull() & ~F.lower(stripped).isin("", "nan")
    return known & ~stripped.isin(list(also)) if also else known


def route_label(pickup: str = "Pickup Location", drop: str = "Drop Location") -> Column:
    """``pickup → drop``; NULL if either side is."""
    return F.concat(F.col(pickup), F.lit(" → "), F.col(drop))
