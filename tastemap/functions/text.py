"""Text column functions for search and request parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Strip leading and trailing white space of any kind, like Python's ``str.strip``."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def fold(x) -> Column:
    """Case fold for matching: Unicode lower case (Q12)."""
    return F.lower(_c(x))


# Fixed value: the integer text a request may carry, as Python's int() reads it:
# optional blanks and sign, digits, single underscores between digits.
INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def parse_int(x) -> Column:
    """Lenient integer parse: the integer, or null when the text is no integer
    or one that a long can't hold."""
    x = _c(x)
    digits = F.regexp_replace(F.regexp_replace(x, r"\s", ""), "_", "")
    return F.when(x.rlike(INT_TEXT), digits.try_cast("long"))


def grams(x, size: int) -> Column:
    """All substrings of ``size`` characters, as an array (empty when shorter).

    One regex pass with a look-ahead group yields every overlapping gram; no
    lambda captures the text (that would redo the text's expression per gram).
    """
    return F.regexp_extract_all(_c(x), F.lit(f"(?s)(?=(.{{{size}}}))"), 1)
