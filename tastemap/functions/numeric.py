"""Rounding and number formatting for results and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import MISSING_SCORE_TEXT, SCORE_DIGITS

# Results compared against the SQL oracle are rounded to this many places.
RESULT_DIGITS = 6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x, digits: int) -> Column:
    """Half away from zero on the binary value: ``sign(x) * floor(|x| * 10^d + 0.5) / 10^d``.

    Built from IEEE operations only, so any SQL engine reproduces it digit for
    digit (plain ``round`` differs between engines at exact halves, Q9).
    """
    x = _c(x)
    p = 10.0 ** digits
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p


def result_round(x) -> Column:
    return round_half_up(x, RESULT_DIGITS)


def score_text(x, digits: int = SCORE_DIGITS, missing: str = MISSING_SCORE_TEXT) -> Column:
    """Fixed-point text of a score, or ``missing`` when null.

    ``format_string`` prints a null argument as text, so nulls are tested first.
    """
    x = _c(x)
    return F.when(x.isNull(), F.lit(missing)).otherwise(
        F.format_string(f"%.{digits}f", round_half_up(x, digits)))
