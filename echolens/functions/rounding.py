"""Rounding as the reference does it.

Two rules exist there and they differ from Spark's ``round``. ``half_up`` scales, adds one half and floors in
double arithmetic. ``fixed`` rounds the exact binary value of the double, so 1.005 to two places is 1.00.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    scale = 10**digits
    nearest = F.floor(x * scale + F.lit(0.5))
    return nearest if digits == 0 else nearest / F.lit(float(scale))


def _nearest_exact(x: Column, digits: int) -> Column:
    """Whole number n with n/10^digits nearest to the exact value of x, the larger one on a tie."""
    scale = 10**digits
    guess = F.floor(x * scale + F.lit(0.5))
    # The float part has 24 significant bits and the rest at most 29, so both products below are exact and
    # the sum tells on which side of the tie the exact value lies.
    coarse = x.cast("float").cast("double")
    fine = x - coarse
    side = (coarse * (2.0 * scale) - (guess * 2 - 1)) + fine * (2.0 * scale)
    return F.when(side < 0, guess - 1).when(side >= 2, guess + 1).otherwise(guess)


def fixed(x: Column, digits: int) -> Column:
    return _nearest_exact(x, digits) / F.lit(float(10**digits))


def fixed_text(x: Column, digits: int) -> Column:
    if digits == 0:
        return _nearest_exact(x, 0).cast("string")
    return F.format_string(f"%.{digits}f", fixed(x, digits))
