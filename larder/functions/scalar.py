"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOTAL = "decimal(28,2)"


def ratio(numerator: Column, denominator: Column, fill: float | None = None) -> Column:
    """Division that yields ``fill`` (null by default) where the divisor is zero or null."""
    value = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return value if fill is None else F.coalesce(value, F.lit(fill))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value but keep null as null (``greatest`` and ``least`` would drop it)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def log_amount(value: Column) -> Column:
    """``log1p`` of a non-negative amount."""
    return F.log1p(clip(value.cast("double"), low=0.0))


def case_id(day: Column, *parts: Column) -> Column:
    """Text key ``date:part:part``."""
    return F.concat_ws(":", day.cast("date").cast("string"), *[p.cast("string") for p in parts])


def finite(value: Column) -> Column:
    """True where a value reads as a number that is neither null, NaN nor infinite."""
    # NaN sorts above infinity, so one comparison covers both.
    return F.coalesce(F.abs(value.try_cast("double")) < F.lit(float("inf")), F.lit(False))


def fractional(value: Column) -> Column:
    """True where a value is not a whole number (or not a number at all)."""
    return F.coalesce(value.try_cast("double") % 1 != 0, F.lit(True))


def known(value: Column, allowed: Iterable) -> Column:
    """Membership in a fixed list; null is not a member."""
    return F.coalesce(value.isin(*allowed), F.lit(False))


def same_text(left: Column, right: Column | str) -> Column:
    """Case-insensitive equality."""
    other = F.lit(right) if isinstance(right, str) else right
    return F.lower(left) == F.lower(other)


def clean_number(value: Column) -> Column:
    """Blank and non-finite text become null, numeric text becomes a number."""
    number = F.nullif(value, F.lit("")).try_cast("double")
    return F.when(finite(number), number)


def clean_text(value: Column) -> Column:
    """The text of a value that is neither blank nor numeric, else null."""
    return F.when((value != "") & value.try_cast("double").isNull(), value)


def band(value: Column, cut: Column | float, names: tuple[str, str, str] = ("LOW", "MEDIUM", "HIGH")) -> Column:
    """Right-closed bands ``(-1, cut/2]``, ``(cut/2, cut]`` and ``(cut, inf)``."""
    limit = F.lit(cut) if isinstance(cut, (int, float)) else cut
    return (
        F.when((value > -1) & (value <= limit * 0.5), names[0])
        .when((value > limit * 0.5) & (value <= limit), names[1])
        .when(value > limit, names[2])
    )


def _halves(value: Column) -> tuple[Column, Column]:
    """A double as the exact sum of two with half the digits each."""
    wide = value * F.lit(134217729.0)
    high = wide - (wide - value)
    return high, value - high


def round_exact(value: Column, digits: int) -> Column:
    """The decimal of ``digits`` places that is nearest to the exact binary value of a double, ties to even.

    ``F.round`` rounds the printed form, so 0.20375, stored just below itself, would go up. Here the product with
    10^digits is known without error: its rounded value and the rest of a two-part multiplication. The rest
    decides where the rounded product looks like a tie. Numbers too large to have such places stay as they are.
    """
    x, scale = value.cast("double"), F.lit(float(10**digits))
    product = x * scale
    (xh, xl), (sh, sl) = _halves(x), _halves(scale)
    rest = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
    nearest = F.rint(product)
    tie = F.abs(product - nearest) == 0.5
    whole = F.when(tie & (rest > 0), product + 0.5).when(tie & (rest < 0), product - 0.5).otherwise(nearest)
    return F.when(F.abs(product) < float(2**52), whole / scale).otherwise(x)


def round_exact_sql(value: str, digits: int) -> str:
    """The same in comparison SQL, by exact printing."""
    return f"CAST(format('{{:.{digits}f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"


def cents(value: Column) -> Column:
    """A computed amount rounded half up to the cent, free of binary noise."""
    return F.round(value.cast("decimal(28,9)"), 2).cast("double")
