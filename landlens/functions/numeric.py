"""Numeric rules: safe division, rounding modes, bins, caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,4)"


def safe_divide(a: Column, b: Column, alt: Column | float | None = None) -> Column:
    """a / b, or `alt` where b is zero or either side is missing."""
    out = F.try_divide(a, b)
    if alt is None:
        return out
    return F.coalesce(out, alt if isinstance(alt, Column) else F.lit(alt))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def half_up(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def half_step(x: Column) -> Column:
    """Round to the nearest 0.5, ties to even."""
    return F.bround(x * 2, 0) / 2


def to_long(text: Column) -> Column:
    """Whole number from a text cell; decimals round half-even, bad cells are null."""
    return F.bround(to_double(text), 0).cast("long")


def to_double(text: Column) -> Column:
    """Number from a text cell; a bad cell is null, and so is one that spells no finite number."""
    return finite(text.try_cast("double"))


def finite(x: Column) -> Column:
    """NaN (how some writers spell a missing cell) and infinities become null."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def bin_floor(x: Column, width: float) -> Column:
    """Lower edge of a fixed-width bin, rounding towards minus infinity."""
    return F.floor(x / width) * F.lit(width)


def bin_toward_zero(x: Column, width: float) -> Column:
    """Edge of a fixed-width bin, rounding towards zero."""
    q = x / width
    return F.when(x >= 0, F.floor(q)).otherwise(F.ceil(q)) * F.lit(width)


def guarded_unit_price(total: Column, area: Column) -> Column:
    """total / area: 0 without an area; whole numbers above 100, else one decimal."""
    raw = F.when(area.isNull() | (area == 0), F.lit(0.0)).otherwise(F.try_divide(total.cast("double"), area))
    return F.when(raw > 100, F.bround(raw, 0)).otherwise(F.bround(raw, 1)).cast(MONEY)


def segmented_road(x: Column) -> Column:
    return F.when(x <= 15, half_step(x)).when(x <= 30, F.bround(x, 0)).when(x > 30, F.lit(30.0))


def segmented_frontage(x: Column) -> Column:
    return F.when(x > 20, F.lit(20.0)).when(x >= 10, half_step(x)).otherwise(F.bround(x, 1))


def capped_trend(x: Column) -> Column:
    rounded = F.bround(x, 1)
    return F.when(rounded > 150, 150.0).when(rounded < -50, -50.0).otherwise(rounded)


def depth_ratio(area: Column, frontage: Column) -> Column:
    return F.try_divide(area, frontage * frontage)


def blank_as_zero(x: Column) -> Column:
    """Comparison operand for rules that treat a missing value as zero."""
    return F.coalesce(x.cast("double"), F.lit(0.0))


def exact_mean(x: Column) -> Column:
    """Mean of a decimal column: exact sum first, so task order cannot matter."""
    return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double"))
