"""Numeric parsing and scalar arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelmill.constants import KG_PER_40LB_BOX, STABLE_MULTIPLE

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def plain_number(col: Column) -> Column:
    """Text to double; what is not a number becomes null."""
    return F.when(col.rlike(NUMBER), col.try_cast("double"))


def locale_number(col: Column) -> Column:
    """Text to double after dropping `$` and reading a comma as the decimal point."""
    text = col.cast("string")
    return plain_number(F.replace(F.replace(text, F.lit("$"), F.lit("")), F.lit(","), F.lit(".")))


def box_to_kg(col: Column) -> Column:
    return col / F.lit(KG_PER_40LB_BOX)


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole != 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def weighted_score(total: Column, balance: Column, overlap: Column) -> Column:
    return total + 2 * balance + 25 * overlap


def blend(prediction: Column, lag: Column, weight: Column | float) -> Column:
    """Mix of a prediction with the previous value."""
    share = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.when(share == 0, prediction).otherwise((1 - share) * prediction + share * lag)


def scale(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a constant column keeps unit scale."""
    return (value - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def unscale(value: Column, low: Column, high: Column) -> Column:
    return value * F.when(high == low, F.lit(1.0)).otherwise(high - low) + low


def month_wave(month: Column) -> tuple[Column, Column]:
    """Sine and cosine of the month's place in the year."""
    angle = F.lit(2 * math.pi) * month / 12
    return F.sin(angle), F.cos(angle)


def stable_forecast(forecast: Column, history: Column) -> Column:
    """Array check: finite, not negative, at most five times the largest past value."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    known = F.filter(history, finite)
    ceiling = F.lit(STABLE_MULTIPLE) * F.greatest(F.array_max(F.transform(known, F.abs)), F.lit(1e-6))
    return (
        (F.size(forecast) > 0)
        & F.forall(forecast, lambda x: finite(x) & (x >= 0))
        & ((F.size(known) == 0) | F.forall(forecast, lambda x: x <= ceiling))
    )


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)
