"""Month names, month-start dates and calendar columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import CALENDAR_FEATURES, MONTH_NUMBERS
from panelmill.functions.numbers import month_wave, plain_number
from panelmill.functions.text import clean_text


def month_number(name: Column, full_names_only: bool = False) -> Column:
    """Spanish month name or abbreviation to 1..12, unknown to null."""
    known = {k: v for k, v in MONTH_NUMBERS.items() if len(k) > 3 or not full_names_only}
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    return F.try_element_at(lookup, F.lower(clean_text(name)))


def month_start(year: Column, month: Column) -> Column:
    """First day of the month; a missing, fractional or out-of-range part gives null."""
    number = plain_number(year.cast("string"))
    whole = F.when((number == F.floor(number)) & number.between(1678, 2261), number.cast("int"))
    valid = F.when(month.between(1, 12), month)
    return F.make_date(whole, valid, F.lit(1))


def add_month_date(df: DataFrame, year: str = "ano", month: str = "mes") -> DataFrame:
    return df.withColumn("mes_num", month_number(F.col(month))).withColumn(
        "fecha", month_start(F.col(year), F.col("mes_num"))
    )


def strict_month_date(df: DataFrame, year: str = "año", month: str = "mes") -> DataFrame:
    """As `add_month_date`, but an unreadable month stops the job."""
    dated = add_month_date(df, year, month)
    return dated.withColumn(
        "fecha",
        F.when(F.col("fecha").isNotNull(), F.col("fecha")).otherwise(
            F.raise_error(F.lit("unreadable year or month")).cast("date")
        ),
    )


def stored_date(col: Column, strict: bool = False) -> Column:
    """Date from stored text; bad text gives null, or an error when strict."""
    return F.to_date(col) if strict else F.try_to_date(col)


def shift_months(date: Column, months: Column | int) -> Column:
    return F.add_months(date, months)


def calendar_columns(date: Column) -> dict[str, Column]:
    wave_sin, wave_cos = month_wave(F.month(date))
    return {
        "anio": F.year(date),
        **dict(zip(CALENDAR_FEATURES, (F.month(date), F.quarter(date), wave_sin, wave_cos), strict=True)),
    }


def add_calendar(df: DataFrame, date: str = "fecha") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(date)))
