"""Calendar attributes of a date column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import date_key


def calendar_columns(d: Column) -> list[Column]:
    iso_day = (F.weekday(d) + 1).cast("int")
    return [
        date_key(d).alias("calendarDateKey"),
        d.alias("calendarDate"),
        F.year(d).alias("calendarYear"),
        F.quarter(d).alias("calendarQuarter"),
        F.month(d).alias("calendarMonth"),
        F.date_format(d, "MMMM").alias("calendarMonthName"),
        F.month(d).alias("calendarMonthNumber"),
        F.dayofmonth(d).alias("calendarDayOfMonth"),
        iso_day.alias("calendarDayOfWeek"),
        F.date_format(d, "EEEE").alias("calendarDayName"),
        (iso_day >= 6).alias("isWeekend"),
        F.date_format(d, "yyyy-MM").alias("yearMonth"),
        F.trunc(d, "month").alias("monthStartDate"),
        F.last_day(d).alias("monthEndDate"),
    ]
