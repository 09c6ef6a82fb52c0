"""Calendar periods and exact per-period statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("week", "month", "year")


def period_start(day: Column, period: str) -> Column:
    return F.date_trunc(period, day).cast("date")


def period_end(day: Column, period: str) -> Column:
    start = period_start(day, period)
    return {"week": F.date_add(start, 6), "month": F.last_day(start), "year": F.make_date(F.year(start), F.lit(12), F.lit(31))}[period]


def period_label(day: Column, period: str) -> Column:
    """'2026-W53' by ISO year and week, '2026-07', '2026'."""
    if period == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return F.date_format(day, {"month": "yyyy-MM", "year": "yyyy"}[period])


def per_period(bars: DataFrame, day: str, value: str, period: str, method: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean or exact median of the values that are not null, and the count of rows, per period.

    Periods without a value have a null statistic; an empty input gives no row.
    The mean is taken over decimals of two places, so it is the same whatever
    the order of the rows. One shuffle of partial aggregates.
    """
    d = F.col(day).cast("date")
    cents = F.col(value).cast("decimal(18,2)")
    stat = {"avg": F.sum(cents).cast("double") / F.count(value), "median": F.median(F.col(value))}[method]
    return (
        bars.where(d.isNotNull())
        .groupBy(*keys, period_label(d, period).alias("period"), period_start(d, period).alias("period_start"), period_end(d, period).alias("period_end"))
        .agg(F.when(F.count(value) > 0, stat).alias("value") if method == "avg" else stat.alias("value"), F.count(F.lit(1)).alias("n"))
    )
