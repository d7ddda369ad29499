"""Business-day arithmetic on a Monday-to-Friday calendar, and rebalance dates, as closed-form expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rebalance calendar: months, week of the announcement and of the effective Friday, weeks from reference to announcement.
MONTHS, ANNOUNCE_WEEK, EFFECTIVE_WEEK, REFERENCE_WEEKS = (3, 6, 9, 12), 1, 3, 2


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def bday_add(d: Column, n: int) -> Column:
    """``d`` moved by ``n`` weekdays; a weekend day counts as the Friday before (n > 0) or the Monday after (n <= 0)."""
    w = F.weekday(d)
    if n > 0:
        base, day = F.date_sub(d, w), F.least(w, F.lit(4))
    else:
        weekend = w > 4
        base = F.when(weekend, F.date_add(F.date_sub(d, w), 7)).otherwise(F.date_sub(d, w))
        day = F.when(weekend, F.lit(0)).otherwise(w)
    steps = day + F.lit(n)
    return F.date_add(base, (F.floor(steps / 5) * 7 + F.pmod(steps, F.lit(5))).cast("int"))


def weekdays_between(first: Column, last: Column) -> Column:
    """Array of the weekdays from ``first`` to ``last``, both included; empty if last is before first."""
    days = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def nth_weekday(month: Column, name: str, n: int) -> Column:
    """The n-th weekday called ``name`` ('FRI') of the month that the date ``month`` lies in."""
    if n < 1:
        raise ValueError("n starts at 1")
    return F.date_add(F.next_day(F.date_sub(F.trunc(month, "MM"), 1), name), 7 * (n - 1))


def rebalance_months(frequency: str) -> tuple[int, ...]:
    """Months of the calendar: all of MONTHS, its first and third, or its second."""
    known = {"quarterly": MONTHS, "semi-annual": (MONTHS[0], MONTHS[2]), "annual": (MONTHS[1],)}
    if frequency not in known:
        raise ValueError(f"unknown rebalance frequency {frequency}")
    return known[frequency]


def index_windows(spark: SparkSession, index: str, frequencies: dict[str, str], start: str, end: str) -> DataFrame:
    """``rebalance_calendar`` of one of the indices that ``frequencies`` names; others are refused."""
    if index not in frequencies:
        raise ValueError(f"{index} is not one of {sorted(frequencies)}")
    return rebalance_calendar(spark, start, end, rebalance_months(frequencies[index]))


def rebalance_calendar(spark: SparkSession, start: str, end: str, months: tuple[int, ...] = MONTHS) -> DataFrame:
    """month, announcement, effective, reference for every rebalance month whose effective date is in [start, end]."""
    return calendar_between(spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b")), months)


def calendar_between(bounds: DataFrame, months: tuple[int, ...] = MONTHS) -> DataFrame:
    """``rebalance_calendar`` between the dates a and b of each row, as a table's own first and last days; null dates give nothing."""
    every = bounds.select("a", "b", F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("month"))
    return (
        every.where(F.month("month").isin(*months))
        .select(
            "month",
            nth_weekday(F.col("month"), "FRI", ANNOUNCE_WEEK).alias("announcement"),
            nth_weekday(F.col("month"), "FRI", EFFECTIVE_WEEK).alias("effective"),
            F.date_sub(nth_weekday(F.col("month"), "FRI", ANNOUNCE_WEEK), 7 * REFERENCE_WEEKS).alias("reference"),
            "a", "b",
        )
        .where("effective between a and b").drop("a", "b")
    )
