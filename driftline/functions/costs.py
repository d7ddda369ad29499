"""Trading cost expressions; the numbers are fixed values of the cost model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIXED_BPS = 5.0 + 5.0 + 10.0 + 0.5 + 0.0
BORROW_BPS_YEAR = 300.0
IMPACT_COEF, IMPACT_POWER = 0.10, 0.5
ROUND_TRIP_BPS, LEAST_ADV = 41.0, 250_000.0


def impact_bps(value: Column, adv: Column) -> Column:
    """Power-law market impact; 0 where value or volume is missing or not positive."""
    good = value.isNotNull() & adv.isNotNull() & (adv > 0) & (F.abs(value) > 0)
    return F.when(good, F.lit(IMPACT_COEF) * F.pow(F.abs(value) / adv, F.lit(IMPACT_POWER)) * 1e4).otherwise(F.lit(0.0))


def trade_cost(value: Column, adv: Column) -> Column:
    return F.abs(value) * (F.lit(FIXED_BPS) + impact_bps(value, adv)) * 1e-4


def borrow_cost(value: Column, days: Column) -> Column:
    """Short borrow over calendar days, at least one."""
    return F.abs(value) * F.lit(BORROW_BPS_YEAR / 252.0 * 1e-4) * F.greatest(days, F.lit(1))


def study_cost_bps(vol: Column, adv: Column, clip: float, days: Column, short: Column) -> Column:
    """Round trip: fixed, borrow for shorts over calendar days, and impact of ``clip`` both ways."""
    volume = F.when(adv > 0, adv).otherwise(F.lit(LEAST_ADV))
    borrow = F.when(short, F.lit(BORROW_BPS_YEAR) * days / 365.0).otherwise(F.lit(0.0))
    return F.lit(ROUND_TRIP_BPS) + borrow + 2 * F.lit(IMPACT_COEF) * vol * F.sqrt(F.lit(clip) / volume) * 1e4
