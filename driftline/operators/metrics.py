"""Performance metrics of daily return series: one aggregation per set of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from driftline.operators.scans import compounded, trailing

YEAR = 252.0


def with_drawdown(series: DataFrame, key: str = "ticker", part: str = "year") -> DataFrame:
    """+ cum (compounded value) and drawdown (below the running peak; null where that is 0), scanned by ranges ``part`` long.

    Rows without a key or date are left out; a missing return is a day without change.
    """
    scanned = compounded(series, [key], "date", 1 + F.col("ret"), part)
    return scanned.withColumn("drawdown", F.try_divide("cum", "peak") - 1).drop("peak")


def performance(series: DataFrame, key: str = "ticker", risk_free: float = 0.025) -> DataFrame:
    """Per series: n, cagr, vol, sharpe, sortino, max_drawdown, calmar, hit_rate.  Missing returns count as zero days."""
    total = F.product(1 + F.coalesce("ret", F.lit(0.0)))
    n, year = F.count(F.lit(1)), F.lit(YEAR)
    facts = with_drawdown(series, key).groupBy(key).agg(
        n.alias("n"),
        F.when(total > 0, F.pow(total, year / n) - 1).alias("cagr"),
        (F.stddev_samp("ret") * F.sqrt(year)).alias("vol"),
        ((F.avg("ret") - risk_free / YEAR) * year).alias("excess"),
        (F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * F.sqrt(year)).alias("downside"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.coalesce(F.col("ret") > 0, F.lit(False)).cast("int")).alias("hit_rate"),
    )
    over = lambda a, b: F.try_divide(F.col(a), F.when(F.col(b) != 0, F.col(b)))
    return facts.select(
        key, "n", "cagr", "vol", over("excess", "vol").alias("sharpe"), over("excess", "downside").alias("sortino"), "max_drawdown",
        (F.col("cagr") / F.abs(F.when(F.col("max_drawdown") != 0, F.col("max_drawdown")))).alias("calmar"), "hit_rate",
    )


def comparison(series: DataFrame, window_of: str, key: str = "series") -> DataFrame:
    """Metrics of several series, + total_return, over the known returns from the first to the last day of the series ``window_of``."""
    known = series.where("ret is not null")
    span = known.where(F.col(key) == window_of).agg(F.min("date").alias("a"), F.max("date").alias("z"))  # one row
    inside = known.join(F.broadcast(span), F.col("date").between(F.col("a"), F.col("z"))).select(key, "date", "ret")
    total = inside.groupBy(key).agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("total_return"))
    return performance(inside, key).join(total, key)


def against_benchmark(series: DataFrame, bench: DataFrame, key: str = "ticker") -> DataFrame:
    """beta, alpha, tracking_error, information_ratio on the days that both have.  bench: date, bench_ret."""
    both = series.join(bench, "date").where("ret is not null and bench_ret is not null")
    diff = F.col("ret") - F.col("bench_ret")
    beta = F.covar_samp("ret", "bench_ret") / F.when(F.var_samp("bench_ret") != 0, F.var_samp("bench_ret"))
    return both.groupBy(key).agg(
        beta.alias("beta"),
        ((F.avg("ret") - beta * F.avg("bench_ret")) * YEAR).alias("alpha"),
        (F.stddev_samp(diff) * F.sqrt(F.lit(YEAR))).alias("tracking_error"),
        (F.avg(diff) * YEAR / F.when(F.stddev_samp(diff) != 0, F.stddev_samp(diff) * F.sqrt(F.lit(YEAR)))).alias("information_ratio"),
    )


def monthly(series: DataFrame, key: str = "ticker") -> DataFrame:
    """key, month, ret: compounded per month, with 0 for empty months between the first and the last."""
    by = series.groupBy(key, F.trunc("date", "MM").alias("month")).agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))
    span = by.groupBy(key).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    axis = span.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return axis.join(by, [key, "month"], "left").fillna(0.0, ["ret"])


def rolling(series: DataFrame, bars: int, key: str = "ticker") -> DataFrame:
    """+ roll_ret (compounded) and roll_sharpe over the last ``bars`` rows; null until there are as many."""

    def over(frame: WindowSpec) -> list[Column]:
        full, spread = F.count("ret").over(frame) == bars, F.stddev_samp("ret").over(frame)
        return [
            F.when(full, F.product(1 + F.col("ret")).over(frame) - 1).alias("roll_ret"),
            F.when(full & (spread > 0), F.avg("ret").over(frame) / spread * F.sqrt(F.lit(YEAR))).alias("roll_sharpe"),
        ]

    return trailing(series, [key], "date", bars, over)
