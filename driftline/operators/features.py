"""Size, liquidity, return and rank features of a panel, as of given dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.calendar import bday_add
from driftline.operators.asof import asof_backward
from driftline.operators.ranks import row_numbers
from driftline.sources.files import written


def lookback(panel: DataFrame, asof: Column, weekdays: int) -> DataFrame:
    """Rows from ``weekdays`` business days before ``asof`` up to it, both included; nothing after it is seen."""
    return panel.where(F.col("date").between(bday_add(asof, -weekdays), asof))


def value_traded(panel: DataFrame, asof: Column, weekdays: int, exact_median: bool = True) -> DataFrame:
    """ticker -> median (or mean) daily value traded in the lookback."""
    value = F.col("close") * F.col("volume")
    agg = F.median(value).alias("mdvt") if exact_median else F.avg(value).alias("adv")
    return lookback(panel, asof, weekdays).groupBy("ticker").agg(agg)


def with_market_cap(panel: DataFrame, shares: DataFrame, factors: DataFrame) -> DataFrame:
    """panel + shares and float factor as of each date (factor 1.0 where there is none), market_cap, float_cap."""
    sized = asof_backward(panel, shares, ["ticker"], "date", "date", ["shares"]).drop("date_found")
    floated = asof_backward(sized, factors, ["ticker"], "date", "date", ["iwf"]).drop("date_found").withColumn("iwf", F.coalesce("iwf", F.lit(1.0)))
    return floated.withColumn("market_cap", F.col("close") * F.col("shares")).withColumn("float_cap", F.col("market_cap") * F.col("iwf"))


def passive_flow(events: DataFrame, money: dict[str, float], index_col: str = "index") -> DataFrame:
    """events (weight, prior) + money (that follows the index, null for others), weight_change and flow; a null weight is 0."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in money.items() for x in pair]), F.col(index_col))
    change = F.coalesce("weight", F.lit(0.0)) - F.coalesce("prior", F.lit(0.0))
    return events.withColumns({"money": known, "weight_change": change, "flow": change * known})


def returns(panel: DataFrame, price: str = "adjusted_close", key: str = "ticker") -> DataFrame:
    """panel + ret: simple return on the previous known price of the key."""
    known = F.last(price, ignorenulls=True).over(Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    padded = panel.withColumn("_known", known)
    return padded.withColumn("ret", F.try_divide(F.col("_known"), F.lag("_known").over(Window.partitionBy(key).orderBy("date"))) - 1).drop("_known")


def trailing_returns(panel: DataFrame, asof: Column, bars: tuple[int, ...], price: str = "adjusted_close") -> DataFrame:
    """ticker, ret_n for each n: last price at or before ``asof`` over the one n bars earlier; null with too few bars."""
    back = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    numbered = panel.where(F.col("date") <= asof).withColumn("back", F.row_number().over(back) - 1)
    at = lambda n: F.max(F.when(F.col("back") == n, F.col(price)))
    return numbered.groupBy("ticker").agg(*[(F.try_divide(at(0), at(n)) - 1).alias(f"ret_{n}") for n in bars])


def trailing_volatility(panel: DataFrame, asof: Column, bars: int) -> DataFrame:
    """ticker, vol: annualised deviation of the last ``bars`` returns; null with fewer than half of them."""
    back = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    recent = returns(panel.where(F.col("date") <= asof)).withColumn("back", F.row_number().over(back)).where(F.col("back") <= bars)
    return recent.groupBy("ticker").agg(F.when(F.count(F.lit(1)) >= bars // 2, F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol"))


def rank_universe(features: DataFrame, by: list[str], size: str = "avg_fmc", tie: str = "mdvt") -> DataFrame:
    """+ fmc_rank within ``by``: size, then tie descending (nulls last), then ticker (one row each), by ranges of the whole order."""
    order = [F.col(size).desc_nulls_last(), F.col(tie).desc_nulls_last(), F.col("ticker").asc()]
    return row_numbers(features, by, order, "fmc_rank").withColumn("fmc_rank", F.col("fmc_rank").cast("int"))


def gap_to_cutoff(ranked: DataFrame, by: list[str], target: int, size: str = "avg_fmc") -> DataFrame:
    """+ gap: size less that of the target-th largest in ``by`` (the smallest, if there are fewer)."""
    whole = Window.partitionBy(*by)
    cutoff = F.coalesce(F.max(F.when(F.col("fmc_rank") == target, F.col(size))).over(whole), F.min(size).over(whole))
    return ranked.withColumn("gap", F.col(size) - cutoff)


def terciles(rows: DataFrame, x: str) -> DataFrame:
    """+ bucket: low up to the first third of x, mid up to the second, else high.

    Rows are written once: cuts fall on values themselves, and a sum of floats that is taken a second time may differ in its last bit.
    """
    known = written(rows, "terciles")
    cuts = known.agg(F.percentile(x, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_cuts"))  # one row
    bucket = F.when(F.col(x) <= F.col("_cuts")[0], "low").when(F.col(x) <= F.col("_cuts")[1], "mid").otherwise("high")
    return known.crossJoin(F.broadcast(cuts)).withColumn("bucket", bucket).drop("_cuts")


def min_max(column: str, by: list[str]) -> Column:
    """Scaled to [0, 1] within ``by``; nulls take the median; 0.5 where all are equal."""
    whole = Window.partitionBy(*by)
    filled = F.coalesce(F.col(column), F.median(column).over(whole))
    low, high = F.min(column).over(whole), F.max(column).over(whole)
    return F.when(high > low, (filled - low) / (high - low)).otherwise(F.lit(0.5))
