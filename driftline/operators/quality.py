"""Two-vendor panel validation and reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities in order of weight; unknown names weigh 0.
SEVERITIES = {"none": 0, "low": 1, "medium": 2, "missing": 2, "high": 3}


@dataclass(frozen=True)
class Thresholds:
    """Percent differences for low, medium, high; run length of a stale price; percent of a suspicious jump."""

    price: tuple[float, float, float] = (0.5, 2.0, 5.0)
    volume: tuple[float, float, float] = (10.0, 25.0, 50.0)
    stale: int = 5
    jump: float = 25.0


def percent_difference(a: Column, b: Column) -> Column:
    """Of the larger magnitude; null where it is not positive."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(most > 0, 100 * F.abs(a - b) / most)


def severity(diff: Column, levels: tuple[float, float, float]) -> Column:
    low, medium, high = levels
    return F.when(diff.isNull(), "missing").when(diff >= high, "high").when(diff >= medium, "medium").when(diff >= low, "low").otherwise("none")


def weight(name: Column) -> Column:
    out = F.lit(0)
    for key, value in SEVERITIES.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out


def compare_vendors(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Full outer join on (ticker, date): ``field_a``, ``field_b``, in_a, in_b; one shuffle for all checks that follow."""
    left = a.select("ticker", "date", F.lit(True).alias("in_a"), *[F.col(f).alias(f"{f}_a") for f in fields])
    right = b.select("ticker", "date", F.lit(True).alias("in_b"), *[F.col(f).alias(f"{f}_b") for f in fields])
    return left.join(right, ["ticker", "date"], "full").fillna(False, ["in_a", "in_b"])


def reconcile(a: DataFrame, b: DataFrame, thresholds: Thresholds = Thresholds(), prefer_close: str = "a", prefer_adjusted: str = "b", prefer_volume: str = "a", drop_at: str = "high") -> DataFrame:
    """One row per (ticker, date) with chosen values, their sources and reasons, severities, notes and the drop flag."""
    fields = ["open", "high", "low", "close", "adjusted_close", "volume"]
    both = compare_vendors(a, b, fields)

    def choose(field: str, prefer: str):
        other = "b" if prefer == "a" else "a"
        first, second = F.col(f"{field}_{prefer}"), F.col(f"{field}_{other}")
        source = F.when(first.isNotNull(), prefer).when(second.isNotNull(), other)
        reason = F.when(first.isNotNull(), "preferred").when(second.isNotNull(), "fallback").otherwise("missing")
        return F.coalesce(first, second), source, reason

    close, close_source, close_reason = choose("close", prefer_close)
    adjusted, adjusted_source, _ = choose("adjusted_close", prefer_adjusted)
    volume, volume_source, volume_reason = choose("volume", prefer_volume)
    side = F.coalesce(close_source, F.lit(prefer_close))
    follow = lambda f: F.when(side == "a", F.col(f"{f}_a")).otherwise(F.col(f"{f}_b"))
    close_sev = severity(percent_difference(F.col("close_a"), F.col("close_b")), thresholds.price)
    adjusted_sev = severity(percent_difference(F.col("adjusted_close_a"), F.col("adjusted_close_b")), thresholds.price)
    price_sev = F.when(weight(adjusted_sev) > weight(close_sev), adjusted_sev).otherwise(close_sev)
    volume_sev = severity(percent_difference(F.col("volume_a"), F.col("volume_b")), thresholds.volume)
    out = both.select(
        "ticker", "date", *[follow(f).alias(f) for f in ("open", "high", "low")],
        close.alias("close"), adjusted.alias("adjusted_close"), volume.alias("volume"),
        close_source.alias("close_source"), adjusted_source.alias("adjusted_source"), volume_source.alias("volume_source"),
        price_sev.alias("price_severity"), volume_sev.alias("volume_severity"), close_reason.alias("cr"), volume_reason.alias("vr"),
    )
    limit = SEVERITIES[drop_at]
    return out.withColumns(
        {
            "notes": F.concat(F.lit("close:"), "cr", F.lit("; volume:"), "vr", F.lit("; price_sev:"), "price_severity", F.lit("; volume_sev:"), "volume_severity"),
            "drop": (weight(F.col("price_severity")) >= limit) | (weight(F.col("volume_severity")) >= limit),
        }
    ).drop("cr", "vr")


def missing_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ticker, date, missing_from) for rows that only one vendor has."""
    both = compare_vendors(a, b, [])
    return both.where("in_a <> in_b").select("ticker", "date", F.when(F.col("in_a"), "b").otherwise("a").alias("missing_from"))


def ratio_mismatches(a: DataFrame, b: DataFrame, most: float = 0.01) -> DataFrame:
    """Rows where the vendors' adjusted / close ratios differ by more than ``most``."""
    both = compare_vendors(a, b, ["close", "adjusted_close"]).where("in_a and in_b")
    ratio = lambda s: F.try_divide(F.col(f"adjusted_close_{s}"), F.col(f"close_{s}"))
    return both.select("ticker", "date", F.abs(ratio("a") - ratio("b")).alias("ratio_diff")).where(F.col("ratio_diff") > most)


def stale_runs(bars: DataFrame, price: str = "close", least: int = 5) -> DataFrame:
    """Rows in runs of at least ``least`` equal prices: ticker, date, price, stale_run (position in the run, from 1)."""
    by = Window.partitionBy("ticker").orderBy("date")
    changed = F.coalesce((F.col(price) != F.lag(price).over(by)).cast("int"), F.lit(1))
    islands = bars.select("ticker", "date", price).withColumn("changed", changed).withColumn("island", F.sum("changed").over(by))
    run = islands.withColumn("stale_run", F.row_number().over(Window.partitionBy("ticker", "island").orderBy("date")))
    return run.where((F.col("stale_run") >= least) & F.col(price).isNotNull()).select("ticker", "date", price, "stale_run")


def jumps(bars: DataFrame, price: str = "close", least: float = 25.0) -> DataFrame:
    """Rows whose simple return is at least ``least`` percent either way."""
    ret = F.try_divide(F.col(price), F.lag(price).over(Window.partitionBy("ticker").orderBy("date"))) - 1
    return bars.select("ticker", "date", (ret * 100).alias("jump_pct")).where(F.abs("jump_pct") >= least)


def quality_report(a: DataFrame, b: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """check, severity, n: price, volume, missing, ratio, stale and jump findings in one table."""
    both = compare_vendors(a, b, ["close", "adjusted_close", "volume"])
    graded = both.select(
        F.explode(
            F.array(
                F.struct(F.lit("close").alias("check"), severity(percent_difference(F.col("close_a"), F.col("close_b")), thresholds.price).alias("severity")),
                F.struct(F.lit("adjusted_close").alias("check"), severity(percent_difference(F.col("adjusted_close_a"), F.col("adjusted_close_b")), thresholds.price).alias("severity")),
                F.struct(F.lit("volume").alias("check"), severity(percent_difference(F.col("volume_a"), F.col("volume_b")), thresholds.volume).alias("severity")),
            )
        ).alias("g")
    ).select("g.*").where("severity <> 'none'")
    one = lambda df, check, level: df.select(F.lit(check).alias("check"), F.lit(level).alias("severity"))
    parts = [
        missing_sides(a, b).select(F.lit("missing").alias("check"), F.col("missing_from").alias("severity")),
        one(ratio_mismatches(a, b), "ratio", "high"), one(stale_runs(a, least=thresholds.stale), "stale", "medium"), one(jumps(a, least=thresholds.jump), "jump", "high"),
    ]
    out = graded
    for p in parts:
        out = out.unionByName(p)
    return out.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"))
