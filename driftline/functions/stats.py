"""Test statistics by aggregation and windows; p-values from the statistics by small vectorised functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ranks import moments, value_counts, with_before


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction: about the root of max(a, b) steps."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 1000 + int(20 * math.sqrt(max(a, b)))):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def sign_p(k: int, n: int) -> float:
    """Exact two-sided binomial p at one half: a tail of the binomial is an incomplete beta function."""
    tail = min(k, n - k)
    return min(1.0, 2 * incomplete_beta(n - tail, tail + 1, 0.5)) if n else float("nan")


def wilcoxon_p(w: float, n: int, ties: float) -> float:
    """Two-sided p of the signed-rank statistic: exact without ties up to 50, else the tie-corrected normal."""
    if n == 0:
        return float("nan")
    if ties == 0 and n <= 50:
        counts = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(counts) - 1, r - 1, -1):
                counts[s] += counts[s - r]
        low = min(w, n * (n + 1) / 2 - w)
        return min(1.0, 2 * sum(counts[: int(low) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else float("nan")


def robust_vote(p_wilcoxon: Column, p_sign: Column, p_placebo: Column, level: float = 0.05) -> Column:
    """Two of the three tests below the level; where the placebo was run it must be one of them.  A null p is no vote."""
    vote = lambda p: F.coalesce(p < level, F.lit(False)).cast("int")
    enough = vote(p_wilcoxon) + vote(p_sign) + vote(p_placebo) >= 2
    return enough & F.coalesce(p_placebo < level, F.lit(True))


def _ranked(values: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, size (distinct sizes of the values that are not zero), how many of them are positive and negative, tied, and their average rank."""
    count = lambda keep: F.sum(F.when(keep, F.col("n")).otherwise(0))
    sizes = values.where(F.col(x) != 0).groupBy(*by, F.abs(x).alias("_size")).agg(F.sum("n").alias("_tied"), count(F.col(x) > 0).alias("_pos"), count(F.col(x) < 0).alias("_neg"))
    return with_before(sizes, by, "_size", "_tied").withColumn("_rank", F.col("before") + (F.col("_tied") + 1) / 2.0)


def signed_ranks(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, n (non-zero values), w_plus, w_minus with average ranks (null where no value has the sign)."""
    total = lambda count: F.sum(F.when(F.col(count) > 0, F.col("_rank") * F.col(count)))
    return _ranked(value_counts(rows, by, x), by, x).groupBy(*by).agg(F.sum("_tied").alias("n"), total("_pos").alias("w_plus"), total("_neg").alias("w_minus"))


def significance(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Per group: n, mean, t, t_p, wilcoxon_p, sign_p.  Only one row per group reaches the p-value functions."""
    values = value_counts(rows, by, x)
    ties = F.col("_tied") * (F.col("_tied") * F.col("_tied") - 1)
    ranks = _ranked(values, by, x).groupBy(*by).agg(F.sum("_tied").alias("m"), F.sum(F.col("_rank") * F.col("_pos")).alias("w"), F.sum(ties.cast("double")).alias("ties"))
    joined = moments(values, by, x).join(ranks, by, "left").withColumn("t", F.when((F.col("sd") > 0) & (F.col("n") > 1), F.col("mean") / (F.col("sd") / F.sqrt("n"))))

    @F.pandas_udf("double")
    def by_t(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_p(a, b - 1) if a == a else None for a, b in zip(t, n)], dtype="float64")

    @F.pandas_udf("double")
    def by_ranks(w: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p(a, int(b), c) if a == a and b == b else None for a, b, c in zip(w, m, ties)], dtype="float64")

    @F.pandas_udf("double")
    def by_sign(pos: pd.Series, neg: pd.Series) -> pd.Series:
        return pd.Series([sign_p(int(a), int(a + b)) for a, b in zip(pos, neg)], dtype="float64")

    return joined.select(*by, "n", "mean", "t", by_t("t", "n").alias("t_p"), by_ranks("w", "m", "ties").alias("wilcoxon_p"), by_sign("pos", "neg").alias("sign_p"))
