"""Scans over long series that no single task sorts whole: each key's rows are cut into ranges of time.

A range (a calendar year) is summed up in one row; what comes before it is carried in by a window over those rows only, of
which a key has as many as years.  Inside a range a window does the rest.  Both joins and windows share one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftline.sources.files import written

RANGE = "_range"
BLOCK = 4096


def _with_parts(rows: DataFrame, keys: list[str], at: str, parts: list[Column], carried: list[Column]) -> DataFrame:
    """rows + RANGE + what is ``carried`` in from earlier ranges, from ``parts`` (aggregates of a range)."""
    dealt = rows.withColumn(RANGE, F.year(at))
    return dealt.join(dealt.groupBy(*keys, RANGE).agg(*parts).select(*keys, RANGE, *carried), [*keys, RANGE])


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, keys: list[str], at: str, previous: list[str] = (), bar_no: str = "bar_no", last_no: str = "last_no") -> DataFrame:
    """rows + number from 1 in the order of ``at``, the number of the key's last row, and for each column c of ``previous`` prev_c, its value one row before.

    A key has one row a time; null keys and times are left out.
    """
    kept = rows.dropna(subset=[*keys, at])
    parts = [F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(F.lit(0).alias("_"), *previous), at).alias("_last")]
    carried = [
        F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(*keys)).alias(last_no),
        F.lag("_last").over(Window.partitionBy(*keys).orderBy(RANGE)).alias("_last"),
    ]
    inside = Window.partitionBy(*keys, RANGE).orderBy(at)
    found = _with_parts(kept, keys, at, parts, carried).withColumn("_no", F.row_number().over(inside))
    before = [F.when(F.col("_no") == 1, F.col(f"_last.{c}")).otherwise(F.lag(c).over(inside)).alias(f"prev_{c}") for c in previous]
    return found.select(*rows.columns, (F.col("_start") + F.col("_no")).alias(bar_no), last_no, *before)


def running_sums(rows: DataFrame, keys: list[str], at: str, names: list[str]) -> DataFrame:
    """rows + run_c for each column c of ``names``: the sum of c over the key's rows up to and including the same ``at``; nulls add nothing."""
    kept = rows.dropna(subset=[*keys, at])
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = [F.sum(c).alias(f"_s_{c}") for c in names]
    carried = [zero(F.sum(f"_s_{c}").over(_before(keys))).alias(f"_b_{c}") for c in names]
    inside = Window.partitionBy(*keys, RANGE).orderBy(at)
    found = _with_parts(kept, keys, at, parts, carried)
    return found.select(*rows.columns, *[(F.col(f"_b_{c}") + zero(F.sum(c).over(inside))).alias(f"run_{c}") for c in names])


def trailing(rows: DataFrame, keys: list[str], at: str, bars: int, over: Callable[[WindowSpec], list[Column]], block: int = BLOCK) -> DataFrame:
    """rows + the columns that ``over`` gives for a frame of the last ``bars`` rows of the key, the row itself included.

    Rows are numbered and cut into blocks of ``block`` rows (``bars - 1`` if that is more); a block also gets the ``bars - 1`` rows
    before it as copies, which are dropped when its frames have been read.  So a task sorts a block and its border, whatever the key
    has, and every frame holds the same rows as one over the whole series.  Null keys and times are left out.
    """
    long = max(block, bars - 1, 1)
    at_row = F.col("_no") - 1
    own = F.floor(at_row / long)
    border = F.when(at_row % long >= long - (bars - 1), F.array(own, own + 1)).otherwise(F.array(own))
    kept = written(rows.dropna(subset=[*keys, at]), "trailing")  # read twice for the numbers
    dealt = numbered(kept, keys, at, bar_no="_no", last_no="_last_no").select(*rows.columns, "_no", own.alias("_own"), F.explode(border).alias("_block"))
    frame = Window.partitionBy(*keys, "_block").orderBy("_no").rowsBetween(-(bars - 1), Window.currentRow)
    return dealt.select("*", *over(frame)).where("_block = _own").drop("_no", "_own", "_block")


def compounded(rows: DataFrame, keys: list[str], at: str, factor: Column, part: str = "year") -> DataFrame:
    """rows + cum (product of the key's factors up to the row) and peak (the highest cum up to the row).

    A range of time, ``part`` long ('year', 'month', ...), is three numbers: its product, its highest and its lowest prefix.  Products of
    earlier ranges are carried in, and so is their peak, which is product times the highest prefix, or the lowest
    where the product is negative.  No task sorts more than a range.  Null keys and times are left out; a null factor counts as 1.
    """
    inside = Window.partitionBy(*keys, RANGE).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = rows.dropna(subset=[*keys, at]).withColumn(RANGE, F.date_trunc(part, at))
    prefixed = dealt.withColumn("_prefix", F.product(F.coalesce(factor, F.lit(1.0))).over(inside)).withColumn("_no", F.row_number().over(inside))
    ranges = prefixed.groupBy(*keys, RANGE).agg(F.max_by("_prefix", "_no").alias("_whole"), F.max("_prefix").alias("_high"), F.min("_prefix").alias("_low"))
    before = F.coalesce(F.product("_whole").over(_before(keys)), F.lit(1.0))
    ranges = ranges.withColumn("_start", before).withColumn("_top", F.greatest(F.col("_start") * F.col("_high"), F.col("_start") * F.col("_low")))
    ranges = ranges.select(*keys, RANGE, "_start", F.max("_top").over(_before(keys)).alias("_peak"))
    found = prefixed.join(ranges, [*keys, RANGE]).withColumn("cum", F.col("_start") * F.col("_prefix"))
    return found.select(*rows.columns, "cum", F.greatest("_peak", F.max("cum").over(inside)).alias("peak"))
