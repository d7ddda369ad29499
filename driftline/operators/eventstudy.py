"""Event-time abnormal returns: windows of bars around events, cumulated per event and summarised over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.asof import asof_lookup
from driftline.operators.ranks import summaries
from driftline.operators.scans import numbered
from driftline.sources.files import written

#: Bars before and after the event bar, calendar days that the event bar may be late, and the windows of cumulation.
BEFORE, AFTER, TOLERANCE = 5, 30, 7
FACTS = ["event_id", "action", "off_cycle", "tier"]
WINDOWS = {"m1_p1": (-1, 1), "p0_p1": (0, 1), "p2_p5": (2, 5), "p2_p10": (2, 10), "p0_p10": (0, 10), "p0_p20": (0, 20)}


def numbered_bars(panel: DataFrame) -> DataFrame:
    """+ bar_no from 1 per ticker in date order."""
    return panel.withColumn("bar_no", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))


def event_windows(events: DataFrame, panel: DataFrame, bench: DataFrame, before: int = BEFORE, after: int = AFTER, tolerance: int = TOLERANCE) -> DataFrame:
    """event_id, action, off_cycle, tier, off, ar (percent).

    The event bar is the first bar at or after the announcement, at most ``tolerance`` days later.  Bars are
    found by an equi-join on (ticker, bar number), the window being spelled out, never by a range join, and once for
    all events of a ticker that start at one bar.
    Returns are taken inside the window, so its first bar has none.
    """
    starts, windows = _started(events, panel, bench, before, after, tolerance)
    return starts.join(windows, ["ticker", "b0"]).select(*FACTS, "off", "ar")


#: Bars of a block of running sums: a span of up to as many ends in its own block or the next one.
BLOCK = 64


def bar_sums(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """ticker, date, bar_no, last_no, block, and running sums of abnormal returns inside blocks of bars: done, left (sum and count c; up to the bar, after it).

    The first return of a series is left out, as windows begin at its second bar.  Sums start anew with each block, so
    a difference of two is as exact as the sum of the window, and a hot ticker's bars are many blocks.
    """
    series = written(panel.select("ticker", "date", "adjusted_close").join(bench, "date", "left"), "series")  # read twice below
    bars = numbered(series, ["ticker"], "date", ["adjusted_close", "bench"])
    change = lambda c: F.try_divide(F.col(c), F.col(f"prev_{c}")) - 1
    ar = F.when(F.col("bar_no") >= 3, 100 * (change("adjusted_close") - change("bench")))
    bars = bars.select("ticker", "date", "bar_no", "last_no", F.expr(f"bar_no div {BLOCK}").alias("block"), ar.alias("ar"))
    whole = Window.partitionBy("ticker", "block")
    so_far = whole.orderBy("bar_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = whole.orderBy("bar_no").rowsBetween(1, Window.unboundedFollowing)
    value = F.coalesce("ar", F.lit(0.0))
    sums = lambda w: F.struct(F.coalesce(F.sum(value).over(w), F.lit(0.0)).alias("s"), F.count("ar").over(w).alias("c"))
    return bars.select("ticker", "date", "bar_no", "last_no", "block", sums(so_far).alias("done"), sums(after).alias("left"))


def event_cars(events: DataFrame, panel: DataFrame, bench: DataFrame, spans: dict[str, tuple[int, int]] = WINDOWS, tolerance: int = TOLERANCE) -> DataFrame:
    """``cumulated`` of the windows of all events by prefix sums: a span is the difference of two bars found by equality.

    Each distinct (ticker, start bar) is looked up once for each distinct end of a span: work follows the panel, not
    events times bars.  Spans have at most BLOCK bars and lie inside the window of ``event_windows``.
    """
    if any(b - a >= BLOCK or a <= -BEFORE or b > AFTER for a, b in spans.values()):
        raise ValueError("a span must lie inside the window of bars")
    bars = written(bar_sums(panel, bench), "bars")
    found = asof_lookup(events.select(*FACTS, "ticker", "ann"), bars.select("ticker", "date", "bar_no", "last_no"), ["ticker"], "ann", "date", ["bar_no", "last_no"], forward=True, tolerance_days=tolerance)
    starts = found.where("bar_no is not null").select(*FACTS, "ticker", F.col("bar_no").alias("b0"), "last_no")
    ends = sorted({o for a, b in spans.values() for o in (a - 1, b)})
    wanted = starts.select("ticker", "b0", "last_no").distinct().select("ticker", "b0", F.explode(F.array(*[F.struct(F.lit(o).alias("off"), F.least(F.col("b0") + o, "last_no").alias("bar_no")) for o in ends])).alias("e"))
    at = wanted.select("ticker", "b0", "e.*").join(bars.select("ticker", "bar_no", F.struct("block", "done", "left").alias("bar")), ["ticker", "bar_no"])
    side_by_side = at.groupBy("ticker", "b0").agg(*[F.first(F.when(F.col("off") == o, F.col("bar")), ignorenulls=True).alias(f"at_{i}") for i, o in enumerate(ends)])
    cols = []
    for name, (a, b) in spans.items():
        low, high = f"at_{ends.index(a - 1)}", f"at_{ends.index(b)}"
        same = F.coalesce(F.col(f"{low}.block"), F.lit(0)) == F.col(f"{high}.block")
        # Before the series there is no bar: nothing is subtracted.
        part = lambda f: F.col(f"{high}.done.{f}") + F.when(same, -F.coalesce(F.col(f"{low}.done.{f}"), F.lit(0))).otherwise(F.col(f"{low}.left.{f}"))  # noqa: B023, E731
        cols.append(F.when(part("c") >= max(1, int(0.6 * (b - a + 1))), part("s")).alias(name))
    return starts.join(side_by_side.select("ticker", "b0", *cols), ["ticker", "b0"]).select(*FACTS, *spans)


def _started(events: DataFrame, panel: DataFrame, bench: DataFrame, before: int = BEFORE, after: int = AFTER, tolerance: int = TOLERANCE):
    """(events with ticker and b0, windows of the distinct starts: ticker, b0, off, ar)."""
    bars = numbered_bars(panel.select("ticker", "date", "adjusted_close")).join(bench, "date", "left")
    found = asof_lookup(events.select(*FACTS, "ticker", "ann"), bars.select("ticker", "date", "bar_no"), ["ticker"], "ann", "date", ["bar_no"], forward=True, tolerance_days=tolerance)
    starts = found.where("bar_no is not null").select(*FACTS, "ticker", F.col("bar_no").alias("b0"))
    spelled = starts.select("ticker", "b0").distinct().select("ticker", "b0", F.explode(F.sequence(F.greatest(F.lit(2), F.col("b0") - before), F.col("b0") + after)).alias("bar_no"))
    inside = spelled.join(bars, ["ticker", "bar_no"]).withColumn("off", F.col("bar_no") - F.col("b0"))
    by = Window.partitionBy("ticker", "b0").orderBy("off")
    change = lambda c: F.try_divide(F.col(c), F.lag(c).over(by)) - 1
    return starts, inside.select("ticker", "b0", "off", (100 * (change("adjusted_close") - change("bench"))).alias("ar"))


def abnormal_returns(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """ticker, bar_no (from 0), ar (percent; null where either return is missing): over whole series, the benchmark on the ticker's dates."""
    bars = numbered_bars(panel.select("ticker", "date", "adjusted_close")).join(bench, "date", "left")
    by = Window.partitionBy("ticker").orderBy("bar_no")
    change = lambda c: F.try_divide(F.col(c), F.lag(c).over(by)) - 1
    return bars.select("ticker", (F.col("bar_no") - 1).alias("bar_no"), (100 * (change("adjusted_close") - change("bench"))).alias("ar"))


def cumulated(windows: DataFrame, spans: dict[str, tuple[int, int]] = WINDOWS, by: list[str] = FACTS) -> DataFrame:
    """Per event (or ``by``): a column per span with the sum of abnormal returns; null where under 60 percent of its bars have one."""
    cols = []
    for name, (a, b) in spans.items():
        inside = F.when(F.col("off").between(a, b), F.col("ar"))
        cols.append(F.when(F.count(inside) >= max(1, int(0.6 * (b - a + 1))), F.sum(inside)).alias(name))
    return windows.groupBy(*by).agg(*cols)


def car_summary(cars: DataFrame, spans: dict[str, tuple[int, int]] = WINDOWS) -> DataFrame:
    """action, off_cycle, span, n, mean, median, t, expected_share (of the sign that the action leads to expect)."""
    stacked = cars.select("action", "off_cycle", F.explode(F.array(*[F.struct(F.lit(s).alias("span"), F.col(s).alias("car")) for s in spans])).alias("x")).select("action", "off_cycle", "x.*")
    by = ["action", "off_cycle", "span"]
    as_expected = F.when(F.col("action") == "Addition", F.col("pos")).otherwise(F.col("neg")) / F.col("n")
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return summaries(stacked, by, "car").select(*by, "n", "mean", "median", t.alias("t"), as_expected.alias("expected_share"))


def car_path(windows: DataFrame) -> DataFrame:
    """action, off, mean_ar, car: average abnormal return per offset and its running sum."""
    mean = windows.groupBy("action", "off").agg(F.avg("ar").alias("mean_ar"))
    return mean.withColumn("car", F.sum("mean_ar").over(Window.partitionBy("action").orderBy("off")))
