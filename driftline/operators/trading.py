"""Signals, sizing, exposure, daily positions, the position back-test and gated trade ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.calendar import bday_add, weekdays_between
from driftline.functions.costs import borrow_cost, study_cost_bps, trade_cost
from driftline.operators.asof import asof_lookup
from driftline.operators.ranks import summaries
from driftline.operators.scans import running_sums, trailing
from driftline.sources.files import written


def signals(events: DataFrame, variant: str = "announcement", exit_offset: int = 0) -> DataFrame:
    """+ side, entry_date, exit_date.  Variants: announcement, pre_announcement (five calendar days before), additions_only, removals_only."""
    side = F.when(F.col("action").isin("Addition", "Promotion"), "long").when(F.col("action").isin("Removal", "Demotion"), "short")
    entry = F.date_sub("ann", 5) if variant == "pre_announcement" else F.col("ann")
    leave = bday_add(F.col("eff"), exit_offset) if exit_offset else F.col("eff")
    out = events.withColumns({"side": side, "entry_date": entry, "exit_date": F.greatest(entry, leave)}).where("side is not null")
    only = {"additions_only": "long", "removals_only": "short"}.get(variant)
    return out.where(F.col("side") == only) if only else out


def size_positions(signals: DataFrame, method: str = "equal", most: float = 0.10) -> DataFrame:
    """+ weight: per (entry_date, side), equal or in proportion to ``score``; capped; shorts negative; 0 where nothing is to divide."""
    group = Window.partitionBy("entry_date", "side")
    if method == "equal":
        raw = 1 / F.count(F.lit(1)).over(group)
    elif method == "proportional":
        raw = F.coalesce(F.try_divide(F.col("score"), F.sum("score").over(group)), F.lit(0.0))
    else:
        raise ValueError(f"unknown sizing method {method}")
    capped = F.least(raw, F.lit(most))
    return signals.withColumn("weight", F.when(F.col("side") == "short", -capped).otherwise(capped))


def enforce_exposure(weights: DataFrame, gross: float = 1.0, net: float = 0.2) -> DataFrame:
    """Scale each entry date to the gross limit, then shift two-sided books to the net limit."""
    day = Window.partitionBy("entry_date")
    total = F.sum(F.abs("weight")).over(day)
    scaled = weights.withColumn("weight", F.when(total > gross, F.col("weight") * gross / total).otherwise(F.col("weight")))
    tilt = F.sum("weight").over(day)
    both = F.max((F.col("side") == "long").cast("int")).over(day) + F.max((F.col("side") == "short").cast("int")).over(day) == 2
    shift = (F.abs(tilt) - net) * F.signum(tilt) / F.count(F.lit(1)).over(day)
    return scaled.withColumn("weight", F.when(both & (F.abs(tilt) > net), F.col("weight") - shift).otherwise(F.col("weight")))


def daily_positions(weights: DataFrame) -> DataFrame:
    """A row per position and weekday from entry to exit."""
    return weights.withColumn("date", F.explode(weekdays_between(F.col("entry_date"), F.col("exit_date"))))


def backtest(weights: DataFrame, rets: DataFrame, capital: float = 1_000_000.0) -> tuple[DataFrame, DataFrame]:
    """(ledger, daily).  weights: event_id, ticker, side, weight, entry_date, exit_date; rets: ticker, date, ret.

    A position is held on each weekday from entry to exit.  The ledger has a row per event with gross pnl and cost; half
    of the cost falls on each end.  Positions are never spelled out in days: what is open on a day comes from a sweep, and a
    position's return from the difference of two running sums.  Weights and returns are summed as decimals, so that a
    book that is closed holds nothing.
    """
    own = weights.select("event_id", "ticker", "side", "weight", "entry_date", "exit_date")
    held = written(own.where((F.datediff("exit_date", "entry_date") >= 2) | (F.weekday("entry_date") < 5) | (F.weekday("exit_date") < 5)), "held")
    days = written(rets.where(F.weekday("date") < 5).select("ticker", "date", F.coalesce("ret", F.lit(0.0)).alias("ret")), "returns")
    holdings = held.select("ticker", F.col("entry_date").alias("first"), F.col("exit_date").alias("last"), F.col("weight").cast("decimal(20,18)").alias("weight"), F.lit(1).cast("long").alias("n"))
    pnl = open_counts(holdings, days, ["ticker"], ["weight", "n"]).where("open_n > 0").select("date", (F.col("open_weight").cast("double") * F.col("ret") * capital).alias("pnl"))
    span = holdings.agg(F.min("first").alias("a"), F.max("last").alias("z")).where("a is not null")
    calendar = span.select(F.explode(weekdays_between(F.col("a"), F.col("z"))).alias("date"))
    quiet = open_counts(holdings, calendar, [], ["n"]).where("open_n > 0").select("date", F.lit(0.0).alias("pnl"))
    sums = running_sums(days.withColumn("x", F.col("ret").cast("decimal(28,15)")), ["ticker"], "date", ["x"]).select("ticker", "date", F.col("run_x").alias("total"))
    sums = written(sums, "sums")
    ended = asof_lookup(held, sums, ["ticker"], "exit_date", "date", ["total"]).withColumnsRenamed({"total": "up_to"}).drop("date_found")
    both = asof_lookup(ended, sums, ["ticker"], "entry_date", "date", ["total"], strict=True)
    value = F.col("weight") * capital
    gained = F.coalesce(F.col("up_to"), F.lit(0)) - F.coalesce(F.col("total"), F.lit(0))
    borrow = F.when(F.col("side") == "short", borrow_cost(value, F.datediff("exit_date", "entry_date"))).otherwise(F.lit(0.0))
    ledger = both.select(*own.columns, (value * gained.cast("double")).alias("gross_pnl"), (2 * trade_cost(value, F.lit(None).cast("double")) + borrow).alias("cost"))
    ends = ledger.select(F.explode(F.array("entry_date", "exit_date")).alias("date"), (-F.col("cost") / 2).alias("pnl"))
    daily = pnl.unionByName(quiet).unionByName(ends).groupBy("date").agg(F.sum("pnl").alias("pnl"))
    return ledger, daily.withColumn("ret", F.col("pnl") / capital)


#: Gate of the trade ledger: calendar days that a bar may be late, least value traded, days that history may begin late.
LATE_DAYS, LEAST_VALUE, HISTORY_DAYS = 10, 250_000.0, 3


def with_turnover(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """trades + turnover: median value traded from entry to exit.

    Once per distinct holding, of which there are no more than tickers and dates allow, whatever the number of trades.
    """
    held = trades.where(F.datediff("exit_date", "entry_date") > 0).select("ticker", "entry_date", "exit_date").distinct()
    days = held.select("*", F.explode(F.sequence("entry_date", "exit_date")).alias("date"))
    turnover = days.join(bars.select("ticker", "date", "value"), ["ticker", "date"]).groupBy("ticker", "entry_date", "exit_date").agg(F.median("value").alias("turnover"))
    return trades.join(written(turnover, "turnover"), ["ticker", "entry_date", "exit_date"], "left")


def trade_ledger(events: DataFrame, panel: DataFrame, exits: tuple[int, ...] = (0, 5, 10), least_value: float = LEAST_VALUE) -> DataFrame:
    """A row per event and exit offset: entry and exit bars, hold_days, raw_ret, sided_ret (percent) and the reason it is (not) valid.

    Entry is the first bar from the weekday after the announcement, exit from the offset weekday after the
    effective date.  Turnover is the median value traded from entry to exit.  Reasons in order: no_price_file, no_history_at_event, entry_gap, exit_gap,
    zero_or_negative_hold, illiquid_or_stale, zero_volume_endpoint, bad_price, ok.
    """
    # Bars feed two look-ups, the turnover and the first bars, and each look-up reads its facts twice: written once each.
    bars = written(panel.select("ticker", "date", F.col("adjusted_close").alias("px"), F.col("volume").alias("vol"), (F.col("close") * F.col("volume")).alias("value")), "bars")
    first = bars.groupBy("ticker").agg(F.min("date").alias("first_bar"))
    wanted = events.select("event_id", "ticker", "action", "tier", "ann", "eff", bday_add(F.col("ann"), 1).alias("want_in"))
    entered = asof_lookup(wanted, bars, ["ticker"], "want_in", "date", ["px", "vol"], forward=True, tolerance_days=LATE_DAYS)
    entered = entered.withColumnsRenamed({"date_found": "entry_date", "px": "entry_px", "vol": "entry_vol"})
    choices = F.array(*[F.struct(F.lit(n).alias("exit"), bday_add(F.col("eff"), n).alias("want_out")) for n in exits])
    spread = written(entered.withColumn("x", F.explode(choices)).select("*", "x.*").drop("x"), "entered")
    left = asof_lookup(spread, bars, ["ticker"], "want_out", "date", ["px", "vol"], forward=True, tolerance_days=LATE_DAYS).withColumnsRenamed({"date_found": "exit_date", "px": "exit_px", "vol": "exit_vol"})
    known = written(left.join(first, "ticker", "left"), "left")
    hold = F.datediff("exit_date", "entry_date")
    known = with_turnover(known, bars)
    reason = (
        F.when(F.col("first_bar").isNull(), "no_price_file")
        .when(F.col("first_bar") > F.date_add("ann", HISTORY_DAYS), "no_history_at_event")
        .when(F.col("entry_date").isNull(), "entry_gap")
        .when(F.col("exit_date").isNull(), "exit_gap")
        .when(hold <= 0, "zero_or_negative_hold")
        .when(F.coalesce("turnover", F.lit(0.0)) < least_value, "illiquid_or_stale")
        .when((F.col("entry_vol") <= 0) | (F.col("exit_vol") <= 0), "zero_volume_endpoint")
        .when(~((F.col("entry_px") > 0) & (F.col("exit_px") > 0)), "bad_price")
        .otherwise("ok")
    )
    raw = 100 * (F.try_divide(F.col("exit_px"), F.col("entry_px")) - 1)
    return known.select(
        "event_id", "ticker", "action", "tier", "exit", "ann", "entry_date", "exit_date", hold.alias("hold_days"), raw.alias("raw_ret"),
        F.when(F.col("action") == "Addition", raw).otherwise(-raw).alias("sided_ret"), reason.alias("reason"),
    )


def entry_gate(events: DataFrame, panel: DataFrame, least_value: float = LEAST_VALUE) -> DataFrame:
    """events + entry_date and reason by the later, simpler gate: the exit bar is the first from the effective date itself.

    Prices are not tested, and the exit needs no volume.  Reasons in order: no_price_file, no_history_at_event,
    entry_gap, exit_gap, zero_or_negative_hold, illiquid_or_stale, zero_volume_endpoint, ok.
    """
    bars = panel.select("ticker", "date", F.col("volume").alias("vol"), (F.col("close") * F.col("volume")).alias("value"))
    first = bars.groupBy("ticker").agg(F.min("date").alias("first_bar"))
    entered = asof_lookup(events.withColumn("want_in", bday_add(F.col("ann"), 1)), bars, ["ticker"], "want_in", "date", ["vol"], forward=True, tolerance_days=LATE_DAYS).withColumnRenamed("date_found", "entry_date")
    left = asof_lookup(entered, bars, ["ticker"], "eff", "date", [], forward=True, tolerance_days=LATE_DAYS).withColumnRenamed("date_found", "exit_date")
    known = with_turnover(left.join(first, "ticker", "left"), bars)
    reason = (
        F.when(F.col("first_bar").isNull(), "no_price_file")
        .when(F.col("first_bar") > F.date_add("ann", HISTORY_DAYS), "no_history_at_event")
        .when(F.col("entry_date").isNull(), "entry_gap")
        .when(F.col("exit_date").isNull(), "exit_gap")
        .when(F.datediff("exit_date", "entry_date") <= 0, "zero_or_negative_hold")
        .when(F.coalesce("turnover", F.lit(0.0)) < least_value, "illiquid_or_stale")
        .when(F.col("vol") <= 0, "zero_volume_endpoint")
        .otherwise("ok")
    )
    return known.select(*events.columns, "entry_date", reason.alias("reason"))


def forecast_from_labels(events: DataFrame, tiers: list[str]) -> DataFrame:
    """Labels of the given tiers as if they had been forecast: constant score, flow, volatility and conviction."""
    # Fixed values of the study: score, flow and volatility of every row.
    return events.where(F.col("tier").isin(tiers)).select(
        "event_id", "ticker", "tier", F.col("action").alias("predicted_action"), F.lit(0.8).alias("hybrid"), F.lit(0.6).alias("flow_to_adv"), F.lit("high").alias("bucket"),
        "ann", "eff", F.trunc("ann", "MM").alias("rebalance_month"), F.lit(0.3).alias("volatility"), F.lit("none").alias("quality"),
    )


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """tier (or ALL), exit, action: n, mean, median, std and win rate of valid trades, by grouping sets."""
    tier, action, everything = F.col("tier"), F.col("action"), F.lit("ALL")
    sets = F.explode(F.array(*[F.struct(t.alias("tier"), a.alias("action")) for t, a in ((tier, action), (everything, action), (everything, everything))]))
    by = ["tier", "exit", "action"]
    rows = ledger.where("reason = 'ok'").select("exit", "sided_ret", sets.alias("set")).select("exit", "set.*", "sided_ret")
    return summaries(rows, by, "sided_ret").select(*by, "n", "mean", "median", F.col("sd").alias("std"), (F.col("pos") / F.col("n")).alias("win_rate"))


def open_counts(holdings: DataFrame, days: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """days (by, date, ...) + for each column c of ``sums`` open_c: its sum over the holdings (by, first, last, c) with first <= date <= last.

    A sweep: a holding adds at its first day and takes away on the day after its last one, and a running sum is what is open.
    Work follows changes and days, however long holdings are and however many are open on a day.  Sums are exact where
    the columns are whole or decimal numbers.
    """
    change = F.explode(F.array(F.struct(F.col("first").alias("date"), F.lit(1).alias("sign")), F.struct(F.date_add("last", 1).alias("date"), F.lit(-1).alias("sign")))).alias("_e")
    changes = holdings.where("first <= last").select(*by, *sums, change).groupBy(*by, F.col("_e.date").alias("date")).agg(*[F.sum(F.col(c) * F.col("_e.sign")).alias(c) for c in sums])
    marked = days.select(*by, "date", F.struct(*days.columns).alias("_day"))
    swept = running_sums(written(marked.unionByName(changes, allowMissingColumns=True), "changes"), by, "date", sums)
    return swept.where("_day is not null").select("_day.*", *[F.col(f"run_{c}").alias(f"open_{c}") for c in sums])


def daily_book(ledger: DataFrame, panel: DataFrame, exit: int = 5, clip: float = 0.12, cash: float = 0.025) -> DataFrame:
    """date, long, short, ls, open_trades: mean clipped return of open trades (entry < date <= exit) per side, else cash."""
    from driftline.operators.features import returns

    side = lambda name: (F.col("action") == name).cast("long").alias(name)
    trades = ledger.where((F.col("reason") == "ok") & (F.col("exit") == exit)).select("ticker", F.date_add("entry_date", 1).alias("first"), F.col("exit_date").alias("last"), side("Addition"), side("Removal"), F.lit(1).cast("long").alias("all"))
    rets = returns(panel.select("ticker", "date", "adjusted_close")).select("ticker", "date", F.greatest(F.least("ret", F.lit(clip)), F.lit(-clip)).alias("ret"))
    held = open_counts(trades, rets, ["ticker"], ["Addition", "Removal", "all"])
    known = lambda c: F.when(F.col("ret").isNotNull(), F.col(f"open_{c}"))
    mean = lambda c: F.try_divide(F.sum(F.col("ret") * known(c)), F.sum(known(c)))
    by_day = held.groupBy("date").agg(mean("Addition").alias("l"), (-mean("Removal")).alias("s"), F.sum("open_all").alias("open_trades"))
    rf = F.lit(cash / 252)
    both = F.when(F.col("l").isNull() & F.col("s").isNull(), rf).otherwise(F.coalesce("l", F.lit(0.0)) + F.coalesce("s", F.lit(0.0)))
    return by_day.select("date", F.coalesce("l", rf).alias("long"), F.coalesce("s", rf).alias("short"), both.alias("ls"), "open_trades")


def advs_at_entry(ledger: DataFrame, panel: DataFrame, bars: int = 20) -> DataFrame:
    """ledger + adv: mean value traded of the last ``bars`` bars up to the entry."""
    values = panel.select("ticker", "date", (F.col("close") * F.col("volume")).alias("value"))
    adv = trailing(values, ["ticker"], "date", bars, lambda frame: [F.avg("value").over(frame).alias("adv")]).drop("value")
    return asof_lookup(ledger, adv, ["ticker"], "entry_date", "date", ["adv"]).drop("date_found")


def net_of_friction(trades: DataFrame, panel: DataFrame, clips: tuple[int, ...]) -> DataFrame:
    """trades of a ledger, once per clip size: + vol, adv, clip, net (percent after the study's costs).

    Volatility is that of the last 60 returns up to the entry, 0.03 with fewer than 20 or none.
    """
    from driftline.operators.features import returns

    known_returns = returns(panel).where("ret is not null").select("ticker", "date", "ret")
    vols = trailing(known_returns, ["ticker"], "date", 60, lambda frame: [F.count("ret").over(frame).alias("c"), F.stddev_samp("ret").over(frame).alias("s")])
    at = asof_lookup(advs_at_entry(trades, panel), vols, ["ticker"], "entry_date", "date", ["c", "s"])
    known = at.withColumn("vol", F.when((F.col("c") >= 20) & (F.col("s") > 0), F.col("s")).otherwise(F.lit(0.03))).drop("c", "s", "date_found")
    cost = lambda clip: study_cost_bps(F.col("vol"), F.col("adv"), float(clip), F.col("hold_days"), F.col("action") == "Removal")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("clip"), (F.col("sided_ret") - cost(c) / 100).alias("net")) for c in clips])).alias("_c")
    return known.select("*", each).select("*", "_c.clip", "_c.net").drop("_c")


def friction_summary(net: DataFrame, least: int = 8) -> DataFrame:
    """Gross and net figures per (tier or ALL, action, clip) of ``least`` trades or more."""
    tiers = F.explode(F.array("tier", F.lit("ALL"))).alias("tier")
    rows, by = net.select(tiers, "action", "clip", "net", "sided_ret"), ["tier", "action", "clip"]
    figures = summaries(rows, by, "net", also={"gross_mean": F.avg("sided_ret")}, of=("sided_ret",)).where(F.col("n") >= least)
    return figures.select(*by, "n", "gross_mean", F.col("mean").alias("net_mean"), F.col("median").alias("net_median"), (F.col("pos") / F.col("n")).alias("net_win"))
