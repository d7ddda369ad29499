"""Scans by ranges of time against plain Python: numbers, previous rows, running sums, at the edges of ranges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import eventstudy as V
from driftline.operators import trading as B
from driftline.operators.asof import asof_backward, asof_forward
from driftline.operators import metrics as M
from driftline.operators.scans import numbered, running_sums, trailing


def series(rng, key, n, sparse):
    day, out = datetime.date(2001, 12, 20), []
    for _ in range(n):
        day += datetime.timedelta(days=rng.randint(1, 400 if sparse else 4))
        out.append((key, day, None if rng.random() < 0.1 else float(rng.randint(1, 50))))
    return out


def table(spark, seed, n=400):
    rng = random.Random(seed)
    rows = series(rng, "hot", n, False) + series(rng, "rare", 15, True) + series(rng, "one", 1, False) + [(None, datetime.date(2003, 1, 1), 1.0), ("hot", None, 2.0)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, date date, x double").repartition(3)


def test_numbers_and_previous_rows(spark):
    rows, df = table(spark, 1)
    got = {(r.k, r.date): (r.bar_no, r.last_no, r.prev_x) for r in numbered(df, ["k"], "date", ["x"]).collect()}
    want = {}
    for k in ("hot", "rare", "one"):
        own = sorted((d, x) for key, d, x in rows if key == k and d is not None)
        want |= {(k, d): (i + 1, len(own), own[i - 1][1] if i else None) for i, (d, _) in enumerate(own)}
    assert got == want
    assert numbered(df.limit(0), ["k"], "date", ["x"]).count() == 0


def test_running_sums_with_ties(spark):
    rows, _ = table(spark, 2)
    rows = rows + rows[:50]
    df = spark.createDataFrame(rows, "k string, date date, x double")
    for r in running_sums(df, ["k"], "date", ["x"]).collect():
        assert r.run_x == sum(x or 0 for k, d, x in rows if k == r.k and d is not None and d <= r.date)


@pytest.mark.parametrize("block", [35, 64])
def test_cars_by_prefix_sums_are_sums_of_windows(spark, monkeypatch, block):
    """Starts near both ends, over block edges, with missing benchmarks, on sparse and dense series, repeated starts."""
    monkeypatch.setattr(V, "BLOCK", block)
    rng, days = random.Random(5), [datetime.date(2001, 11, 1) + datetime.timedelta(days=i) for i in range(200)]
    prices = [(t, d, 100 + rng.random() * 50) for t in "AB" for d in days if rng.random() < (0.9 if t == "A" else 0.6)] + [("C", days[3], 5.0), ("D", days[3], 5.0), ("D", days[4], 0.0), ("D", days[5], 7.0)]
    bench = [(d, 100 + rng.random() * 20) for d in days if rng.random() < 0.9]
    events = [(i, rng.choice(["Addition", "Removal"]), bool(i % 2), "T50", rng.choice("AABCDE"), days[0] + datetime.timedelta(days=rng.randint(-20, 215))) for i in range(300)]
    panel = spark.createDataFrame(prices, "ticker string, date date, adjusted_close double")
    market = spark.createDataFrame(bench, "date date, bench double")
    ev = spark.createDataFrame(events, "event_id int, action string, off_cycle boolean, tier string, ticker string, ann date")
    rows = lambda df: {r.event_id: tuple(None if r[s] is None else round(r[s], 9) for s in V.WINDOWS) for r in df.collect()}
    want = rows(V.cumulated(V.event_windows(ev, panel, market)))
    got = rows(V.event_cars(ev, panel, market))
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(v == (None,) * len(V.WINDOWS) for k, v in got.items() if k not in want)


def test_sweep_counts_open_holdings(spark):
    """Against a loop over days; a holding of one day, one that ends before it begins, holdings outside all days."""
    rng, day0 = random.Random(9), datetime.date(2001, 11, 1)
    day = lambda i: day0 + datetime.timedelta(days=i)
    held = [(rng.choice("AB"), day(a), day(a + rng.choice([0, 1, 5, 90, -2])), rng.randint(-3, 3)) for a in (rng.randint(-40, 160) for _ in range(300))]
    days = [(k, day(i), i) for k in "ABC" for i in range(0, 120, 2)]
    h, d = spark.createDataFrame(held, "k string, first date, last date, w int"), spark.createDataFrame(days, "k string, date date, note int")
    got = {(r.k, r.date): (r.note, r.open_w) for r in B.open_counts(h, d, ["k"], ["w"]).collect()}
    assert got == {(k, x): (i, sum(w for key, a, z, w in held if key == k and a <= x <= z)) for k, x, i in days}
    whole = {r.date: r.open_w for r in B.open_counts(h, d.select("date", "note").distinct(), [], ["w"]).collect()}
    assert whole == {x: sum(w for _, a, z, w in held if a <= x <= z) for _, x, _ in days}


def test_a_million_holdings_of_one_ticker(spark):
    """Ten thousand days of holding each, never spelled out: ten billion rows if they were."""
    held = spark.range(1_000_000).selectExpr("'T' as k", "date_add(date'1970-01-01', cast(id % 1000 as int)) as first", "date_add(date'1970-01-01', cast(id % 1000 + 10000 as int)) as last", "cast(1 as bigint) as w")
    days = spark.range(0, 12_000, 100).selectExpr("'T' as k", "date_add(date'1970-01-01', cast(id as int)) as date", "cast(id as int) as i")
    for r in B.open_counts(held, days, ["k"], ["w"]).collect():
        assert r.open_w == 1000 * (min(r.i, 999) - max(r.i - 10_000, 0) + 1 if r.i - 10_000 <= 999 else 0)


def test_backtest_against_days_spelled_out(spark):
    rng, day0 = random.Random(4), datetime.date(2001, 12, 1)
    day = lambda i: day0 + datetime.timedelta(days=i)
    rets = {(k, day(i)): rng.gauss(0, 0.02) for k in "AB" for i in range(90) if day(i).weekday() < 5 and rng.random() < 0.8}
    books = [(i, rng.choice("ABC"), rng.choice(["long", "short"]), round(rng.uniform(-0.1, 0.1), 3), day(a), day(a + rng.randint(0, 20))) for i, a in enumerate(rng.randint(-10, 85) for _ in range(60))]
    frame = spark.createDataFrame(books, "event_id int, ticker string, side string, weight double, entry_date date, exit_date date")
    ledger, daily = B.backtest(frame, spark.createDataFrame([(k, d, r) for (k, d), r in rets.items()], "ticker string, date date, ret double"), 1000.0)
    spelled = {(b[0], x): 1000 * b[3] * rets.get((b[1], x), 0.0) for b in books for x in (day(i) for i in range(-10, 110)) if b[4] <= x <= b[5] and x.weekday() < 5}
    costs = {r.event_id: r for r in ledger.collect()}
    assert set(costs) == {i for i, _ in spelled}
    assert all(abs(r.gross_pnl - sum(p for (i, _), p in spelled.items() if i == key)) < 1e-9 for key, r in costs.items())
    want = {}
    for (_, x), p in spelled.items():
        want[x] = want.get(x, 0.0) + p
    for r in costs.values():
        for x in (r.entry_date, r.exit_date):
            want[x] = want.get(x, 0.0) - r.cost / 2
    got = {r.date: r.pnl for r in daily.collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)


@pytest.mark.parametrize("part", ["year", "month", "day"])
def test_asof_over_ranges_is_the_asof_join_of_a_whole_series(spark, part):
    """A hot key's quotes in many ranges, facts in ranges without quotes, at both ends, on the edges of years, without a key or time."""
    rng, day = random.Random(11), datetime.date(2001, 12, 25)
    at = lambda n: day + datetime.timedelta(days=n)
    quotes = [(k, at(n), n) for k, step in (("hot", 2), ("rare", 500), (None, 300)) for n in range(0, 1500, step)] + [("hot", None, -1)]
    edges = [datetime.date(y, m, d) for y in range(2000, 2009) for m, d in ((1, 1), (12, 31))]
    facts = [(i, k, t) for i, (k, t) in enumerate((k, t) for k in ("hot", "rare", "none", None) for t in [*edges, *[at(rng.randint(-900, 2200)) for _ in range(60)], None])]
    q = spark.createDataFrame(quotes, "k string, d date, v int").repartition(3)
    f = spark.createDataFrame(facts, "id int, k string, at date").repartition(3)

    def want(forward, strict=False, tolerance=None):
        out = {}
        for i, k, t in facts:
            fits = [(d, v) for key, d, v in quotes if key == k and None not in (t, d) and (d >= t if forward else d < t if strict else d <= t)]
            best = (min if forward else max)(fits, default=(None, None))
            late = tolerance is not None and best[0] is not None and (best[0] - t).days > tolerance
            out[i] = (None, None) if late else best
        return out

    got = lambda df: {r.id: (r.d_found, r.v) for r in df.collect()}
    assert got(asof_backward(f, q, ["k"], "at", "d", ["v"], part=part)) == want(False)
    assert got(asof_backward(f, q, ["k"], "at", "d", ["v"], strict=True, part=part)) == want(False, strict=True)
    assert got(asof_forward(f, q, ["k"], "at", "d", ["v"], part=part)) == want(True)
    assert got(asof_forward(f, q, ["k"], "at", "d", ["v"], 1, part=part)) == want(True, tolerance=1)


def test_asof_of_a_hot_key_is_sorted_in_parts(spark):
    """A million quotes of one key by the minute: no task sorts more than the rows of a day; numbers as times have one range."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        q = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") * 60).alias("d"), F.col("id").alias("v"))
        f = spark.range(1000).select("id", F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(1_000_000_030) + F.col("id") * 59_940).alias("at"))
        found = asof_backward(f, q, ["k"], "at", "d", ["v"], part="day").withColumn("task", F.spark_partition_id()).persist()
        assert found.where(F.col("v") != F.floor(F.col("id") * 999)).count() == 0 and found.count() == 1000
        assert found.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        found.unpersist()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    n = spark.createDataFrame([("a", 1, 10), ("a", 5, 50)], "k string, d int, v int")
    m = spark.createDataFrame([(0, "a", 4), (1, "a", 5), (2, "a", 0)], "id int, k string, at int")
    assert {r.id: r.v for r in asof_backward(m, n, ["k"], "at", "d", ["v"]).collect()} == {0: 10, 1: 50, 2: None}


@pytest.mark.parametrize("part", ["year", "quarter", "week"])
def test_drawdown_by_ranges(spark, part):
    """Two, seven and over fifty ranges: peaks and falls that reach over ranges, missing returns, total losses, returns below -1."""
    rng, day = random.Random(3), datetime.date(2003, 6, 2)
    ret = {"up": lambda: rng.gauss(0.01, 0.05), "down": lambda: rng.gauss(-0.01, 0.05), "odd": lambda: rng.choice([0.5, -0.4, -1.8, None])}
    rows = [(k, day + datetime.timedelta(days=n), f()) for k, f in ret.items() for n in range(0, 560, 3)] + [("zero", day, -1.0), ("zero", day + datetime.timedelta(days=400), 0.5), (None, day, 0.1), ("up", None, 0.1)]
    got = {(r.ticker, r.date): r for r in M.with_drawdown(spark.createDataFrame(rows, "ticker string, date date, ret double").repartition(3), part=part).collect()}
    assert len(got) == len(rows) - 2
    for k in (*ret, "zero"):
        cum, peak = 1.0, None
        for _, d, x in sorted(r for r in rows if r[0] == k and r[1] is not None):
            cum *= 1 + (x or 0.0)
            peak = cum if peak is None else max(peak, cum)
            assert got[k, d].cum == pytest.approx(cum, rel=1e-9)
            assert got[k, d].drawdown == (None if peak == 0 else pytest.approx(cum / peak - 1, rel=1e-9, abs=1e-12))


@pytest.mark.parametrize(("bars", "block"), [(1, 10), (7, 10), (10, 10), (30, 10), (60, 4096), (500, 64)])
def test_trailing_windows_with_borders(spark, bars, block):
    """Windows shorter and longer than blocks and series give what a window over the whole series gives."""
    rows, df = table(spark, 4)
    got = {(r.k, r.date): (r.n, r.s) for r in trailing(df, ["k"], "date", bars, lambda w: [F.count(F.lit(1)).over(w).alias("n"), F.sum("x").over(w).alias("s")], block).collect()}
    want = {}
    for k in ("hot", "rare", "one"):
        own = sorted((d, x) for key, d, x in rows if key == k and d is not None)
        for i, (d, _) in enumerate(own):
            seen = [x for _, x in own[max(0, i - bars + 1) : i + 1]]
            want[k, d] = (len(seen), sum(x for x in seen if x is not None) if any(x is not None for x in seen) else None)
    assert got == want
