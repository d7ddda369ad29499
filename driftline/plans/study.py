"""Queries over dated events: event study, ledgers, back-test, rules, membership, text, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import stats as S
from driftline.functions import text as T
from driftline.operators import events as E
from driftline.operators import eventstudy as V
from driftline.operators import features as X
from driftline.operators import rules as R
from driftline.operators import trading as B
from driftline.operators.asof import asof_by_day, asof_lookup
from driftline.plans.panel import RET, bday_sql, rounded
from driftline.sources import adapters as A
from driftline.sources.adapters import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def windows(spark, d):
    return V.event_windows(A.events(spark, d), A.prices(spark, d), A.benchmark(spark, d))


def cars(spark, d):
    return V.event_cars(A.events(spark, d), A.prices(spark, d), A.benchmark(spark, d))


NUMBERED = "bars AS (SELECT ticker, date, adjusted_close, bench, row_number() OVER (PARTITION BY ticker ORDER BY date) AS bar_no FROM px LEFT JOIN bench USING (date))"
WIN = f"""{NUMBERED}, t0 AS (SELECT e.*, b.bar_no AS b0, b.date AS d0 FROM ev e ASOF JOIN bars b ON e.ticker = b.ticker AND e.ann <= b.date WHERE b.date - e.ann <= 7),
  win AS (SELECT event_id, action, off_cycle, tier, b.bar_no - b0 AS off, 100 * ((adjusted_close / lag(adjusted_close) OVER w - 1) - (bench / lag(bench) OVER w - 1)) AS ar
   FROM t0 JOIN bars b ON b.ticker = t0.ticker AND b.bar_no BETWEEN greatest(2, b0 - 5) AND b0 + 30 WINDOW w AS (PARTITION BY event_id ORDER BY b.bar_no))"""
CARS = "cars AS (SELECT event_id, action, off_cycle, tier, " + ", ".join(f"CASE WHEN count(ar) FILTER (WHERE off BETWEEN {a} AND {b}) >= {max(1, int(0.6 * (b - a + 1)))} THEN sum(ar) FILTER (WHERE off BETWEEN {a} AND {b}) END AS {n}" for n, (a, b) in V.WINDOWS.items()) + " FROM win GROUP BY 1, 2, 3, 4)"
VIEWS = ("px", "bench", "ev")


@query("r17_car_summary", sql(f""", {WIN}, {CARS}, l AS (UNPIVOT cars ON {', '.join(V.WINDOWS)} INTO NAME span VALUE car)
  SELECT action, off_cycle, span, count(*) AS n, round(avg(car), 4) AS mean, round(median(car), 4) AS median, round(CASE WHEN stddev_samp(car) > 0 THEN avg(car) / (stddev_samp(car) / sqrt(count(*))) END, 4) AS t,
  round(avg(CASE WHEN (action = 'Addition' AND car > 0) OR (action <> 'Addition' AND car < 0) THEN 1 ELSE 0 END), 4) AS expected_share FROM l WHERE car IS NOT NULL GROUP BY 1, 2, 3""", *VIEWS))
def r17(spark, d):
    return rounded(V.car_summary(cars(spark, d)))


@query("j24_event_bar", sql(""" SELECT event_id, b.date AS bar_date FROM ev e ASOF LEFT JOIN px b ON e.ticker = b.ticker AND e.ann <= b.date WHERE b.date IS NULL OR b.date - e.ann <= 7
  UNION ALL SELECT event_id, NULL FROM ev e ASOF JOIN px b ON e.ticker = b.ticker AND e.ann <= b.date WHERE b.date - e.ann > 7""", "px", "ev"))
def j24(spark, d):
    return asof_lookup(A.events(spark, d), A.prices(spark, d).select("ticker", "date"), ["ticker"], "ann", "date", [], forward=True, tolerance_days=7).select("event_id", F.col("date_found").alias("bar_date"))


@query("j22_asof_forward", sql(""" SELECT event_id, b.date AS bar_date, b.close AS close FROM ev e ASOF LEFT JOIN px b ON e.ticker = b.ticker AND e.eff <= b.date""", "px", "ev"))
def j22(spark, d):
    return asof_lookup(A.events(spark, d), A.prices(spark, d).select("ticker", "date", "close"), ["ticker"], "eff", "date", ["close"], forward=True).select("event_id", F.col("date_found").alias("bar_date"), "close")


@query("j25_event_window", sql(f""", {WIN} SELECT event_id, off, round(ar, 4) AS ar FROM win""", *VIEWS))
def j25(spark, d):
    return rounded(windows(spark, d).select("event_id", "off", "ar"))


@query("g33_car", sql(f""", {WIN}, {CARS} SELECT event_id, action, off_cycle, tier, {', '.join(f'round({n}, 4) AS {n}' for n in V.WINDOWS)} FROM cars""", *VIEWS))
def g33(spark, d):
    return rounded(cars(spark, d))


@query("g34_car_path", sql(f""", {WIN}, m AS (SELECT action, off, avg(ar) AS mean_ar FROM win GROUP BY 1, 2) SELECT action, off, round(mean_ar, 4) AS mean_ar, round(sum(mean_ar) OVER (PARTITION BY action ORDER BY off), 4) AS car FROM m""", *VIEWS))
def g34(spark, d):
    return rounded(V.car_path(windows(spark, d)))


@query("j27_membership_asof", sql(""" SELECT a.event_id, coalesce(b.action = 'Addition', false) AS member FROM ev a ASOF LEFT JOIN (SELECT ticker, ann, max_by(action, event_id) AS action FROM ev GROUP BY 1, 2) b ON a.ticker = b.ticker AND a.ann > b.ann""", "ev"))
def j27(spark, d):
    ev = A.events(spark, d)
    last = ev.groupBy("ticker", F.col("ann").alias("at")).agg(F.max_by("action", "event_id").alias("was"))
    return asof_lookup(ev, last, ["ticker"], "ann", "at", ["was"], strict=True).select("event_id", F.coalesce(F.col("was") == "Addition", F.lit(False)).alias("member"))


@query("j30_interval_compound", sql(""", b AS (SELECT date, bench, row_number() OVER (ORDER BY date) AS n FROM bench) SELECT event_id, round(z.bench / a.bench - 1, 6) AS bench_ret FROM ev e ASOF LEFT JOIN b a ON e.ann >= a.date ASOF LEFT JOIN b z ON e.eff >= z.date""", "bench", "ev"))
def j30(spark, d):
    bench = A.benchmark(spark, d)
    ev = A.events(spark, d).select("event_id", "ann", "eff")
    first = asof_by_day(ev, bench, "ann", "date", ["bench"]).withColumnRenamed("bench", "b0").drop("date_found")
    both = asof_by_day(first, bench, "eff", "date", ["bench"])
    return rounded(both.select("event_id", (F.try_divide("bench", "b0") - 1).alias("bench_ret")), 6)


def ledger(spark, d, exits: tuple[int, ...] = (0, 5, 10)):
    return B.trade_ledger(A.events(spark, d), A.prices(spark, d), exits, least_value=20_000.0)


LEDGER = f"""bars AS (SELECT ticker, date, adjusted_close AS px, volume AS vol, close * volume AS value FROM px), fb AS (SELECT ticker, min(date) AS first_bar FROM bars GROUP BY 1),
  x AS (SELECT e.*, {bday_sql('e.ann', 1)} AS want_in, n AS "exit" FROM ev e, (VALUES (0), (5), (10)) v(n)),
  y AS (SELECT *, CASE "exit" WHEN 0 THEN {bday_sql('eff', 0)} WHEN 5 THEN {bday_sql('eff', 5)} ELSE {bday_sql('eff', 10)} END AS want_out FROM x),
  i AS (SELECT y.*, b.date AS bd, b.px AS bp, b.vol AS bv, b.value AS bval FROM y ASOF LEFT JOIN bars b ON y.ticker = b.ticker AND y.want_in <= b.date),
  o AS (SELECT i.*, b.date AS xd, b.px AS xp, b.vol AS xv FROM i ASOF LEFT JOIN bars b ON i.ticker = b.ticker AND i.want_out <= b.date),
  c AS (SELECT o.*, first_bar, CASE WHEN bd - want_in <= 10 THEN bd END AS entry_date, CASE WHEN bd - want_in <= 10 THEN bp END AS ip, CASE WHEN xd - want_out <= 10 THEN xd END AS exit_date, CASE WHEN xd - want_out <= 10 THEN xp END AS op FROM o LEFT JOIN fb USING (ticker)),
  tv AS (SELECT c.event_id, c."exit", median(b.value) AS turnover FROM c JOIN bars b ON b.ticker = c.ticker AND b.date BETWEEN c.entry_date AND c.exit_date GROUP BY 1, 2),
  led AS (SELECT event_id, ticker, action, tier, "exit", ann, entry_date, exit_date, CAST(exit_date - entry_date AS INTEGER) AS hold_days, 100 * (op / ip - 1) AS raw_ret, CASE WHEN action = 'Addition' THEN 1 ELSE -1 END * 100 * (op / ip - 1) AS sided_ret,
   CASE WHEN first_bar IS NULL THEN 'no_price_file' WHEN first_bar > ann + 3 THEN 'no_history_at_event' WHEN entry_date IS NULL THEN 'entry_gap' WHEN exit_date IS NULL THEN 'exit_gap' WHEN exit_date - entry_date <= 0 THEN 'zero_or_negative_hold'
    WHEN coalesce(turnover, 0) < 20000 THEN 'illiquid_or_stale' WHEN bv <= 0 OR xv <= 0 THEN 'zero_volume_endpoint' WHEN NOT (ip > 0 AND op > 0) THEN 'bad_price' ELSE 'ok' END AS reason FROM c LEFT JOIN tv USING (event_id, "exit"))"""


@query("r10_trade_ledger", sql(f""", {LEDGER} SELECT event_id, ticker, action, tier, "exit", ann, entry_date, exit_date, hold_days, round(raw_ret, 4) AS raw_ret, round(sided_ret, 4) AS sided_ret, reason FROM led""", "px", "ev"))
def r10(spark, d):
    return rounded(ledger(spark, d))


@query("p20_trade_gate", sql(f""", {LEDGER} SELECT reason, count(*) AS n FROM led GROUP BY 1""", "px", "ev"))
def p20(spark, d):
    return ledger(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("g27_summary_grouping_sets", sql(f""", {LEDGER} SELECT coalesce(tier, 'ALL') AS tier, "exit", coalesce(action, 'ALL') AS action, count(*) AS n, round(avg(sided_ret), 4) AS mean, round(median(sided_ret), 4) AS median, round(stddev_samp(sided_ret), 4) AS std,
  round(avg(CASE WHEN sided_ret > 0 THEN 1 ELSE 0 END), 4) AS win_rate FROM led WHERE reason = 'ok' GROUP BY GROUPING SETS ((tier, "exit", action), ("exit", action), ("exit"))""", "px", "ev"))
def g27(spark, d):
    return rounded(B.ledger_summary(ledger(spark, d)))


@query("g28_quarterly_compound", sql(f""", {LEDGER}, a AS (SELECT ann, action, avg(sided_ret) AS m FROM led WHERE reason = 'ok' AND "exit" = 5 GROUP BY 1, 2), q AS (SELECT CAST(date_trunc('quarter', ann) AS DATE) AS quarter, action, avg(m) / 1000 AS x FROM a GROUP BY 1, 2)
  SELECT action, count(*) AS quarters, round(product(1 + x) - 1, 6) AS total FROM q GROUP BY 1""", "px", "ev"))
def g28(spark, d):
    a = ledger(spark, d).where("reason = 'ok' and exit = 5").groupBy("ann", "action").agg(F.avg("sided_ret").alias("m"))
    q = a.groupBy(F.trunc("ann", "QUARTER").alias("quarter"), "action").agg((F.avg("m") / 1000).alias("x"))
    return rounded(q.groupBy("action").agg(F.count(F.lit(1)).alias("quarters"), (F.product(1 + F.col("x")) - 1).alias("total")), 6)


@query("g29_trimmed_compound", sql(f""", {LEDGER}, q AS (SELECT CAST(date_trunc('quarter', ann) AS DATE) AS quarter, action, avg(sided_ret) / 1000 AS x FROM led WHERE reason = 'ok' AND "exit" = 5 GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY x, quarter) AS i, count(*) OVER (PARTITION BY action) AS n FROM q) SELECT action, count(*) AS quarters, round(product(1 + x) - 1, 6) AS total FROM r WHERE n <= 4 OR (i > 1 AND i < n) GROUP BY 1""", "px", "ev"))
def g29(spark, d):
    q = ledger(spark, d).where("reason = 'ok' and exit = 5").groupBy(F.trunc("ann", "QUARTER").alias("quarter"), "action").agg((F.avg("sided_ret") / 1000).alias("x"))
    r = q.withColumn("i", F.row_number().over(Window.partitionBy("action").orderBy("x", "quarter"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("action")))
    return rounded(r.where("n <= 4 or (i > 1 and i < n)").groupBy("action").agg(F.count(F.lit(1)).alias("quarters"), (F.product(1 + F.col("x")) - 1).alias("total")), 6)


@query("r12_daily_book", sql(f""", {LEDGER}, {RET}, h AS (SELECT r.date, l.action, greatest(least(r.ret, 0.12e0), -0.12e0) AS ret FROM led l JOIN ret r ON r.ticker = l.ticker AND r.date > l.entry_date AND r.date <= l.exit_date WHERE reason = 'ok' AND "exit" = 5),
  g AS (SELECT date, avg(CASE WHEN action = 'Addition' THEN ret END) AS l, avg(CASE WHEN action = 'Removal' THEN -ret END) AS s, count(*) AS open_trades FROM h GROUP BY 1)
  SELECT d.date, round(coalesce(l, 0.025e0 / 252), 6) AS long, round(coalesce(s, 0.025e0 / 252), 6) AS short, round(CASE WHEN l IS NULL AND s IS NULL THEN 0.025e0 / 252 ELSE coalesce(l, 0) + coalesce(s, 0) END, 6) AS ls, coalesce(open_trades, 0) AS open_trades
  FROM (SELECT DISTINCT date FROM px) d LEFT JOIN g USING (date)""", "px", "ev"))
def r12(spark, d):
    return rounded(B.daily_book(ledger(spark, d), A.prices(spark, d)), 6)


@query("j18_adv_at_entry", sql(f""", {LEDGER}, v AS (SELECT ticker, date, avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS adv FROM px)
  SELECT event_id, "exit", round(adv, 4) AS adv FROM led l ASOF LEFT JOIN v ON l.ticker = v.ticker AND l.entry_date >= v.date""", "px", "ev"))
def j18(spark, d):
    return rounded(B.advs_at_entry(ledger(spark, d), A.prices(spark, d)).select("event_id", "exit", "adv"))


SIG = "sig AS (SELECT *, CASE WHEN action = 'Addition' THEN 'long' ELSE 'short' END AS side, ann AS entry_date, greatest(ann, eff) AS exit_date FROM ev)"
SIZED = f"""{SIG}, w0 AS (SELECT *, CASE WHEN side = 'short' THEN -1 ELSE 1 END * least(1.0e0 / count(*) OVER (PARTITION BY entry_date, side), 0.10e0) AS w FROM sig),
  w1 AS (SELECT * REPLACE (CASE WHEN sum(abs(w)) OVER (PARTITION BY entry_date) > 1 THEN w * 1.0e0 / sum(abs(w)) OVER (PARTITION BY entry_date) ELSE w END AS w) FROM w0),
  w2 AS (SELECT *, sum(w) OVER (PARTITION BY entry_date) AS net, count(*) OVER (PARTITION BY entry_date) AS n, count(DISTINCT side) OVER (PARTITION BY entry_date) AS sides FROM w1),
  sized AS (SELECT *, CASE WHEN sides = 2 AND abs(net) > 0.2 THEN w - (abs(net) - 0.2e0) * sign(net) / n ELSE w END AS weight FROM w2)"""


def sized(spark, d):
    return B.enforce_exposure(B.size_positions(B.signals(A.events(spark, d))))


@query("p15_17_signals", sql(f""", {SIG} SELECT event_id, side, entry_date - 5 AS entry_date, greatest(entry_date - 5, {bday_sql('eff', 5)}) AS exit_date FROM sig""", "ev"))
def p15(spark, d):
    return B.signals(A.events(spark, d), "pre_announcement", 5).select("event_id", "side", "entry_date", "exit_date")


@query("w10_w11_exposure", sql(f""", {SIZED} SELECT event_id, round(weight, 6) AS weight FROM sized""", "ev"))
def w10(spark, d):
    return rounded(sized(spark, d).select("event_id", "weight"), 6)


@query("r07_explode_positions", sql(f""", {SIZED}, p AS (SELECT event_id, CAST(unnest(generate_series(entry_date, exit_date, INTERVAL 1 DAY)) AS DATE) AS date FROM sized) SELECT event_id, date FROM p WHERE isodow(date) <= 5""", "ev"))
def r07(spark, d):
    return B.daily_positions(sized(spark, d)).select("event_id", "date")


PNL = f"""{SIZED}, {RET}, pos AS (SELECT *, CAST(unnest(generate_series(entry_date, exit_date, INTERVAL 1 DAY)) AS DATE) AS date FROM sized),
  pnl AS (SELECT p.event_id, p.side, p.weight, p.entry_date, p.exit_date, p.date, p.weight * coalesce(r.ret, 0) * 1000000 AS pnl FROM pos p LEFT JOIN ret r ON r.ticker = p.ticker AND r.date = p.date WHERE isodow(p.date) <= 5),
  bl AS (SELECT event_id, any_value(side) AS side, any_value(entry_date) AS entry_date, any_value(exit_date) AS exit_date, avg(weight) AS weight, sum(pnl) AS gross_pnl FROM pnl GROUP BY 1),
  bc AS (SELECT *, 2 * abs(weight * 1000000) * 20.5e0 * 1e-4 + CASE WHEN side = 'short' THEN abs(weight * 1000000) * (300.0e0 / 252 * 1e-4) * greatest(exit_date - entry_date, 1) ELSE 0 END AS cost FROM bl)"""


@query("g07_backtest_ledger", sql(f""", {PNL} SELECT event_id, side, round(gross_pnl, 2) AS gross_pnl, round(cost, 3) AS cost FROM bc""", "px", "ev"))
def g07(spark, d):
    led, _ = B.backtest(sized(spark, d), X.returns(A.prices(spark, d)))
    return led.select("event_id", "side", F.round("gross_pnl", 2).alias("gross_pnl") + 0.0, F.round("cost", 3).alias("cost")).toDF("event_id", "side", "gross_pnl", "cost")


@query("r08_backtest_daily", sql(f""", {PNL}, al AS (SELECT date, pnl FROM pnl UNION ALL SELECT entry_date, -cost / 2 FROM bc UNION ALL SELECT exit_date, -cost / 2 FROM bc) SELECT date, round(sum(pnl), 2) AS pnl FROM al GROUP BY 1""", "px", "ev"))
def r08(spark, d):
    _, daily = B.backtest(sized(spark, d), X.returns(A.prices(spark, d)))
    return rounded(daily.select("date", "pnl"), 2)


RULES_IN = """sup AS (SELECT l_suppkey AS s, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS size FROM lineitem GROUP BY 1), rk AS (SELECT 'S' || lpad(CAST(s AS VARCHAR), 6, '0') AS ticker, s % 5 AS grp,
  CAST(row_number() OVER (PARTITION BY s % 5 ORDER BY size DESC, s) AS INTEGER) AS fmc_rank, s % 3 = 0 AS member, s % 7 <> 0 AS liquidity_pass FROM sup)"""
DECIDED = """dec AS (SELECT *, CASE WHEN member AND NOT liquidity_pass THEN 'Removal' WHEN member AND fmc_rank > 8 THEN 'Removal' WHEN NOT member AND liquidity_pass AND fmc_rank <= 5 THEN 'Addition' ELSE 'no change' END AS action,
  CASE WHEN member AND NOT liquidity_pass THEN 'high' WHEN member AND fmc_rank > 1.05 * 8 THEN 'high' WHEN member AND fmc_rank > 8 THEN 'medium' WHEN NOT member AND liquidity_pass AND fmc_rank <= 0.95 * 5 THEN 'high' WHEN NOT member AND liquidity_pass AND fmc_rank <= 5 THEN 'medium' ELSE 'low' END AS confidence FROM rk)"""


def decided(spark, d):
    sup = A.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("size"))
    order = Window.partitionBy(F.col("s") % 5).orderBy(F.col("size").desc(), "s")
    ranked = sup.select(
        F.concat(F.lit("S"), F.lpad(F.col("s").cast("string"), 6, "0")).alias("ticker"), (F.col("s") % 5).alias("grp"), F.row_number().over(order).alias("fmc_rank"), (F.col("s") % 3 == 0).alias("member"), (F.col("s") % 7 != 0).alias("liquidity_pass")
    )
    return R.decide(ranked, 5, 8)


@query("r02_rules_decision", f"WITH {RULES_IN}, {DECIDED} SELECT ticker, grp, fmc_rank, action, confidence FROM dec")
def r02(spark, d):
    return decided(spark, d).select("ticker", "grp", "fmc_rank", "action", "confidence")


@query("r03_pairing", f"""WITH {RULES_IN}, {DECIDED}, m AS (SELECT *, action = 'Removal' AND NOT liquidity_pass AS forced, action = 'no change' AND NOT member AND liquidity_pass AS spare FROM dec),
  f AS (SELECT *, row_number() OVER (PARTITION BY grp, spare ORDER BY fmc_rank, ticker) AS place, greatest(0, sum(forced::INT) OVER (PARTITION BY grp) - sum((action = 'Addition')::INT) OVER (PARTITION BY grp)) AS needed FROM m),
  g AS (SELECT ticker, grp, fmc_rank, forced, CASE WHEN spare AND place <= needed THEN 'Addition' ELSE action END AS action, CASE WHEN spare AND place <= needed THEN 'medium' ELSE confidence END AS confidence FROM f),
  h AS (SELECT *, CASE WHEN action = 'Addition' THEN 'add' WHEN action = 'Removal' AND NOT forced THEN 'drop' ELSE 'rest' END AS side FROM g),
  i AS (SELECT *, row_number() OVER (PARTITION BY grp, side ORDER BY CASE WHEN side = 'drop' THEN -fmc_rank ELSE fmc_rank END, ticker) AS pos, least(sum((side = 'add')::INT) OVER (PARTITION BY grp), sum((side = 'drop')::INT) OVER (PARTITION BY grp)) AS pairs FROM h)
  SELECT ticker, grp, CASE WHEN side <> 'rest' AND pairs > 0 AND pos > pairs THEN 'no change' ELSE action END AS action, CASE WHEN side <> 'rest' AND pairs > 0 AND pos > pairs THEN 'borderline' ELSE confidence END AS confidence FROM i""")
def r03(spark, d):
    return R.pair(decided(spark, d), ["grp"]).select("ticker", "grp", "action", "confidence")


@query("f24_hybrid", """WITH c AS (SELECT c_custkey, c_nationkey AS g, c_acctbal AS a, CAST(c_custkey % 101 AS DOUBLE) AS b FROM customer), s AS (SELECT *, (a - min(a) OVER w) / nullif(max(a) OVER w - min(a) OVER w, 0) AS sa, (b - min(b) OVER w) / nullif(max(b) OVER w - min(b) OVER w, 0) AS sb FROM c WINDOW w AS (PARTITION BY g)),
  h AS (SELECT c_custkey, (coalesce(sa, 0.5) * 0.7e0 + coalesce(sb, 0.5) * 0.3e0) AS hybrid FROM s) SELECT c_custkey, round(hybrid, 6) AS hybrid, CASE WHEN hybrid >= 0.75 THEN 'high' WHEN hybrid >= 0.6 THEN 'medium' WHEN hybrid >= 0.45 THEN 'low' ELSE 'none' END AS bucket FROM h""")
def f24(spark, d):
    c = A.read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 101).cast("double").alias("b"))
    return rounded(R.hybrid_score(c, {"a": 0.7, "b": 0.3}, ["g"]).select("c_custkey", "hybrid", "bucket"), 6)


@query("t03_group_topk", sql(""", r AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('quarter', ann), tier, action ORDER BY (event_id * 37) % 101 DESC, event_id) AS n FROM ev) SELECT event_id, tier, action, CAST(n AS INTEGER) AS n FROM r WHERE n <= 3""", "ev"))
def t03(spark, d):
    w = Window.partitionBy(F.trunc("ann", "QUARTER"), "tier", "action").orderBy(((F.col("event_id") * 37) % 101).desc(), "event_id")
    return A.events(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("event_id", "tier", "action", "n")


@query("w15_priority_dedup", sql(""", r AS (SELECT *, row_number() OVER (PARTITION BY ticker, action, ann ORDER BY off_cycle, event_id) AS n FROM ev) SELECT ticker, action, ann, event_id FROM r WHERE n = 1""", "ev"))
def w15(spark, d):
    return E.by_priority(A.events(spark, d), ["ticker", "action", "ann"], [F.col("off_cycle"), F.col("event_id")]).select("ticker", "action", "ann", "event_id")


@query("w16_greedy_dedup", sql(""", d AS (SELECT DISTINCT ticker, action, ann FROM ev), n AS (SELECT *, row_number() OVER (PARTITION BY ticker, action ORDER BY ann) AS i FROM d), g AS (SELECT ticker, action, i, ann, ann AS last, true AS kept FROM n WHERE i = 1
  UNION ALL SELECT n.ticker, n.action, n.i, n.ann, CASE WHEN n.ann - g.last <= 7 THEN g.last ELSE n.ann END, n.ann - g.last > 7 FROM g JOIN n ON n.ticker = g.ticker AND n.action = g.action AND n.i = g.i + 1) SELECT ticker, action, ann FROM g WHERE kept""", "ev").replace("WITH ", "WITH RECURSIVE ", 1))
def w16(spark, d):
    return E.suppress_repeats(A.events(spark, d)).select("ticker", "action", "ann")


@query("g36_coverage", sql(""" SELECT ticker, count(*) AS n_events, string_agg(DISTINCT action, '|' ORDER BY action) AS actions, min(ann) AS first_ann, max(ann) AS last_ann, ticker IN (SELECT ticker FROM px) AS priced FROM ev GROUP BY 1""", "px", "ev"))
def g36(spark, d):
    return E.coverage(A.events(spark, d), A.prices(spark, d))


@query("g37_quarter_axis", sql(""", q AS (SELECT CAST(date_trunc('quarter', ann) AS DATE) AS quarter, count(*) FILTER (WHERE action = 'Addition' AND NOT off_cycle) AS additions, count(*) FILTER (WHERE action = 'Removal') AS removals, count(*) FILTER (WHERE off_cycle) AS off_cycle FROM ev GROUP BY 1),
  a AS (SELECT CAST(unnest(generate_series(min(quarter), max(quarter), INTERVAL 3 MONTH)) AS DATE) AS quarter FROM q) SELECT quarter, coalesce(additions, 0) AS additions, coalesce(removals, 0) AS removals, coalesce(off_cycle, 0) AS off_cycle,
  coalesce(additions, 0) + coalesce(removals, 0) + coalesce(off_cycle, 0) AS total FROM a LEFT JOIN q USING (quarter)""", "ev"))
def g37(spark, d):
    return E.quarter_counts(A.events(spark, d))


@query("g38_crosstab", sql(""" SELECT tier, count(*) FILTER (WHERE action = 'Addition') AS "Addition", count(*) FILTER (WHERE action = 'Removal') AS "Removal" FROM ev GROUP BY 1""", "ev"))
def g38(spark, d):
    return A.events(spark, d).groupBy("tier").pivot("action", ["Addition", "Removal"]).count().fillna(0)


@query("u06_snapshot_diff", """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot, l_partkey AS item FROM lineitem), s AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS seq FROM (SELECT DISTINCT snapshot FROM m)), h AS (SELECT seq, item FROM m JOIN s USING (snapshot))
  SELECT snapshot, item, change FROM (SELECT seq, item, 'added' AS change FROM h WHERE seq > 1 AND (seq - 1, item) NOT IN (SELECT seq, item FROM h) UNION ALL SELECT seq + 1, item, 'removed' FROM h WHERE (seq + 1, item) NOT IN (SELECT seq, item FROM h)) JOIN s USING (seq)""")
def u06(spark, d):
    members = A.read(spark, d, "lineitem").select(F.trunc("l_shipdate", "MM").alias("snapshot"), F.col("l_partkey").alias("item")).distinct()
    return E.snapshot_changes(members)


SCORED = "sc AS (SELECT doc_id, quality AS y, CAST((doc_id * 37) % 101 AS DOUBLE) / 101 AS p FROM labels)"


def scored(spark, d):
    return A.read(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 37 % 101).cast("double") / 101).alias("p"))


@query("g24_reliability", f"""WITH {SCORED}, b AS (SELECT *, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin FROM sc) SELECT CAST(r AS INTEGER) AS bin, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS observed, count(p) AS n FROM range(10) t(r) LEFT JOIN b ON b.bin = r GROUP BY 1""")
def g24(spark, d):
    b = scored(spark, d).withColumn("bin", F.least(F.floor(F.col("p") * 10).cast("int"), F.lit(9)))
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    return rounded(bins.join(b, "bin", "left").groupBy("bin").agg(F.avg("p").alias("mean_pred"), F.avg("y").alias("observed"), F.count("p").alias("n")), 6)


@query("g25_brier", f"WITH {SCORED} SELECT round(avg((p - y) * (p - y)), 8) AS brier FROM sc")
def g25(spark, d):
    return rounded(scored(spark, d).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier")), 8)


@query("g22_precision_recall", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM sc),
  r AS (SELECT *, tp / greatest(1, tp + fp) AS pr, tp / greatest(1, tp + fn) AS re FROM c) SELECT tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(1e-12, pr + re), 6) AS f1 FROM r""")
def g22(spark, d):
    c = scored(spark, d).agg(F.count_if((F.col("p") >= 0.5) & (F.col("y") == 1)).alias("tp"), F.count_if((F.col("p") >= 0.5) & (F.col("y") == 0)).alias("fp"), F.count_if((F.col("p") < 0.5) & (F.col("y") == 1)).alias("fn"))
    r = c.withColumn("precision", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")))
    return rounded(r.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-12), F.col("precision") + F.col("recall"))), 6)


@query("g48_average_precision", f"""WITH {SCORED}, s AS (SELECT p, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) / sum(n) OVER (ORDER BY p DESC) AS prec, sum(pos) OVER () AS total FROM s)
  SELECT round(sum(pos * prec) / max(total), 6) AS average_precision FROM c""")
def g48(spark, d):
    s = scored(spark, d).groupBy("p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("series", F.lit(0))
    w = Window.partitionBy("series").orderBy(F.desc("p"))
    c = s.withColumn("prec", F.sum("pos").over(w) / F.sum("n").over(w))
    return rounded(c.agg((F.sum(F.col("pos") * F.col("prec")) / F.sum("pos")).alias("average_precision")), 6)


@query("f25_tstat", sql(f""", {LEDGER} SELECT action, "exit", count(*) AS n, round(avg(sided_ret) / (stddev_samp(sided_ret) / sqrt(count(*))), 4) AS t FROM led WHERE reason = 'ok' GROUP BY 1, 2""", "px", "ev"))
def f25(spark, d):
    ok = ledger(spark, d).where("reason = 'ok'")
    return rounded(ok.groupBy("action", "exit").agg(F.count(F.lit(1)).alias("n"), (F.avg("sided_ret") / (F.stddev_samp("sided_ret") / F.sqrt(F.count(F.lit(1))))).alias("t")))


@query("f26_wilcoxon_w", sql(f""", {LEDGER}, k AS (SELECT action, round(sided_ret, 3) AS x FROM led WHERE reason = 'ok' AND "exit" = 5 AND round(sided_ret, 3) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY action ORDER BY abs(x)) + (count(*) OVER (PARTITION BY action, abs(x)) - 1) / 2.0e0 AS rk FROM k)
  SELECT action, count(*) AS n, sum(rk) FILTER (WHERE x > 0) AS w_plus, sum(rk) FILTER (WHERE x < 0) AS w_minus FROM r GROUP BY 1""", "px", "ev"))
def f26(spark, d):
    k = ledger(spark, d).where("reason = 'ok' and exit = 5").select("action", F.round("sided_ret", 3).alias("x"))
    return S.signed_ranks(k, ["action"], "x")


@query("f27_sign_counts", sql(f""", {LEDGER} SELECT action, "exit", count(*) AS n, count(*) FILTER (WHERE sided_ret > 0) AS positive FROM led WHERE reason = 'ok' GROUP BY 1, 2""", "px", "ev"))
def f27(spark, d):
    return ledger(spark, d).where("reason = 'ok'").groupBy("action", "exit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sided_ret") > 0).alias("positive"))


#: p-values by other ways than the library's: beta and error functions as series of positive terms, the sign test as a sum over its tail.
P_VALUES = """s AS (SELECT action, "exit", count(*) AS n, avg(sided_ret) AS mean, avg(sided_ret) / (stddev_samp(sided_ret) / sqrt(count(*))) AS t, count(*) FILTER (WHERE sided_ret > 0) AS pos, count(*) FILTER (WHERE sided_ret < 0) AS neg
   FROM led WHERE reason = 'ok' GROUP BY 1, 2),
  rk AS (SELECT action, "exit", sided_ret AS x, rank() OVER (PARTITION BY action, "exit" ORDER BY abs(sided_ret)) AS r, count(*) OVER (PARTITION BY action, "exit", abs(sided_ret)) AS c FROM led WHERE reason = 'ok' AND sided_ret <> 0),
  w AS (SELECT action, "exit", CAST(count(*) AS DOUBLE) AS m, sum(CASE WHEN x > 0 THEN r + (c - 1) / 2.0e0 ELSE 0 END) AS w, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM rk GROUP BY 1, 2),
  z AS (SELECT s.*, abs(w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) / sqrt(2.0e0) AS z, t * t / (n - 1 + t * t) AS x, (n - 1) / 2.0e0 AS b, least(pos, neg) AS tail, pos + neg AS signs FROM s JOIN w USING (action, "exit"))
  SELECT action, "exit", n, round(mean, 6) AS mean, round(t, 6) AS t,
   round(CASE WHEN abs(t) > 40 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 3000), lambda i: exp(lgamma(0.5e0 + b + i) - lgamma(b) - lgamma(1.5e0 + i) + (0.5e0 + i) * ln(x) + b * ln(1 - x)))) END, 6) AS t_p,
   round(CASE WHEN z > 8 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 400), lambda i: exp(-z * z + (2 * i + 1) * ln(z) - lgamma(i + 1.5e0)))) END, 6) AS wilcoxon_p,
   round(least(1.0e0, 2 * list_sum(list_transform(range(0, tail + 1), lambda i: exp(lgamma(signs + 1) - lgamma(i + 1) - lgamma(signs - i + 1) - signs * ln(2.0e0))))), 6) AS sign_p FROM z"""


@query("r27_significance", sql(f""", {LEDGER}, {P_VALUES}""", "px", "ev"))
def r27(spark, d):
    return rounded(S.significance(ledger(spark, d).where("reason = 'ok'").select("action", "exit", "sided_ret"), ["action", "exit"], "sided_ret"), 6)


RAW = "t AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN ' bhp.ax ' WHEN 1 THEN 'Bhp AU Equity' WHEN 2 THEN 'r i o.AU' WHEN 3 THEN 'x/y' WHEN 4 THEN 'BAD-TICKER!!!' ELSE 'ab' || p_size END AS raw FROM part)"


@query("f01_ticker_normalise", f"""WITH {RAW}, n AS (SELECT id, replace(replace(regexp_replace(upper(trim(raw)), '( AU EQUITY|\\.AU|\\.AX| AU)$', ''), ' ', ''), '/', '') AS s FROM t) SELECT id, CASE WHEN regexp_full_match(s, '[A-Z0-9]{{1,8}}') THEN s END AS ticker FROM n""")
def f01(spark, d):
    part = A.read(spark, d, "part")
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, " bhp.ax ").when(k == 1, "Bhp AU Equity").when(k == 2, "r i o.AU").when(k == 3, "x/y").when(k == 4, "BAD-TICKER!!!").otherwise(F.concat(F.lit("ab"), F.col("p_size").cast("string")))
    return part.select(F.col("p_partkey").alias("id"), T.normalise_ticker(raw).alias("ticker"))


@query("x01_section_carry", """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents), h AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z][^ ]* (of|de|and|the|la|le)') THEN n END AS hd FROM l),
  c AS (SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h) SELECT doc_id, section - 1 AS section, count(*) AS lines FROM c WHERE section IS NOT NULL GROUP BY 1, 2""")
def x01(spark, d):
    docs = A.read(spark, d, "documents").select("doc_id", "text")
    carried = T.carry_sections(T.lines(docs, "doc_id", "text"), "doc_id", r"^[A-Z][^ ]* (of|de|and|the|la|le)")
    return carried.where("section is not null").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"))


@query("x08_href_tally", r"""WITH h AS (SELECT unnest(regexp_extract_all(coalesce(html, ''), 'href="/([^"]*)"', 1)) AS target FROM pages) SELECT length(target) AS chars, count(*) AS n FROM h GROUP BY 1""")
def x08(spark, d):
    hrefs = A.read(spark, d, "pages").select(F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="/([^"]*)"'), F.lit(1))).alias("target"))
    return hrefs.groupBy(F.char_length("target").cast("long").alias("chars")).agg(F.count(F.lit(1)).alias("n"))


@query("f36_despace", """WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), s AS (SELECT doc_id, CASE WHEN line_no % 2 = 0 THEN regexp_replace(line, '(.)', '\\1 ', 'gs') ELSE line END AS line FROM l),
  k AS (SELECT doc_id, list_filter(string_split(line, ' '), lambda x: x <> '') AS toks FROM s) SELECT doc_id, count(*) FILTER (WHERE len(toks) >= 5 AND len(list_filter(toks, lambda x: length(x) = 1)) > 0.6 * len(toks)) AS spaced_lines FROM k GROUP BY 1""")
def f36(spark, d):
    """Lines with letter spacing per document; every other line of the input is given such spacing first."""
    rows = A.read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    line = F.when(F.col("line_no") % 2 == 0, F.regexp_replace("line", "(?s)(.)", "$1 ")).otherwise(F.col("line"))
    return rows.groupBy("doc_id").agg(F.count_if(T.is_letter_spaced(line)).alias("spaced_lines"))
