"""Queries over assembled tables: retained rows, rank panels and features, gates, tiers, forecasts, comparisons of books, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.calendar import calendar_between, rebalance_months
from driftline.operators import eventstudy as V
from driftline.operators import features as X
from driftline.operators import metrics as M
from driftline.operators import quality as Q
from driftline.operators import resampling as RS
from driftline.operators import rules as R
from driftline.operators import trading as B
from driftline.functions import stats as S
from driftline.operators.asof import latest_per_key
from driftline.plans import panel as P
from driftline.plans.more import LEAST_BOOKS, LEAST_TRADES, N_BOOT, f29, with_all
from driftline.plans.panel import A0, CAPS, RET, SMALL, asof_date, bday_sql, feature_table, rounded
from driftline.plans.study import LEDGER, ledger
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


RECONCILED = P.ORACLES["r24_reconcile"]


@query("p10_retained_rows", f'SELECT * EXCLUDE ("drop") FROM ({RECONCILED}) WHERE NOT "drop"')
def p10(spark, d):
    return Q.reconcile(*A.vendors(A.prices(spark, d))).where(~F.col("drop")).drop("drop")


@query("g05_reconciliation_counts", f"SELECT close_source, price_severity, count(*) AS n FROM ({RECONCILED}) GROUP BY 1, 2")
def g05(spark, d):
    return Q.reconcile(*A.vendors(A.prices(spark, d))).groupBy("close_source", "price_severity").agg(F.count(F.lit(1)).alias("n"))


@query("t05_head_sample", f"SELECT ticker, date, close FROM ({RECONCILED}) ORDER BY ticker, date LIMIT 50000")
def t05(spark, d):
    """The first 50,000 rows by ticker and date: the sample is the feature."""
    return Q.reconcile(*A.vendors(A.prices(spark, d))).select("ticker", "date", "close").orderBy("ticker", "date").limit(50_000)


@query("p21_later_entry_gate", sql(f""", bars AS (SELECT ticker, date, volume AS vol, close * volume AS value FROM px), fb AS (SELECT ticker, min(date) AS first_bar FROM bars GROUP BY 1),
  i AS (SELECT e.*, {bday_sql('e.ann', 1)} AS want_in FROM ev e), j AS (SELECT i.*, b.date AS bd, b.vol AS bv FROM i ASOF LEFT JOIN bars b ON i.ticker = b.ticker AND i.want_in <= b.date),
  o AS (SELECT j.*, b.date AS xd FROM j ASOF LEFT JOIN bars b ON j.ticker = b.ticker AND j.eff <= b.date),
  c AS (SELECT o.*, first_bar, CASE WHEN bd - want_in <= 10 THEN bd END AS entry_date, CASE WHEN xd - eff <= 10 THEN xd END AS exit_date FROM o LEFT JOIN fb USING (ticker)),
  t AS (SELECT c.event_id, median(b.value) AS turnover FROM c JOIN bars b ON b.ticker = c.ticker AND b.date BETWEEN c.entry_date AND c.exit_date GROUP BY 1)
  SELECT event_id, entry_date, CASE WHEN first_bar IS NULL THEN 'no_price_file' WHEN first_bar > ann + 3 THEN 'no_history_at_event' WHEN entry_date IS NULL THEN 'entry_gap' WHEN exit_date IS NULL THEN 'exit_gap'
   WHEN exit_date - entry_date <= 0 THEN 'zero_or_negative_hold' WHEN coalesce(turnover, 0) < 20000 THEN 'illiquid_or_stale' WHEN bv <= 0 THEN 'zero_volume_endpoint' ELSE 'ok' END AS reason FROM c LEFT JOIN t USING (event_id)""", "px", "ev"))
def p21(spark, d):
    return B.entry_gate(A.events(spark, d), A.prices(spark, d), least_value=20_000.0).select("event_id", "entry_date", "reason")


@query("p23_labels_for_index", sql(" SELECT event_id, ticker, action, ann, eff FROM ev WHERE tier = 'T100'", "ev"))
def p23(spark, d):
    return A.events(spark, d).where("tier = 'T100'").select("event_id", "ticker", "action", "ann", "eff")


@query("p27_substring_rows", "SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'ECO')")
def p27(spark, d):
    return A.read(spark, d, "part").where(F.contains("p_type", F.lit("ECO"))).select("p_partkey", "p_type")


POINT = f"pit AS (SELECT ticker, arg_max(float_cap, date) AS pit_fmc FROM caps WHERE date <= {A0} GROUP BY 1)"


@query("j11_average_and_point_caps", sql(f""", {CAPS}, {POINT} SELECT coalesce(f.ticker, p.ticker) AS ticker, round(avg_fmc, 2) AS avg_fmc, round(pit_fmc, 2) AS pit_fmc FROM feat f FULL JOIN pit p ON f.ticker = p.ticker""", "px", "sh", "fl"))
def j11(spark, d):
    caps = X.with_market_cap(A.prices(spark, d).select("ticker", "date", "close", "volume"), A.shares(spark, d), A.float_factors(spark, d))
    point = latest_per_key(caps.select("ticker", "date", "float_cap"), ["ticker"], "date", asof_date()).select("ticker", F.col("float_cap").alias("pit_fmc"))
    average = X.lookback(caps, asof_date(), 63).groupBy("ticker").agg(F.avg("float_cap").alias("avg_fmc"))
    return rounded(average.join(point, "ticker", "full"), 2)


RANKED = "rk AS (SELECT *, CAST(row_number() OVER (ORDER BY avg_fmc DESC NULLS LAST, mdvt DESC NULLS LAST, ticker) AS INTEGER) AS fmc_rank FROM feat)"
ADV = lambda n: f"adv{n} AS (SELECT ticker, avg(close * volume) AS adv_{n} FROM px WHERE date BETWEEN {bday_sql(A0, -n)} AND {A0} GROUP BY 1)"


def rank_panel(spark, d):
    return X.rank_universe(feature_table(spark, d).withColumn("asof", asof_date()), ["asof"])


def advs(spark, d, days: int):
    return X.value_traded(A.prices(spark, d), asof_date(), days, exact_median=False).withColumnRenamed("adv", f"adv_{days}")


@query("j13_rank_panel", sql(f""", {CAPS}, {RANKED}, {ADV(20)}, {ADV(60)}, m AS (SELECT sum(mdvt) / sum(avg_fmc) AS market FROM feat WHERE avg_fmc IS NOT NULL)
  SELECT ticker, fmc_rank, round(avg_fmc, 4) AS avg_fmc, round(mdvt, 4) AS mdvt, round(mdvt / avg_fmc / market, 4) AS relative, round(adv_20, 4) AS adv_20, round(adv_60, 4) AS adv_60 FROM rk LEFT JOIN adv20 USING (ticker) LEFT JOIN adv60 USING (ticker) CROSS JOIN m""", "px", "sh", "fl"))
def j13(spark, d):
    ranked = rank_panel(spark, d).drop("asof")
    market = ranked.where("avg_fmc is not null").agg((F.sum("mdvt") / F.sum("avg_fmc")).alias("market"))
    whole = ranked.crossJoin(F.broadcast(market)).withColumn("relative", F.col("mdvt") / F.col("avg_fmc") / F.col("market")).drop("market")  # one row
    return rounded(whole.join(advs(spark, d, 20), "ticker", "left").join(advs(spark, d, 60), "ticker", "left"), 4)


@query("j12_event_features", sql(f""", {CAPS}, {RANKED}, {ADV(20)}, {ADV(60)}, {RET}, c AS (SELECT coalesce(max(CASE WHEN fmc_rank = 10 THEN avg_fmc END), min(avg_fmc)) AS cut FROM rk),
  b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS back FROM ret WHERE date <= {A0}), g AS (SELECT ticker, max(CASE WHEN back = 0 THEN adjusted_close END) / max(CASE WHEN back = 21 THEN adjusted_close END) - 1 AS ret_21,
   max(CASE WHEN back = 0 THEN adjusted_close END) / max(CASE WHEN back = 63 THEN adjusted_close END) - 1 AS ret_63, CASE WHEN count(*) FILTER (WHERE back < 63) >= 31 THEN stddev_samp(ret) FILTER (WHERE back < 63) * sqrt(252) END AS vol FROM b GROUP BY 1)
  SELECT ticker, fmc_rank, round(avg_fmc - cut, 4) AS gap, round(ret_21, 4) AS ret_21, round(ret_63, 4) AS ret_63, round(vol, 4) AS vol, round(adv_20, 4) AS adv_20, round(adv_60, 4) AS adv_60
  FROM rk LEFT JOIN g USING (ticker) LEFT JOIN adv20 USING (ticker) LEFT JOIN adv60 USING (ticker) CROSS JOIN c""", "px", "sh", "fl"))
def j12(spark, d):
    bars = A.prices(spark, d)
    rows = X.gap_to_cutoff(rank_panel(spark, d), ["asof"], 10).select("ticker", "fmc_rank", "gap")
    for extra in (X.trailing_returns(bars, asof_date(), (21, 63)), X.trailing_volatility(bars, asof_date(), 63), advs(spark, d, 20), advs(spark, d, 60)):
        rows = rows.join(extra, "ticker", "left")
    return rounded(rows, 4)


#: Money that follows each tier, by name.
FOLLOWING = {"T50": 10e9, "T100": 15e9}


@query("j16_money_by_tier", sql(" SELECT event_id, tier, CASE tier WHEN 'T50' THEN 10e9 WHEN 'T100' THEN 15e9 END AS money, CASE tier WHEN 'T50' THEN 10e9 WHEN 'T100' THEN 15e9 END * (CASE WHEN action = 'Addition' THEN 0.002e0 ELSE 0 END - CASE WHEN action = 'Removal' THEN 0.002e0 ELSE 0 END) AS flow FROM ev", "ev"))
def j16(spark, d):
    """Weight change times the money that follows a tier; tiers without a figure have none."""
    return X.passive_flow(A.events(spark, d).withColumns({"weight": F.when(F.col("action") == "Addition", 0.002), "prior": F.when(F.col("action") == "Removal", 0.002)}), FOLLOWING, "tier").select("event_id", "tier", "money", "flow")


@query("g49_distinct_counts", sql(f""", {LEDGER} SELECT action, count(DISTINCT date_trunc('quarter', ann)) AS quarters, count(DISTINCT ticker) AS tickers, count(DISTINCT entry_date) AS entry_days FROM led WHERE reason = 'ok' GROUP BY 1""", "px", "ev"))
def g49(spark, d):
    ok = ledger(spark, d).where("reason = 'ok'")
    return ok.groupBy("action").agg(F.count_distinct(F.trunc("ann", "QUARTER")).alias("quarters"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("entry_date").alias("entry_days"))


@query("f33_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS eighths, round_even(l_quantity * 2.5, 0) AS halves FROM lineitem")
def f33(spark, d):
    """Rounding to even on values that binary numbers hold exactly."""
    return A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 8, 2).alias("eighths"), F.bround(F.col("l_quantity") * 2.5, 0).alias("halves"))


#: Fixed values, in the order in which tiers are decided: name, target count, rank up to which an outsider enters, rank
#: beyond which a member leaves (both the target where there is none), tier around it.
TIERS = [("T50", 50, None, None, "T100"), ("T100", 100, None, None, "T200"), ("T200", 200, 179, 221, "T300")]


def tier_table(spark):
    return spark.createDataFrame(TIERS, "tier string, target int, add_buffer int, del_buffer int, parent string")


TIER_SQL = "tiers(tier, target, add_buffer, del_buffer, parent) AS (VALUES ('T50', 50, NULL, NULL, 'T100'), ('T100', 100, NULL, NULL, 'T200'), ('T200', 200, 179, 221, 'T300'))"


@query("r01_tier_parameters", sql(f""", {TIER_SQL}, c AS (SELECT tier, count(*) AS events, count(DISTINCT ticker) AS tickers FROM ev GROUP BY 1)
  SELECT tier, target, coalesce(add_buffer, target) AS enters_to, coalesce(del_buffer, target) AS leaves_from, parent, events, tickers FROM c JOIN tiers USING (tier)""", "ev"))
def r01(spark, d):
    """Parameters of the tiers that events name, with the events and tickers that they apply to."""
    used = A.events(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("ticker").alias("tickers"))
    limit = lambda c: F.coalesce(F.col(c), F.col("target"))
    return used.join(F.broadcast(tier_table(spark)), "tier").select("tier", "target", limit("add_buffer").alias("enters_to"), limit("del_buffer").alias("leaves_from"), "parent", "events", "tickers")


FIRMS = """sup AS (SELECT c_custkey AS s, c_acctbal AS size FROM customer), rk AS (SELECT 'C' || lpad(CAST(s AS VARCHAR), 9, '0') AS ticker, CAST(row_number() OVER (ORDER BY size DESC NULLS LAST, s) AS INTEGER) AS fmc_rank, s % 7 <> 0 AS liquidity_pass, s FROM sup)"""


@query("r05_all_tiers", f"""WITH {FIRMS}, {TIER_SQL}, m AS (SELECT rk.*, tier, coalesce(add_buffer, target) AS add_buffer, coalesce(del_buffer, target) AS del_buffer, CASE tier WHEN 'T100' THEN 'T50' WHEN 'T200' THEN 'T100' END AS before, s % 3 = 0 AND fmc_rank <= target * 1.4 AS member FROM rk, tiers),
  dec AS (SELECT *, CASE WHEN member AND NOT liquidity_pass THEN 'Removal' WHEN member AND fmc_rank > del_buffer THEN 'Removal' WHEN NOT member AND liquidity_pass AND fmc_rank <= add_buffer THEN 'Addition' ELSE 'no change' END AS action,
   CASE WHEN member AND NOT liquidity_pass THEN 'high' WHEN member AND fmc_rank > 1.05 * del_buffer THEN 'high' WHEN member AND fmc_rank > del_buffer THEN 'medium' WHEN NOT member AND liquidity_pass AND fmc_rank <= 0.95 * add_buffer THEN 'high' WHEN NOT member AND liquidity_pass AND fmc_rank <= add_buffer THEN 'medium' ELSE 'low' END AS confidence FROM m),
  f0 AS (SELECT *, action = 'Removal' AND NOT liquidity_pass AS forced, action = 'no change' AND NOT member AND liquidity_pass AS spare FROM dec),
  f AS (SELECT *, row_number() OVER (PARTITION BY tier, spare ORDER BY fmc_rank, ticker) AS place, greatest(0, sum(forced::INT) OVER (PARTITION BY tier) - sum((action = 'Addition')::INT) OVER (PARTITION BY tier)) AS needed FROM f0),
  g AS (SELECT * REPLACE (CASE WHEN spare AND place <= needed THEN 'Addition' ELSE action END AS action, CASE WHEN spare AND place <= needed THEN 'medium' ELSE confidence END AS confidence) FROM f),
  h AS (SELECT *, CASE WHEN action = 'Addition' THEN 'add' WHEN action = 'Removal' AND NOT forced THEN 'drop' ELSE 'rest' END AS side FROM g),
  i AS (SELECT *, row_number() OVER (PARTITION BY tier, side ORDER BY CASE WHEN side = 'drop' THEN -fmc_rank ELSE fmc_rank END, ticker) AS pos, least(sum((side = 'add')::INT) OVER (PARTITION BY tier), sum((side = 'drop')::INT) OVER (PARTITION BY tier)) AS pairs FROM h)
  SELECT tier, before, ticker, fmc_rank, CASE WHEN side <> 'rest' AND pairs > 0 AND pos > pairs THEN 'no change' ELSE action END AS action, CASE WHEN side <> 'rest' AND pairs > 0 AND pos > pairs THEN 'borderline' ELSE confidence END AS confidence FROM i""")
def r05(spark, d):
    """Every tier over the whole ranked universe in one pass; ``before`` is the tier decided before, which holds all tickers by then."""
    firms = A.read(spark, d, "customer").select("c_custkey", F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("ticker"), "c_acctbal")
    ranked = X.rank_universe(firms.withColumn("one", F.lit(0)), ["one"], "c_acctbal", "c_acctbal").withColumn("liquidity_pass", F.col("c_custkey") % 7 != 0)
    # The tier table has three rows, written in this module.
    each = ranked.crossJoin(F.broadcast(tier_table(spark))).withColumn("member", (F.col("c_custkey") % 3 == 0) & (F.col("fmc_rank") <= F.col("target") * 1.4))
    before = F.element_at(F.create_map(*[F.lit(x) for a, b in zip(TIERS[1:], TIERS) for x in (a[0], b[0])]), F.col("tier"))
    decided = R.decide(each.withColumn("before", before), F.coalesce("add_buffer", "target"), F.coalesce("del_buffer", "target"))
    return R.pair(decided, ["tier"]).select("tier", "before", "ticker", "fmc_rank", "action", "confidence")


@query("r22_forecast_from_labels", sql(""" SELECT event_id, ticker, tier, action AS predicted_action, 0.8e0 AS hybrid, 0.6e0 AS flow_to_adv, 'high' AS bucket, ann, eff, CAST(date_trunc('month', ann) AS DATE) AS rebalance_month, 0.3e0 AS volatility, 'none' AS quality FROM ev WHERE tier IN ('T50', 'T100', 'T200')""", "ev"))
def r22(spark, d):
    return B.forecast_from_labels(A.events(spark, d), [t[0] for t in TIERS])


def books(spark, d, exit: int = 5):
    """(series, date, ret) of the daily book's sides, stacked; rounded, so that a return of nothing is no loss."""
    book = B.daily_book(ledger(spark, d), A.prices(spark, d), exit)
    return book.select("date", F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.round(s, 10).alias("ret")) for s in ("long", "short", "ls")])).alias("x")).select("x.series", "date", "x.ret")


def tier_indices(spark, d):
    """(series, date, ret): the mean small return of three tickers each, as tiers' benchmarks."""
    number = (F.substring("ticker", 3, 1).cast("int") % 3).cast("string")
    return P.small_returns(spark, d).where("ticker < 'N09'").groupBy(F.concat(F.lit("index "), number).alias("series"), "date").agg(F.avg("ret").alias("ret"))


BOOK = lambda exit: f"""h{exit} AS (SELECT r.date, l.action, greatest(least(r.ret, 0.12e0), -0.12e0) AS ret FROM led l JOIN ret r ON r.ticker = l.ticker AND r.date > l.entry_date AND r.date <= l.exit_date WHERE reason = 'ok' AND "exit" = {exit}),
  g{exit} AS (SELECT date, avg(CASE WHEN action = 'Addition' THEN ret END) AS l, avg(CASE WHEN action = 'Removal' THEN -ret END) AS s FROM h{exit} GROUP BY 1),
  k{exit} AS (SELECT d.date, coalesce(l, 0.025e0 / 252) AS long, coalesce(s, 0.025e0 / 252) AS short, CASE WHEN l IS NULL AND s IS NULL THEN 0.025e0 / 252 ELSE coalesce(l, 0) + coalesce(s, 0) END AS ls FROM (SELECT DISTINCT date FROM px) d LEFT JOIN g{exit} USING (date)),
  b{exit} AS (SELECT 'long' AS series, date, round(long, 10) AS ret FROM k{exit} UNION ALL SELECT 'short', date, round(short, 10) FROM k{exit} UNION ALL SELECT 'ls', date, round(ls, 10) FROM k{exit})"""  # noqa: E731
INDICES = """ti AS (SELECT 'index ' || CAST(CAST(substr(ticker, 3, 1) AS INTEGER) % 3 AS VARCHAR) AS series, date, avg(ret) AS ret FROM small WHERE ticker < 'N09' GROUP BY 1, 2)"""
TABLE = """cum AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY series ORDER BY date) AS cum FROM stacked), dd AS (SELECT *, cum / max(cum) OVER (PARTITION BY series ORDER BY date) - 1 AS drawdown FROM cum),
  mt AS (SELECT series, count(*) AS n, product(1 + coalesce(ret, 0)) AS total, stddev_samp(ret) * sqrt(252) AS vol, (avg(ret) - 0.025 / 252) * 252 AS excess, stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS downside, min(drawdown) AS mdd FROM dd GROUP BY 1)"""


@query("g46_six_way_metrics", sql(f""", {LEDGER}, {RET}, {SMALL}, {BOOK(5)}, {INDICES}, stacked AS (SELECT series, date, ret / 10 AS ret FROM b5 UNION ALL SELECT series, date, ret FROM ti WHERE ret IS NOT NULL), {TABLE}
  SELECT series, round(log2(total), 4) AS log_total, round(vol, 4) AS vol, round(excess / nullif(vol, 0), 4) AS sharpe, round(excess / nullif(downside, 0), 4) AS sortino, round(mdd, 4) AS max_drawdown FROM mt""", "px", "ev"))
def g46(spark, d):
    """Three books and three indices on the same days.  Returns of the books are divided by ten, totals are logarithms: the tables are no market."""
    stacked = books(spark, d).withColumn("ret", F.col("ret") / 10).unionByName(tier_indices(spark, d))
    return rounded(M.comparison(stacked, "ls").select("series", F.log2(F.col("total_return") + 1).alias("log_total"), "vol", "sharpe", "sortino", "max_drawdown"))


@query("g47_exit_comparison", sql(f""", {LEDGER}, {RET}, {SMALL}, {BOOK(0)}, {BOOK(10)}, {INDICES}, stacked AS (SELECT 'early ' || series AS series, date, ret / 10 AS ret FROM b0 UNION ALL SELECT 'late ' || series, date, ret / 10 FROM b10 UNION ALL SELECT series, date, ret FROM ti WHERE ret IS NOT NULL), {TABLE},
  br AS (SELECT date, (bench / lag(bench) OVER (ORDER BY date) - 1) / 10 AS bench_ret FROM bench), al AS (SELECT series, (avg(ret) - covar_samp(ret, bench_ret) / nullif(var_samp(bench_ret), 0) * avg(bench_ret)) * 252 AS alpha FROM stacked JOIN br USING (date) WHERE ret IS NOT NULL AND bench_ret IS NOT NULL AND series NOT LIKE 'index%' GROUP BY 1)
  SELECT series, round(log2(total), 4) AS log_total, round(vol, 4) AS vol, round(excess / nullif(vol, 0), 4) AS sharpe, round(mdd, 4) AS max_drawdown, round(alpha, 4) AS alpha FROM mt LEFT JOIN al USING (series)""", "px", "ev", "bench"))
def g47(spark, d):
    """Books by exit against indices; only books have an alpha."""
    early = books(spark, d, 0).withColumn("series", F.concat(F.lit("early "), "series"))
    late = books(spark, d, 10).withColumn("series", F.concat(F.lit("late "), "series"))
    own = early.unionByName(late).withColumn("ret", F.col("ret") / 10)
    bench = X.returns(A.benchmark(spark, d).withColumn("series", F.lit("bench")), "bench", "series").select("date", (F.col("ret") / 10).alias("bench_ret"))
    table = M.comparison(own.unionByName(tier_indices(spark, d)), "early ls").join(M.against_benchmark(own, bench, "series").select("series", "alpha"), "series", "left")
    return rounded(table.select("series", F.log2(F.col("total_return") + 1).alias("log_total"), "vol", "sharpe", "max_drawdown", "alpha"))


@query("h03_sharpe_table", sql(f""", {LEDGER}, {RET}, {BOOK(5)}, br AS (SELECT date, (bench / lag(bench) OVER (ORDER BY date) - 1) / 10 AS ret FROM bench), stacked AS (SELECT series, date, ret / 10 AS ret FROM b5 UNION ALL SELECT 'buy and hold', date, ret FROM br), {TABLE}
  SELECT series, round(vol, 4) AS vol, round(excess / nullif(vol, 0), 4) AS sharpe FROM mt UNION ALL SELECT 'risk-free', 0.0e0, 0.0e0""", "px", "ev", "bench"))
def h03(spark, d):
    """The books, buy and hold, and a constant risk-free row."""
    bench = X.returns(A.benchmark(spark, d).withColumn("series", F.lit("buy and hold")), "bench", "series").select("series", "date", (F.col("ret") / 10).alias("ret"))
    table = M.performance(books(spark, d).withColumn("ret", F.col("ret") / 10).unionByName(bench), "series").select("series", "vol", "sharpe")
    return rounded(table.unionByName(spark.range(1).select(F.lit("risk-free").alias("series"), F.lit(0.0).alias("vol"), F.lit(0.0).alias("sharpe"))))


VOTES = "v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 37 % 100) / 1000.0e0 END AS p_wilcoxon, (o_orderkey * 53 % 100) / 1000.0e0 AS p_sign, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey * 71 % 100) / 1000.0e0 END AS p_placebo FROM orders)"


@query("f31_robust_vote", f"""WITH {VOTES} SELECT o_orderkey, CASE WHEN p_placebo IS NOT NULL THEN p_placebo < 0.05 AND coalesce(p_wilcoxon < 0.05, false)::INT + (p_sign < 0.05)::INT + 1 >= 2 ELSE coalesce(p_wilcoxon < 0.05, false)::INT + (p_sign < 0.05)::INT >= 2 END AS robust FROM v""")
def f31(spark, d):
    k = F.col("o_orderkey")
    p = lambda m: (k * m % 100) / 1000.0
    rows = A.read(spark, d, "orders").select("o_orderkey", F.when(k % 11 != 0, p(37)).alias("p_wilcoxon"), p(53).alias("p_sign"), F.when(k % 3 != 0, p(71)).alias("p_placebo"))
    return rows.select("o_orderkey", S.robust_vote(F.col("p_wilcoxon"), F.col("p_sign"), F.col("p_placebo")).alias("robust"))


#: Windows that the placebo of abnormal returns is drawn for, and its draws.
PLACEBO_WINDOWS, N_CAR = {"p0_p1": 2, "p0_p10": 11, "p2_p10": 9}, 3_000


@query("f30_placebo_window")
def f30(spark, d):
    """Placebo p of the mean abnormal return of each window, action and cohort: 3,000 draws of random windows (no SQL twin)."""
    bars, bench, ev = A.prices(spark, d), A.benchmark(spark, d), A.events(spark, d)
    by = ["action", "off_cycle", "span"]
    cars = V.event_cars(ev, bars, bench, {s: V.WINDOWS[s] for s in PLACEBO_WINDOWS})
    stacked = cars.select("action", "off_cycle", F.explode(F.array(*[F.struct(F.lit(s).alias("span"), F.col(s).alias("car")) for s in PLACEBO_WINDOWS])).alias("x")).select("action", "off_cycle", "x.*")
    observed = stacked.where("car is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("car").alias("mean")).where(F.col("n") >= LEAST_TRADES).drop("n")
    width = F.element_at(F.create_map(*[x for s, w in PLACEBO_WINDOWS.items() for x in (F.lit(s), F.lit(w))]), F.col("span"))
    wanted = ev.join(bars.select("ticker").distinct(), "ticker", "left_semi").select("action", "off_cycle", "ticker", F.explode(F.array(*[F.lit(s) for s in PLACEBO_WINDOWS])).alias("span")).withColumn("width", width)
    null = RS.placebo_windows(wanted, V.abnormal_returns(bars, bench), by, N_CAR).where(F.col("n") >= LEAST_BOOKS)
    expected = F.when(F.col("action") == "Addition", 1.0).otherwise(-1.0)
    return RS.placebo_p(null.select(*by, "replicate", (F.col("total") / F.col("n")).alias("mean")), observed, by, expected)


@query("r27_full_suite")
def r27(spark, d):
    """Tests, bootstrap interval, placebo p and vote for every tier (or ALL), action and exit (no SQL twin; the parts have theirs or brute-force tests)."""
    by = ["tier", "action", "exit"]
    ok = with_all(ledger(spark, d).where("reason = 'ok'").select(*by, "event_id", "sided_ret"))
    tests = S.significance(ok, by, "sided_ret").where(F.col("n") >= LEAST_TRADES)
    interval = RS.bootstrap_interval(RS.blocked_bootstrap_means(ok, by, "sided_ret", "event_id", N_BOOT, LEAST_TRADES), by)
    whole = tests.join(interval, by, "left").join(f29(spark, d).select(*by, F.col("p").alias("p_placebo")), by, "left")
    return whole.withColumn("robust", S.robust_vote(F.col("wilcoxon_p"), F.col("sign_p"), F.col("p_placebo"))).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


#: Frequencies of the calendar query, by name.
FREQUENCIES = {"T50": "annual", "T100": "semi-annual", "T200": "quarterly"}


@query("f06_r06_index_windows", sql(""", o AS (SELECT tier, min(ann) AS a, max(eff) AS b FROM ev GROUP BY 1), m AS (SELECT tier, a, b, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS month FROM o),
  f AS (SELECT *, month + CAST((5 - isodow(month) + 7) % 7 AS INTEGER) AS ff FROM m), i(tier, months) AS (VALUES ('T200', [3, 6, 9, 12]), ('T100', [3, 9]), ('T50', [6])),
  w AS (SELECT tier, month, ff AS announcement, ff + 14 AS effective FROM f JOIN i USING (tier) WHERE list_contains(months, month(month)) AND ff + 14 BETWEEN a AND b)
  SELECT w.tier AS index, month, announcement, effective, count(event_id) AS events FROM w LEFT JOIN ev ON ev.tier = w.tier AND ev.ann >= announcement AND ev.ann < effective GROUP BY 1, 2, 3, 4""", "ev"))
def f06(spark, d):
    """Windows of each tier over the days that its own events cover, with the events announced inside each window."""
    ev, out = A.events(spark, d).select("event_id", "tier", "ann", "eff"), None
    for index, frequency in FREQUENCIES.items():
        own = calendar_between(ev.where(F.col("tier") == index).agg(F.min("ann").alias("a"), F.max("eff").alias("b")), rebalance_months(frequency)).select(F.lit(index).alias("index"), "month", "announcement", "effective")
        out = own if out is None else out.unionByName(own)
    days = out.select("*", F.explode(F.sequence("announcement", F.date_sub("effective", 1))).alias("ann"))
    told = ev.groupBy(F.col("tier").alias("index"), "ann").agg(F.count(F.lit(1)).alias("n"))
    return days.join(told, ["index", "ann"], "left").groupBy("index", "month", "announcement", "effective").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"))
