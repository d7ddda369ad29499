"""Queries over the price panel: sources, vendors, as-of joins, features, ranks, returns and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions.calendar import bday_add, calendar_between, nth_weekday
from driftline.functions.costs import impact_bps, study_cost_bps
from driftline.operators import features as X
from driftline.operators import metrics as M
from driftline.operators import quality as Q
from driftline.operators.asof import asof_backward, latest_per_key
from driftline.sources import adapters as A
from driftline.sources.adapters import sql

ASOF = "1996-06-28"
QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df, digits: int = 4, **only):
    """Doubles rounded for comparison across engines; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def asof_date():
    return F.lit(ASOF).cast("date")


def bday_sql(d: str, n: int) -> str:
    w = f"CAST(isodow({d}) - 1 AS INTEGER)"
    if n > 0:
        return f"CAST({d} - {w} + 7 * CAST(floor((least({w}, 4) + {n}) / 5) AS INTEGER) + CAST((least({w}, 4) + {n}) % 5 AS INTEGER) AS DATE)"
    base = f"(CASE WHEN {w} > 4 THEN {d} - {w} + 7 ELSE {d} - {w} END)"
    day = f"(CASE WHEN {w} > 4 THEN 0 ELSE {w} END)"
    return f"CAST({base} + 7 * CAST(floor(({day} + {n}) / 5.0) AS INTEGER) + CAST(((({day} + {n}) % 5) + 5) % 5 AS INTEGER) AS DATE)"


A0 = f"DATE '{ASOF}'"
SEV = lambda d, lo, me, hi: f"CASE WHEN {d} IS NULL THEN 'missing' WHEN {d} >= {hi} THEN 'high' WHEN {d} >= {me} THEN 'medium' WHEN {d} >= {lo} THEN 'low' ELSE 'none' END"
PCT = lambda a, b: f"(CASE WHEN greatest(abs({a}), abs({b})) > 0 THEN 100 * abs({a} - {b}) / greatest(abs({a}), abs({b})) END)"


@query("s16_price_priority_union", sql(""" SELECT ticker, date, close, source FROM (
  SELECT ticker, date, close, 'a' AS source FROM va UNION ALL SELECT ticker, date, close, 'b' FROM vb b WHERE NOT EXISTS (SELECT 1 FROM va a WHERE a.ticker = b.ticker AND a.date = b.date))""", "px", "va", "vb"))
def s16(spark, d):
    a, b = A.vendors(A.prices(spark, d))
    rest = b.join(a.select("ticker", "date"), ["ticker", "date"], "left_anti")
    return a.select("ticker", "date", "close", F.lit("a").alias("source")).unionByName(rest.select("ticker", "date", "close", F.lit("b").alias("source")))


@query("p01_severity", sql(f""" SELECT ps AS price_severity, vs AS volume_severity, count(*) AS n FROM (
  SELECT {SEV(PCT('a.close', 'b.close'), 0.5, 2, 5)} AS ps, {SEV(PCT('a.volume', 'b.volume'), 10, 25, 50)} AS vs FROM va a FULL JOIN vb b ON a.ticker = b.ticker AND a.date = b.date) GROUP BY 1, 2""", "px", "va", "vb"))
def p01(spark, d):
    both = Q.compare_vendors(*A.vendors(A.prices(spark, d)), ["close", "volume"])
    t = Q.Thresholds()
    return both.groupBy(
        Q.severity(Q.percent_difference(F.col("close_a"), F.col("close_b")), t.price).alias("price_severity"), Q.severity(Q.percent_difference(F.col("volume_a"), F.col("volume_b")), t.volume).alias("volume_severity")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("j01_vendor_full_outer", sql(""" SELECT coalesce(a.ticker, b.ticker) AS ticker, count(*) AS n, count(a.ticker) AS in_a, count(b.ticker) AS in_b, round(sum(coalesce(a.volume, b.volume)), 2) AS volume
  FROM va a FULL JOIN vb b ON a.ticker = b.ticker AND a.date = b.date GROUP BY 1""", "px", "va", "vb"))
def j01(spark, d):
    both = Q.compare_vendors(*A.vendors(A.prices(spark, d)), ["volume"])
    return rounded(both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_a").alias("in_a"), F.count_if("in_b").alias("in_b"), F.sum(F.coalesce("volume_a", "volume_b")).alias("volume")), 2)


@query("j02_missing_side", sql(""" SELECT ticker, date, 'b' AS missing_from FROM va a WHERE NOT EXISTS (SELECT 1 FROM vb b WHERE a.ticker = b.ticker AND a.date = b.date)
  UNION ALL SELECT ticker, date, 'a' FROM vb b WHERE NOT EXISTS (SELECT 1 FROM va a WHERE a.ticker = b.ticker AND a.date = b.date)""", "px", "va", "vb"))
def j02(spark, d):
    return Q.missing_sides(*A.vendors(A.prices(spark, d)))


@query("j04_ratio_mismatch", sql(""", vc AS (SELECT * REPLACE (CASE WHEN day(date) % 7 = 0 THEN adjusted_close * 1.03 ELSE adjusted_close END AS adjusted_close) FROM vb)
  SELECT a.ticker, a.date, round(abs(a.adjusted_close / a.close - c.adjusted_close / c.close), 4) AS ratio_diff FROM va a JOIN vc c ON a.ticker = c.ticker AND a.date = c.date
  WHERE abs(a.adjusted_close / a.close - c.adjusted_close / c.close) > 0.01""", "px", "va", "vb"))
def j04(spark, d):
    a, b = A.vendors(A.prices(spark, d))
    moved = b.withColumn("adjusted_close", F.when(F.dayofmonth("date") % 7 == 0, F.col("adjusted_close") * 1.03).otherwise(F.col("adjusted_close")))
    return rounded(Q.ratio_mismatches(a, moved))


@query("r23_quality_report", sql(f""", m AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.date, b.date) AS date, a.ticker IS NOT NULL AS ia, b.ticker IS NOT NULL AS ib,
   a.close AS ca, b.close AS cb, a.adjusted_close AS aa, b.adjusted_close AS ab, a.volume AS wa, b.volume AS wb FROM va a FULL JOIN vb b ON a.ticker = b.ticker AND a.date = b.date),
  s AS (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM va),
  i AS (SELECT *, sum(CASE WHEN close = pc THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS island FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY ticker, island ORDER BY date) AS run FROM i),
  x AS (SELECT 'close' AS "check", {SEV(PCT('ca', 'cb'), 0.5, 2, 5)} AS severity FROM m UNION ALL SELECT 'adjusted_close', {SEV(PCT('aa', 'ab'), 0.5, 2, 5)} FROM m UNION ALL SELECT 'volume', {SEV(PCT('wa', 'wb'), 10, 25, 50)} FROM m
   UNION ALL SELECT 'missing', CASE WHEN ia THEN 'b' ELSE 'a' END FROM m WHERE ia <> ib UNION ALL SELECT 'ratio', 'high' FROM m WHERE ia AND ib AND abs(aa / ca - ab / cb) > 0.01
   UNION ALL SELECT 'stale', 'medium' FROM r WHERE run >= 5 UNION ALL SELECT 'jump', 'high' FROM s WHERE abs((close / pc - 1) * 100) >= 25)
  SELECT "check", severity, count(*) AS n FROM x WHERE severity <> 'none' GROUP BY 1, 2""", "px", "va", "vb"))
def r23(spark, d):
    return Q.quality_report(*A.vendors(A.prices(spark, d)))


_W = lambda s: f"(CASE {s} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'missing' THEN 2 WHEN 'high' THEN 3 ELSE 0 END)"


@query("r24_reconcile", sql(f""", m AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.date, b.date) AS date, a.close AS ca, b.close AS cb, a.adjusted_close AS aa, b.adjusted_close AS ab, a.volume AS wa, b.volume AS wb,
   a.open AS oa, b.open AS ob, a.high AS ha, b.high AS hb, a.low AS la, b.low AS lb, {SEV(PCT('a.close', 'b.close'), 0.5, 2, 5)} AS cs, {SEV(PCT('a.adjusted_close', 'b.adjusted_close'), 0.5, 2, 5)} AS asv, {SEV(PCT('a.volume', 'b.volume'), 10, 25, 50)} AS vs
   FROM va a FULL JOIN vb b ON a.ticker = b.ticker AND a.date = b.date),
  n AS (SELECT *, CASE WHEN {_W('asv')} > {_W('cs')} THEN asv ELSE cs END AS ps, CASE WHEN ca IS NOT NULL THEN 'a' WHEN cb IS NOT NULL THEN 'b' END AS close_source FROM m)
  SELECT ticker, date, CASE WHEN coalesce(close_source, 'a') = 'a' THEN oa ELSE ob END AS open, CASE WHEN coalesce(close_source, 'a') = 'a' THEN ha ELSE hb END AS high,
   CASE WHEN coalesce(close_source, 'a') = 'a' THEN la ELSE lb END AS low, coalesce(ca, cb) AS close, coalesce(ab, aa) AS adjusted_close, coalesce(wa, wb) AS volume, close_source,
   CASE WHEN ab IS NOT NULL THEN 'b' WHEN aa IS NOT NULL THEN 'a' END AS adjusted_source, CASE WHEN wa IS NOT NULL THEN 'a' WHEN wb IS NOT NULL THEN 'b' END AS volume_source, ps AS price_severity, vs AS volume_severity,
   'close:' || CASE WHEN ca IS NOT NULL THEN 'preferred' WHEN cb IS NOT NULL THEN 'fallback' ELSE 'missing' END || '; volume:' || CASE WHEN wa IS NOT NULL THEN 'preferred' WHEN wb IS NOT NULL THEN 'fallback' ELSE 'missing' END
   || '; price_sev:' || ps || '; volume_sev:' || vs AS notes, {_W('ps')} >= 3 OR {_W('vs')} >= 3 AS "drop" FROM n""", "px", "va", "vb"))
def r24(spark, d):
    return Q.reconcile(*A.vendors(A.prices(spark, d)))


@query("w03_stale_runs", """WITH b AS (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, max(round(l_discount, 1)) AS close FROM lineitem GROUP BY 1, 2),
  s AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM b), i AS (SELECT *, sum(CASE WHEN close = pc THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS island FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY ticker, island ORDER BY date) AS stale_run FROM i) SELECT ticker, date, close, stale_run FROM r WHERE stale_run >= 3""")
def w03(spark, d):
    items = A.read(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.max(F.round("l_discount", 1)).alias("close"))
    return Q.stale_runs(items, least=3)


@query("w04_jumps", sql(""", s AS (SELECT ticker, date, (close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS jump_pct FROM px) SELECT ticker, date, round(jump_pct, 4) AS jump_pct FROM s WHERE abs(jump_pct) >= 25""", "px"))
def w04(spark, d):
    return rounded(Q.jumps(A.prices(spark, d)))


@query("j05_asof_shares", sql(""" SELECT p.ticker, p.date, s.shares, p.close * s.shares AS market_cap FROM px p ASOF LEFT JOIN sh s ON p.ticker = s.ticker AND p.date >= s.date""", "px", "sh"))
def j05(spark, d):
    out = asof_backward(A.prices(spark, d).select("ticker", "date", "close"), A.shares(spark, d), ["ticker"], "date", "date", ["shares"])
    return out.select("ticker", "date", "shares", (F.col("close") * F.col("shares")).alias("market_cap"))


@query("j06_asof_float_default", sql(""" SELECT p.ticker, p.date, round(coalesce(f.iwf, 1.0), 4) AS iwf FROM px p ASOF LEFT JOIN fl f ON p.ticker = f.ticker AND p.date >= f.date""", "px", "fl"))
def j06(spark, d):
    out = asof_backward(A.prices(spark, d).select("ticker", "date"), A.float_factors(spark, d), ["ticker"], "date", "date", ["iwf"])
    return rounded(out.select("ticker", "date", F.coalesce("iwf", F.lit(1.0)).alias("iwf")))


@query("j07_latest_per_key", sql(f""", r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM sh WHERE date <= {A0}) SELECT ticker, date, shares FROM r WHERE n = 1""", "sh"))
def j07(spark, d):
    return latest_per_key(A.shares(spark, d), ["ticker"], "date", asof_date())


@query("j08_latest_snapshot", sql(f""" SELECT ticker, date, round(iwf, 4) AS iwf FROM fl WHERE date = (SELECT max(date) FROM fl WHERE date <= {A0})""", "fl"))
def j08(spark, d):
    rows = A.float_factors(spark, d).where(F.col("date") <= asof_date())
    return rounded(rows.join(rows.agg(F.max("date").alias("date")), "date").select("ticker", "date", "iwf"))


@query("f19_value_traded", sql(""" SELECT ticker, date, close * volume AS value FROM px""", "px"))
def f19(spark, d):
    return A.prices(spark, d).select("ticker", "date", (F.col("close") * F.col("volume")).alias("value"))


@query("g01_median_value_traded", sql(f""" SELECT ticker, round(median(close * volume), 4) AS mdvt FROM px WHERE date BETWEEN {bday_sql(A0, -63)} AND {A0} GROUP BY 1""", "px"))
def g01(spark, d):
    return rounded(X.value_traded(A.prices(spark, d), asof_date(), 63))


@query("g02_adv", sql(f""" SELECT ticker, round(avg(close * volume), 4) AS adv FROM px WHERE date BETWEEN {bday_sql(A0, -20)} AND {A0} GROUP BY 1""", "px"))
def g02(spark, d):
    return rounded(X.value_traded(A.prices(spark, d), asof_date(), 20, exact_median=False))


CAPS = f"""caps AS (SELECT p.ticker, p.date, p.close, p.volume, p.close * s.shares AS market_cap, p.close * s.shares * coalesce(f.iwf, 1.0) AS float_cap FROM px p ASOF LEFT JOIN sh s ON p.ticker = s.ticker AND p.date >= s.date ASOF LEFT JOIN fl f ON p.ticker = f.ticker AND p.date >= f.date),
  feat AS (SELECT ticker, avg(float_cap) AS avg_fmc, median(close * volume) AS mdvt FROM caps WHERE date BETWEEN {bday_sql(A0, -63)} AND {A0} GROUP BY 1)"""


def feature_table(spark, d):
    caps = X.with_market_cap(A.prices(spark, d).select("ticker", "date", "close", "volume"), A.shares(spark, d), A.float_factors(spark, d))
    return X.lookback(caps, asof_date(), 63).groupBy("ticker").agg(F.avg("float_cap").alias("avg_fmc"), F.median(F.col("close") * F.col("volume")).alias("mdvt"))


@query("g03_avg_float_cap", sql(f""", {CAPS} SELECT ticker, round(avg_fmc, 2) AS avg_fmc, round(mdvt, 2) AS mdvt FROM feat""", "px", "sh", "fl"))
def g03(spark, d):
    return rounded(feature_table(spark, d), 2)


@query("g04_market_liquidity", sql(f""", {CAPS} SELECT round(CASE WHEN sum(avg_fmc) > 0 THEN sum(coalesce(mdvt / avg_fmc, 0) * coalesce(avg_fmc, 0)) / sum(coalesce(avg_fmc, 0)) END, 10) AS market_liquidity FROM feat""", "px", "sh", "fl"))
def g04(spark, d):
    ratio = F.coalesce(F.try_divide("mdvt", "avg_fmc"), F.lit(0.0)) * F.coalesce("avg_fmc", F.lit(0.0))
    return rounded(feature_table(spark, d).agg(F.when(F.sum("avg_fmc") > 0, F.sum(ratio) / F.sum("avg_fmc")).alias("market_liquidity")), 10)


@query("f20_liquidity_pass", sql(f""", {CAPS}, m AS (SELECT sum(mdvt) / sum(avg_fmc) AS market FROM feat WHERE avg_fmc IS NOT NULL)
  SELECT ticker, round(mdvt / avg_fmc / market, 6) AS relative, coalesce(mdvt / avg_fmc / market >= 0.5 AND mdvt >= 250000, false) AS liquidity_pass FROM feat, m""", "px", "sh", "fl"))
def f20(spark, d):
    feat = feature_table(spark, d)
    market = feat.where("avg_fmc is not null").agg((F.sum("mdvt") / F.sum("avg_fmc")).alias("market"))
    rel = feat.crossJoin(F.broadcast(market)).withColumn("relative", F.col("mdvt") / F.col("avg_fmc") / F.col("market"))  # one row
    return rounded(rel.select("ticker", "relative", F.coalesce((F.col("relative") >= 0.5) & (F.col("mdvt") >= 250_000), F.lit(False)).alias("liquidity_pass")), 6)


@query("w05_rank", sql(f""", {CAPS} SELECT ticker, round(avg_fmc, 2) AS avg_fmc, round(mdvt, 2) AS mdvt, CAST(row_number() OVER (ORDER BY avg_fmc DESC NULLS LAST, mdvt DESC NULLS LAST, ticker) AS INTEGER) AS fmc_rank FROM feat""", "px", "sh", "fl"))
def w05(spark, d):
    return rounded(X.rank_universe(feature_table(spark, d).withColumn("asof", asof_date()), ["asof"]).drop("asof"), 2)


@query("w09_cutoff_gap", sql(f""", {CAPS}, r AS (SELECT *, row_number() OVER (ORDER BY avg_fmc DESC NULLS LAST, mdvt DESC NULLS LAST, ticker) AS n FROM feat), c AS (SELECT coalesce(max(CASE WHEN n = 10 THEN avg_fmc END), min(avg_fmc)) AS cut FROM r)
  SELECT ticker, round(avg_fmc - cut, 2) AS gap FROM r, c""", "px", "sh", "fl"))
def w09(spark, d):
    ranked = X.rank_universe(feature_table(spark, d).withColumn("asof", asof_date()), ["asof"])
    return rounded(X.gap_to_cutoff(ranked, ["asof"], 10).select("ticker", "gap"), 2)


@query("t02_topn", sql(f""", {CAPS} SELECT ticker, round(avg_fmc / sum(avg_fmc) OVER (), 8) AS weight FROM (SELECT * FROM feat ORDER BY avg_fmc DESC NULLS LAST, ticker LIMIT 10)""", "px", "sh", "fl"))
def t02(spark, d):
    top = feature_table(spark, d).orderBy(F.col("avg_fmc").desc_nulls_last(), "ticker").limit(10)
    return rounded(top.select("ticker", (F.col("avg_fmc") / F.sum("avg_fmc").over(Window.partitionBy())).alias("weight")), 8)


RET = "ret AS (SELECT ticker, date, adjusted_close, close, volume, adjusted_close / lag(adjusted_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM px)"


@query("w02_returns", sql(f""", {RET} SELECT ticker, date, round(ret, 8) AS ret FROM ret""", "px"))
def w02(spark, d):
    return rounded(X.returns(A.prices(spark, d)).select("ticker", "date", "ret"), 8)


@query("w06_trailing_returns", sql(f""", b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS back FROM px WHERE date <= {A0}), g AS (SELECT ticker, max(CASE WHEN back = 0 THEN adjusted_close END) AS p0,
  max(CASE WHEN back = 21 THEN adjusted_close END) AS p21, max(CASE WHEN back = 63 THEN adjusted_close END) AS p63, max(CASE WHEN back = 1000 THEN adjusted_close END) AS p1000 FROM b GROUP BY 1)
  SELECT ticker, round(p0 / p21 - 1, 6) AS ret_21, round(p0 / p63 - 1, 6) AS ret_63, round(p0 / p1000 - 1, 6) AS ret_1000 FROM g""", "px"))
def w06(spark, d):
    return rounded(X.trailing_returns(A.prices(spark, d), asof_date(), (21, 63, 1000)), 6)


@query("w07_trailing_vol", sql(f""", b AS (SELECT ticker, date, adjusted_close / lag(adjusted_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM px WHERE date <= {A0})
  SELECT ticker, round(CASE WHEN count(*) >= 31 THEN stddev_samp(ret) * sqrt(252) END, 6) AS vol FROM b WHERE back <= 63 GROUP BY 1""", "px"))
def w07(spark, d):
    return rounded(X.trailing_volatility(A.prices(spark, d), asof_date(), 63), 6)


SMALL = "small AS (SELECT ticker, date, ret / 1000 AS ret FROM ret)"


def small_returns(spark, d):
    """The panel's returns scaled to the size of daily returns."""
    return X.returns(A.prices(spark, d)).select("ticker", "date", (F.col("ret") / 1000).alias("ret"))


CUM = "cum AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY ticker ORDER BY date) AS cum FROM small), dd AS (SELECT *, cum / max(cum) OVER (PARTITION BY ticker ORDER BY date) - 1 AS drawdown FROM cum)"


@query("w01_cumprod_drawdown", sql(f""", {RET}, {SMALL}, {CUM} SELECT ticker, date, round(cum, 6) AS cum, round(drawdown, 6) AS drawdown FROM dd""", "px"))
def w01(spark, d):
    return rounded(M.with_drawdown(small_returns(spark, d)).select("ticker", "date", "cum", "drawdown"), 6)


@query("g10_19_performance", sql(f""", {RET}, {SMALL}, {CUM}, f AS (SELECT ticker, count(*) AS n, product(1 + coalesce(ret, 0)) AS total, stddev_samp(ret) * sqrt(252) AS vol, (avg(ret) - 0.025 / 252) * 252 AS excess,
  stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS downside, min(drawdown) AS mdd, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS hit FROM dd GROUP BY 1)
  SELECT ticker, n, round(pow(total, 252.0 / n) - 1, 6) AS cagr, round(vol, 6) AS vol, round(excess / nullif(vol, 0), 6) AS sharpe, round(excess / nullif(downside, 0), 6) AS sortino, round(mdd, 6) AS max_drawdown,
  round((pow(total, 252.0 / n) - 1) / abs(nullif(mdd, 0)), 6) AS calmar, round(hit, 6) AS hit_rate FROM f""", "px"))
def g10(spark, d):
    return rounded(M.performance(small_returns(spark, d)), 6)


@query("g17_beta_alpha", sql(f""", {RET}, br AS (SELECT date, bench / lag(bench) OVER (ORDER BY date) - 1 AS bench_ret FROM bench), j AS (SELECT ticker, ret, bench_ret, ret - bench_ret AS diff FROM ret JOIN br USING (date) WHERE ret IS NOT NULL AND bench_ret IS NOT NULL)
  SELECT ticker, round(covar_samp(ret, bench_ret) / nullif(var_samp(bench_ret), 0), 6) AS beta, round((avg(ret) - covar_samp(ret, bench_ret) / nullif(var_samp(bench_ret), 0) * avg(bench_ret)) * 252, 6) AS alpha,
  round(stddev_samp(diff) * sqrt(252), 6) AS tracking_error, round(avg(diff) * 252 / (nullif(stddev_samp(diff), 0) * sqrt(252)), 6) AS information_ratio FROM j GROUP BY 1""", "px", "bench"))
def g17(spark, d):
    bench = A.benchmark(spark, d).withColumn("series", F.lit("bench"))
    bench = X.returns(bench, "bench", "series").select("date", F.col("ret").alias("bench_ret"))
    return rounded(M.against_benchmark(X.returns(A.prices(spark, d)).select("ticker", "date", "ret"), bench), 6)


@query("g20_monthly_returns", sql(f""", {RET}, {SMALL}, m AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, product(1 + coalesce(ret, 0)) - 1 AS ret FROM small GROUP BY 1, 2),
  s AS (SELECT ticker, min(month) AS a, max(month) AS b FROM m GROUP BY 1), x AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM s)
  SELECT ticker, month, round(coalesce(m.ret, 0), 6) AS ret FROM x LEFT JOIN m USING (ticker, month)""", "px"))
def g20(spark, d):
    return rounded(M.monthly(small_returns(spark, d)), 6)


@query("w13_rolling", sql(f""", {RET}, {SMALL}, r AS (SELECT ticker, date, count(ret) OVER w AS c, product(1 + ret) OVER w - 1 AS p, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s FROM small WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT ticker, date, round(CASE WHEN c = 20 THEN p END, 6) AS roll_ret, round(CASE WHEN c = 20 AND s > 0 THEN m / s * sqrt(252) END, 4) AS roll_sharpe FROM r""", "px"))
def w13(spark, d):
    out = M.rolling(small_returns(spark, d), 20)
    return out.select("ticker", "date", (F.round("roll_ret", 6) + 0.0).alias("roll_ret"), (F.round("roll_sharpe", 4) + 0.0).alias("roll_sharpe"))


@query("w19_winsorise", sql(f""", {RET} SELECT ticker, round(sum(CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.12e0), 0.12e0) END), 4) AS total, count(*) FILTER (WHERE abs(ret) > 0.12) AS clipped FROM ret GROUP BY 1""", "px"))
def w19(spark, d):
    clip = F.least(F.greatest(F.when(F.col("ret").isNotNull(), F.col("ret")), F.lit(-0.12)), F.lit(0.12))
    return rounded(X.returns(A.prices(spark, d)).groupBy("ticker").agg(F.sum(F.when(F.col("ret").isNotNull(), clip)).alias("total"), F.count_if(F.abs("ret") > 0.12).alias("clipped")))


@query("w22_rebase", sql(""" SELECT ticker, date, round(adjusted_close / first_value(adjusted_close) OVER (PARTITION BY ticker ORDER BY date), 6) AS rebased FROM px""", "px"))
def w22(spark, d):
    first = F.first("adjusted_close").over(Window.partitionBy("ticker").orderBy("date"))
    return rounded(A.prices(spark, d).select("ticker", "date", (F.col("adjusted_close") / first).alias("rebased")), 6)


@query("g31_robust_endpoints", sql(""", r AS (SELECT ticker, adjusted_close AS p, row_number() OVER (PARTITION BY ticker ORDER BY date) AS a, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS z FROM px)
  SELECT ticker, round(CASE WHEN count(*) >= 10 THEN median(p) FILTER (WHERE z <= 5) / median(p) FILTER (WHERE a <= 5) - 1 END, 6) AS total_return FROM r GROUP BY 1""", "px"))
def g31(spark, d):
    r = A.prices(spark, d).select("ticker", F.col("adjusted_close").alias("p"), F.row_number().over(Window.partitionBy("ticker").orderBy("date")).alias("a"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("z"))
    end = F.median(F.when(F.col("z") <= 5, F.col("p"))) / F.median(F.when(F.col("a") <= 5, F.col("p"))) - 1
    return rounded(r.groupBy("ticker").agg(F.when(F.count(F.lit(1)) >= 10, end).alias("total_return")), 6)


@query("g32_endpoint_return", sql(""" SELECT ticker, round(CASE WHEN count(*) >= 2 THEN arg_max(adjusted_close, date) / arg_min(adjusted_close, date) - 1 END, 6) AS total_return FROM px GROUP BY 1""", "px"))
def g32(spark, d):
    end = F.max_by("adjusted_close", "date") / F.min_by("adjusted_close", "date") - 1
    return rounded(A.prices(spark, d).groupBy("ticker").agg(F.when(F.count(F.lit(1)) >= 2, end).alias("total_return")), 6)


@query("w20_qcut_terciles", sql(""", v AS (SELECT ticker, avg(close * volume) AS x FROM px GROUP BY 1), q AS (SELECT quantile_cont(x, 1.0 / 3) AS a, quantile_cont(x, 2.0 / 3) AS b FROM v) SELECT ticker, CASE WHEN x <= a THEN 'low' WHEN x <= b THEN 'mid' ELSE 'high' END AS bucket FROM v, q""", "px"))
def w20(spark, d):
    return X.terciles(A.prices(spark, d).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("x")), "x").select("ticker", "bucket")


@query("f04_nth_weekday", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) AS DATE) + CAST((5 - isodow(date_trunc('month', o_orderdate)) + 7) % 7 + 14 AS INTEGER) AS third_friday FROM orders")
def f04(spark, d):
    months = A.read(spark, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).distinct()
    return months.select("month", nth_weekday(F.col("month"), "FRI", 3).alias("third_friday"))


@query("f07_calendar", """WITH o AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
  m AS (SELECT a, b, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS month FROM o), f AS (SELECT *, month + CAST((5 - isodow(month) + 7) % 7 AS INTEGER) AS ff FROM m WHERE month(month) IN (3, 6, 9, 12))
  SELECT month, ff AS announcement, ff + 14 AS effective, ff - 14 AS reference FROM f WHERE ff + 14 BETWEEN a AND b""")
def f07(spark, d):
    """The calendar of the days that the orders cover."""
    day = F.to_date("o_orderdate")
    return calendar_between(A.read(spark, d, "orders").agg(F.min(day).alias("a"), F.max(day).alias("b")))


@query("f09_bday", f"""WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT d, {bday_sql('d', 1)} AS p1, {bday_sql('d', 10)} AS p10, {bday_sql('d', 0)} AS p0, {bday_sql('d', -1)} AS m1, {bday_sql('d', -63)} AS m63 FROM e""")
def f09(spark, d):
    days = A.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select("d", *[bday_add(F.col("d"), n).alias(name) for name, n in (("p1", 1), ("p10", 10), ("p0", 0), ("m1", -1), ("m63", -63))])


@query("f11_impact", sql(""" SELECT ticker, date, round(CASE WHEN close * volume > 0 THEN 0.10 * pow(10000.0 / (close * volume), 0.5) * 10000 ELSE 0 END, 6) AS impact_bps FROM px""", "px"))
def f11(spark, d):
    return rounded(A.prices(spark, d).select("ticker", "date", impact_bps(F.lit(10_000.0), F.col("close") * F.col("volume")).alias("impact_bps")), 6)


@query("f15_friction", sql(""", v AS (SELECT ticker, date, close * volume AS adv, k FROM px) SELECT ticker, date, """ + ", ".join(f"round(41 + CASE WHEN k % 2 = 0 THEN 300.0 * k / 365 ELSE 0 END + 2 * 0.10 * 0.03 * sqrt({c}.0 / adv) * 10000, 6) AS cost_{c // 1000}k" for c in (250_000, 500_000, 1_000_000)) + " FROM v", "px"))
def f15(spark, d):
    v = A.prices(spark, d).withColumn("adv", F.col("close") * F.col("volume"))
    cost = lambda c: study_cost_bps(F.lit(0.03), F.col("adv"), float(c), F.col("k"), F.col("k") % 2 == 0)
    return rounded(v.select("ticker", "date", *[cost(c).alias(f"cost_{c // 1000}k") for c in (250_000, 500_000, 1_000_000)]), 6)


@query("j17_positions_returns", sql(f""", {RET} SELECT p.ticker, count(*) AS n, count(r.ret) AS matched, round(sum(coalesce(r.ret, 0)), 6) AS total FROM (SELECT ticker, date + 1 AS date FROM px) p LEFT JOIN ret r ON p.ticker = r.ticker AND p.date = r.date GROUP BY 1""", "px"))
def j17(spark, d):
    bars = A.prices(spark, d)
    moved = bars.select("ticker", F.date_add("date", 1).alias("date"))
    out = moved.join(X.returns(bars).select("ticker", "date", "ret"), ["ticker", "date"], "left")
    return rounded(out.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count("ret").alias("matched"), F.sum(F.coalesce("ret", F.lit(0.0))).alias("total")), 6)
