"""More queries: membership tiers, brackets, filters, flows, books, predictor, resampling, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import text as TX
from driftline.operators import features as X
from driftline.operators import models as ML
from driftline.operators import resampling as RS
from driftline.operators.asof import asof_backward, asof_by_day, asof_lookup
from driftline.operators.ranks import summaries
from driftline.operators.scans import trailing
from driftline.plans.panel import A0, CAPS, RET, asof_date, bday_sql, feature_table, rounded
from driftline.plans.study import LEDGER, PNL, WIN, ledger, scored, sized, windows
from driftline.sources import adapters as A
from driftline.sources.adapters import sql
from driftline.sources.files import written

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("j14_rank_change", sql(""", q AS (SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS quarter, sum(volume) AS v FROM px GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY quarter ORDER BY v DESC, ticker) AS INTEGER) AS rnk FROM q)
  SELECT ticker, quarter, rnk, lag(rnk) OVER (PARTITION BY ticker ORDER BY quarter) - rnk AS change FROM r""", "px"))
def j14(spark, d):
    q = A.prices(spark, d).groupBy("ticker", F.trunc("date", "QUARTER").alias("quarter")).agg(F.sum("volume").alias("v"))
    r = q.withColumn("rnk", F.row_number().over(Window.partitionBy("quarter").orderBy(F.desc("v"), "ticker")))
    return r.select("ticker", "quarter", "rnk", (F.lag("rnk").over(Window.partitionBy("ticker").orderBy("quarter")) - F.col("rnk")).alias("change"))


@query("j29_bracketing_snapshots", sql(""", s AS (SELECT DISTINCT date FROM fl) SELECT event_id, (SELECT max(date) FROM s WHERE date < eff) AS before, (SELECT min(date) FROM s WHERE date > eff) AS after FROM ev""", "fl", "ev"))
def j29(spark, d):
    days = A.float_factors(spark, d).select("date").distinct()
    ev = A.events(spark, d).select("event_id", "eff")
    before = asof_by_day(ev, days, "eff", "date", [], strict=True).withColumnRenamed("date_found", "before").withColumn("next_day", F.date_add("eff", 1))
    return asof_by_day(before, days, "next_day", "date", [], forward=True).select("event_id", "before", F.col("date_found").alias("after"))


@query("j33_recent_action_flag", sql(f""", f AS (SELECT DISTINCT ticker FROM ev WHERE off_cycle AND ann BETWEEN {A0} - 60 AND {A0}) SELECT DISTINCT p.ticker, p.ticker IN (SELECT ticker FROM f) AS flagged FROM px p""", "px", "ev"))
def j33(spark, d):
    recent = A.events(spark, d).where(F.col("off_cycle") & F.col("ann").between(F.date_sub(asof_date(), 60), asof_date())).select("ticker").distinct().withColumn("flagged", F.lit(True))
    return A.prices(spark, d).select("ticker").distinct().join(recent, "ticker", "left").fillna(False, ["flagged"])


@query("g09_cost_posting", sql(f""", {PNL}, al AS (SELECT entry_date AS date, -cost / 2 AS c FROM bc UNION ALL SELECT exit_date, -cost / 2 FROM bc) SELECT date, round(sum(c), 3) AS cost FROM al GROUP BY 1""", "px", "ev"))
def g09(spark, d):
    from driftline.operators import trading as B

    led, _ = B.backtest(sized(spark, d), X.returns(A.prices(spark, d)))
    return rounded(led.select(F.explode(F.array("entry_date", "exit_date")).alias("date"), (-F.col("cost") / 2).alias("c")).groupBy("date").agg(F.sum("c").alias("cost")), 3)


@query("g40_highest_tier", sql(""", l AS (SELECT ticker, tier, arg_max(CASE WHEN action = 'Addition' THEN 1 ELSE 0 END, (ann, event_id)) AS inside FROM ev GROUP BY 1, 2)
  SELECT ticker, CASE min(CASE WHEN inside = 1 THEN CASE tier WHEN 'T50' THEN 1 WHEN 'T100' THEN 2 ELSE 3 END END) WHEN 1 THEN 'T50' WHEN 2 THEN 'T100' WHEN 3 THEN 'T200' END AS tier FROM l GROUP BY 1""", "ev"))
def g40(spark, d):
    last = A.events(spark, d).groupBy("ticker", "tier").agg(F.max_by("action", F.struct("ann", "event_id")).alias("action"))
    order = F.when(F.col("tier") == "T50", 1).when(F.col("tier") == "T100", 2).otherwise(3)
    best = last.groupBy("ticker").agg(F.min(F.when(F.col("action") == "Addition", order)).alias("k"))
    return best.select("ticker", F.when(F.col("k") == 1, "T50").when(F.col("k") == 2, "T100").when(F.col("k") == 3, "T200").alias("tier"))


@query("w18_bar_offset", sql(""", c AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM bench), e AS (SELECT event_id, (SELECT count(*) FROM c WHERE c.date < ev.ann) + 1 AS n FROM ev) SELECT event_id, (SELECT date FROM c WHERE c.n = e.n - 10) AS ten_before FROM e""", "bench", "ev"))
def w18(spark, d):
    days = A.benchmark(spark, d).select("date").withColumn("k", F.lit(0))
    days = days.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("date")))
    total = days.groupBy("k").agg((F.max("n") + 1).alias("past_end"))
    ev = A.events(spark, d).select("event_id", "ann").withColumn("k", F.lit(0))
    at = asof_by_day(ev, days, "ann", "date", ["n"], forward=True).join(F.broadcast(total), "k").select("event_id", (F.coalesce("n", "past_end") - 10).alias("n"))
    return at.join(days.select("n", "date"), "n", "left").select("event_id", F.col("date").alias("ten_before"))


@query("f23_flow_to_adv", sql(f""", {CAPS}, v AS (SELECT ticker, avg(volume) AS adv FROM px WHERE date BETWEEN {bday_sql(A0, -20)} AND {A0} GROUP BY 1), p AS (SELECT ticker, arg_max(close, date) AS price FROM px WHERE date <= {A0} GROUP BY 1), w AS (SELECT ticker, avg_fmc / sum(avg_fmc) OVER () AS weight FROM feat)
  SELECT ticker, round(weight * 15e9, 2) AS flow, round(CASE WHEN adv > 0 AND price IS NOT NULL THEN abs(weight * 15e9) / (adv * price) END, 4) AS flow_to_adv FROM w LEFT JOIN v USING (ticker) LEFT JOIN p USING (ticker)""", "px", "sh", "fl"))
def f23(spark, d):
    bars = A.prices(spark, d)
    weight = feature_table(spark, d).withColumn("k", F.lit(0)).withColumn("weight", F.col("avg_fmc") / F.sum("avg_fmc").over(Window.partitionBy("k")))
    adv = X.lookback(bars, asof_date(), 20).groupBy("ticker").agg(F.avg("volume").alias("adv"))
    price = bars.where(F.col("date") <= asof_date()).groupBy("ticker").agg(F.max_by("close", "date").alias("price"))
    all_ = weight.join(adv, "ticker", "left").join(price, "ticker", "left").withColumn("flow", F.col("weight") * 15e9)
    out = all_.select("ticker", "flow", F.when((F.col("adv") > 0) & F.col("price").isNotNull(), F.abs("flow") / (F.col("adv") * F.col("price"))).alias("flow_to_adv"))
    return out.select("ticker", F.round("flow", 2).alias("flow"), F.round("flow_to_adv", 4).alias("flow_to_adv"))


@query("p14_filters", sql(""", f AS (SELECT *, CAST((event_id * 37) % 101 AS DOUBLE) / 101 AS p, CAST((event_id * 53) % 97 AS DOUBLE) / 97 - 0.5e0 AS flow, CASE event_id % 4 WHEN 0 THEN 'high' ELSE 'none' END AS quality FROM ev)
  SELECT event_id FROM f WHERE p >= 0.65 AND abs(flow) >= 0.25 AND quality <> 'high' AND CASE WHEN p >= 0.75 THEN 'high' WHEN p >= 0.6 THEN 'medium' ELSE 'low' END IN ('high', 'medium')""", "ev"))
def p14(spark, d):
    f = A.events(spark, d).select("event_id", ((F.col("event_id") * 37 % 101).cast("double") / 101).alias("p"), ((F.col("event_id") * 53 % 97).cast("double") / 97 - 0.5).alias("flow"), F.when(F.col("event_id") % 4 == 0, "high").otherwise("none").alias("quality"))
    from driftline.operators.rules import conviction

    keep = (F.coalesce("p", F.lit(0.0)) >= 0.65) & (F.abs("flow") >= 0.25) & (F.col("quality") != "high") & conviction(F.col("p")).isin("high", "medium")
    return f.where(keep).select("event_id")


@query("p24_label_confirmation", sql(""", t AS (SELECT DISTINCT ticker, date FROM px), x AS (SELECT event_id, action, EXISTS (SELECT 1 FROM t WHERE t.ticker = ev.ticker AND t.date BETWEEN ann - 5 AND ann - 1) AS was, EXISTS (SELECT 1 FROM t WHERE t.ticker = ev.ticker AND t.date BETWEEN eff AND eff + 1) AS stays FROM ev)
  SELECT event_id, CASE WHEN action = 'Addition' AND NOT was AND stays THEN 'confirmed' WHEN action = 'Addition' AND was AND stays THEN 'already_present' WHEN action = 'Addition' AND NOT was THEN 'still_absent' WHEN action = 'Addition' THEN 'absent_after'
   WHEN was AND NOT stays THEN 'confirmed' WHEN was THEN 'still_present' WHEN NOT stays THEN 'already_absent' ELSE 'absent_before' END AS state FROM x""", "px", "ev"))
def p24(spark, d):
    days = A.prices(spark, d).select("ticker", "date")
    ev = A.events(spark, d).select("event_id", "ticker", "action", "ann", "eff")
    seen = lambda first, last, name: ev.select("event_id", "ticker", F.explode(F.sequence(first, last)).alias("date")).join(days, ["ticker", "date"], "left_semi").select("event_id").distinct().withColumn(name, F.lit(True))
    x = ev.join(seen(F.date_sub("ann", 5), F.date_sub("ann", 1), "was"), "event_id", "left").join(seen(F.col("eff"), F.date_add("eff", 1), "stays"), "event_id", "left").fillna(False, ["was", "stays"])
    add = F.col("action") == "Addition"
    state = (
        F.when(add & ~F.col("was") & F.col("stays"), "confirmed").when(add & F.col("was") & F.col("stays"), "already_present").when(add & ~F.col("was"), "still_absent").when(add, "absent_after")
        .when(F.col("was") & ~F.col("stays"), "confirmed").when(F.col("was"), "still_present").when(~F.col("stays"), "already_absent").otherwise("absent_before")
    )
    return x.select("event_id", state.alias("state"))


@query("r14_spread_book", sql(f""", {LEDGER}, cal AS (SELECT DISTINCT date FROM px), n AS (SELECT event_id, l.action, sided_ret, cal.date, count(*) OVER (PARTITION BY event_id) AS n FROM led l JOIN cal ON cal.date > entry_date AND cal.date <= exit_date WHERE reason = 'ok' AND "exit" = 5),
  r AS (SELECT date, avg(pow(1 + greatest(sided_ret, -99) / 100, 1.0e0 / n) - 1) AS rate, count(*) AS active FROM n GROUP BY 1) SELECT cal.date, round(coalesce(rate, 0.025e0 / 252), 6) AS rate, coalesce(active, 0) AS active FROM cal LEFT JOIN r USING (date)""", "px", "ev"))
def r14(spark, d):
    days = A.prices(spark, d).select("date").distinct()
    ok = ledger(spark, d).where("reason = 'ok' and exit = 5").select("event_id", "sided_ret", F.explode(F.sequence(F.date_add("entry_date", 1), F.col("exit_date"))).alias("date"))
    held = ok.join(days, "date").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("event_id")))
    rate = F.pow(1 + F.greatest("sided_ret", F.lit(-99.0)) / 100, 1.0 / F.col("n")) - 1
    book = held.groupBy("date").agg(F.avg(rate).alias("rate"), F.count(F.lit(1)).alias("active"))
    return rounded(days.join(book, "date", "left").select("date", F.coalesce("rate", F.lit(0.025 / 252)).alias("rate"), F.coalesce("active", F.lit(0)).alias("active")), 6)


@query("r15_open_vs_close", sql(""", x AS (SELECT e.event_id, e.action, 100 * (b.adjusted_close / (b.open * b.adjusted_close / b.close) - 1) AS gain FROM ev e ASOF JOIN px b ON e.ticker = b.ticker AND e.ann <= b.date WHERE b.date - e.ann <= 7 AND b.open > 0)
  SELECT action, count(*) AS n, round(avg(gain), 4) AS mean_gain, round(avg(gain) / (stddev_samp(gain) / sqrt(count(*))), 4) AS t FROM x GROUP BY 1""", "px", "ev"))
def r15(spark, d):
    bars = A.prices(spark, d).select("ticker", "date", "open", "close", "adjusted_close")
    at = asof_lookup(A.events(spark, d).select("event_id", "action", "ticker", "ann"), bars, ["ticker"], "ann", "date", ["open", "close", "adjusted_close"], forward=True, tolerance_days=7).where("open > 0")
    gain = at.select("action", (100 * (F.col("adjusted_close") / (F.col("open") * F.col("adjusted_close") / F.col("close")) - 1)).alias("gain"))
    return rounded(gain.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.avg("gain").alias("mean_gain"), (F.avg("gain") / (F.stddev_samp("gain") / F.sqrt(F.count(F.lit(1))))).alias("t")))


@query("r19_predictor", sql(""", q AS (SELECT DISTINCT CAST(date_trunc('quarter', ann) AS DATE) AS quarter FROM ev), cap AS (SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 3 MONTH AS quarter, sum(close * volume) AS mc FROM px GROUP BY 1, 2),
  m AS (SELECT q.quarter, c.ticker, mc, coalesce((SELECT arg_max(action, (ann, event_id)) FROM ev WHERE ev.ticker = c.ticker AND ann < q.quarter) = 'Addition', false) AS member FROM q JOIN cap c ON c.quarter = q.quarter),
  r AS (SELECT *, row_number() OVER (PARTITION BY quarter, member ORDER BY CASE WHEN member THEN mc ELSE -mc END, ticker) AS n FROM m), p AS (SELECT quarter, ticker, CASE WHEN member THEN 'Removal' ELSE 'Addition' END AS side FROM r WHERE n <= 5),
  a AS (SELECT DISTINCT CAST(date_trunc('quarter', ann) AS DATE) AS quarter, ticker, action AS side FROM ev)
  SELECT p.side, count(*) AS picks, count(a.ticker) AS hits, round(count(a.ticker) / count(*), 6) AS precision FROM p LEFT JOIN a ON a.quarter = p.quarter AND a.ticker = p.ticker AND a.side = p.side GROUP BY 1""", "px", "ev"))
def r19(spark, d):
    """Picks five outsiders of the largest and five members of the smallest traded value a quarter ahead."""
    ev = A.events(spark, d)
    quarter = F.trunc("ann", "QUARTER")
    cap = A.prices(spark, d).groupBy("ticker", F.add_months(F.trunc("date", "QUARTER"), 3).alias("quarter")).agg(F.sum(F.col("close") * F.col("volume")).alias("mc"))
    pool = cap.join(ev.select(quarter.alias("quarter")).distinct(), "quarter", "left_semi")
    last = ev.groupBy("ticker", F.col("ann").alias("at")).agg(F.max_by("action", "event_id").alias("was"))
    known = asof_backward(pool, last, ["ticker"], "quarter", "at", ["was"], strict=True).withColumn("member", F.coalesce(F.col("was") == "Addition", F.lit(False)))
    order = F.when(F.col("member"), F.col("mc")).otherwise(-F.col("mc"))
    picks = known.withColumn("n", F.row_number().over(Window.partitionBy("quarter", "member").orderBy(order, "ticker"))).where("n <= 5").select("quarter", "ticker", F.when(F.col("member"), "Removal").otherwise("Addition").alias("side"))
    actual = ev.select(quarter.alias("quarter"), "ticker", F.col("action").alias("side"), F.lit(1).alias("hit")).distinct()
    return rounded(picks.join(actual, ["quarter", "ticker", "side"], "left").groupBy("side").agg(F.count(F.lit(1)).alias("picks"), F.count("hit").alias("hits"), (F.count("hit") / F.count(F.lit(1))).alias("precision")), 6)


@query("g30_horizon_summary", sql(f""", {LEDGER} SELECT tier, action, "exit", count(*) AS n, round(avg(raw_ret), 4) AS mean, round(median(raw_ret), 4) AS median, round(avg(CASE WHEN sided_ret > 0 THEN 1 ELSE 0 END), 4) AS win FROM led WHERE reason = 'ok' GROUP BY 1, 2, 3 HAVING count(*) >= 8""", "px", "ev"))
def g30(spark, d):
    ok = ledger(spark, d).where("reason = 'ok'")
    by = ["tier", "action", "exit"]
    figures = summaries(ok, by, "raw_ret", also={"win": F.avg((F.col("sided_ret") > 0).cast("int"))}, of=("sided_ret",))
    return rounded(figures.where("n >= 8").select(*by, "n", "mean", "median", "win"))


@query("g39_pivot_mean", sql(f""", {LEDGER} SELECT tier, round(avg(sided_ret) FILTER (WHERE "exit" = 0), 4) AS e0, round(avg(sided_ret) FILTER (WHERE "exit" = 5), 4) AS e5, round(avg(sided_ret) FILTER (WHERE "exit" = 10), 4) AS e10 FROM led WHERE reason = 'ok' GROUP BY 1""", "px", "ev"))
def g39(spark, d):
    wide = ledger(spark, d).where("reason = 'ok'").groupBy("tier").pivot("exit", [0, 5, 10]).agg(F.avg("sided_ret"))
    return rounded(wide.toDF("tier", "e0", "e5", "e10"))


@query("g43_scoring_by_decile", "WITH s AS (SELECT doc_id, quality AS y, CAST((doc_id * 37) % 101 AS DOUBLE) / 101 AS p FROM labels), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, doc_id) AS n, count(*) OVER () AS total FROM s) SELECT count(*) AS k, round(avg(y), 6) AS hit_rate FROM r WHERE n <= total // 10")
def g43(spark, d):
    s = scored(spark, d)
    k = max(0, s.count() // 10)  # the size of the report
    return rounded(s.orderBy(F.desc("p"), "doc_id").limit(k).agg(F.count(F.lit(1)).alias("k"), F.avg("y").alias("hit_rate")), 6)


@query("w08_entry_vol", sql(f""", {RET}, v AS (SELECT ticker, date, count(ret) OVER w AS c, stddev_samp(ret) OVER w AS s FROM ret WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
  SELECT event_id, round(CASE WHEN c >= 20 AND s > 0 THEN s ELSE 0.03e0 END, 6) AS vol FROM ev e ASOF LEFT JOIN v ON e.ticker = v.ticker AND e.ann >= v.date""", "px", "ev"))
def w08(spark, d):
    known = X.returns(A.prices(spark, d)).where("ret is not null").select("ticker", "date", "ret")
    r = trailing(known, ["ticker"], "date", 60, lambda frame: [F.count("ret").over(frame).alias("c"), F.stddev_samp("ret").over(frame).alias("s")])
    at = asof_lookup(A.events(spark, d).select("event_id", "ticker", "ann"), r, ["ticker"], "ann", "date", ["c", "s"])
    return rounded(at.select("event_id", F.when((F.col("c") >= 20) & (F.col("s") > 0), F.col("s")).otherwise(F.lit(0.03)).alias("vol")), 6)


@query("w23_first_bar_trim", sql(""", r AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM px), m AS (SELECT ticker, median(close) FILTER (WHERE n BETWEEN 2 AND 6) AS m FROM r GROUP BY 1)
  SELECT ticker, count(*) AS bars, min(date) AS first_date FROM r JOIN m USING (ticker) WHERE NOT (n = 1 AND close > 1.2e0 * m) GROUP BY 1""", "px"))
def w23(spark, d):
    r = A.prices(spark, d).select("ticker", "date", "close", F.row_number().over(Window.partitionBy("ticker").orderBy("date")).alias("n"))
    m = r.groupBy("ticker").agg(F.median(F.when(F.col("n").between(2, 6), F.col("close"))).alias("m"))
    return r.join(m, "ticker").where("not (n = 1 and close > 1.2D * m)").groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), F.min("date").alias("first_date"))


@query("r20_index_reconstruction", sql(""", a AS (SELECT date, avg(adjusted_close) AS a FROM px GROUP BY 1), b AS (SELECT date, avg(close) AS b FROM px GROUP BY 1), j AS (SELECT date, bench * a / b AS level FROM bench JOIN a USING (date) JOIN b USING (date)) SELECT date, round(100 * level / first_value(level) OVER (ORDER BY date), 6) AS rebased FROM j""", "px", "bench"))
def r20(spark, d):
    bars = A.prices(spark, d)
    a, b = bars.groupBy("date").agg(F.avg("adjusted_close").alias("a")), bars.groupBy("date").agg(F.avg("close").alias("b"))
    j = A.benchmark(spark, d).join(a, "date").join(b, "date").select("date", (F.col("bench") * F.col("a") / F.col("b")).alias("level"), F.lit(0).alias("k"))
    return rounded(j.select("date", (100 * F.col("level") / F.first("level").over(Window.partitionBy("k").orderBy("date"))).alias("rebased")), 6)


@query("p11_eligibility", """SELECT p_partkey, NOT (coalesce(p_size > 45, false)) AND NOT (p_type LIKE '%BRASS%') AND p_retailprice IS NOT NULL AS eligible FROM part""")
def p11(spark, d):
    part = A.read(spark, d, "part")
    return part.select("p_partkey", (~F.coalesce(F.col("p_size") > 45, F.lit(False)) & ~F.col("p_type").contains("BRASS") & F.col("p_retailprice").isNotNull()).alias("eligible"))


@query("u07_distinct_first", sql(""", r AS (SELECT *, row_number() OVER (PARTITION BY ann, action, ticker ORDER BY event_id) AS n FROM ev) SELECT ann, action, ticker, tier FROM r WHERE n = 1""", "ev"))
def u07(spark, d):
    w = Window.partitionBy("ann", "action", "ticker").orderBy("event_id")
    return A.events(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("ann", "action", "ticker", "tier")


@query("u05_key_sets", sql(""", a AS (SELECT DISTINCT ticker, CAST(date_trunc('month', ann) AS DATE) AS m FROM ev WHERE action = 'Addition'), b AS (SELECT DISTINCT ticker, CAST(date_trunc('month', eff) AS DATE) AS m FROM ev WHERE action = 'Removal')
  SELECT count(*) FILTER (WHERE a.ticker IS NOT NULL AND b.ticker IS NOT NULL) AS tp, count(*) FILTER (WHERE b.ticker IS NULL) AS fp, count(*) FILTER (WHERE a.ticker IS NULL) AS fn FROM a FULL JOIN b ON a.ticker = b.ticker AND a.m = b.m""", "ev"))
def u05(spark, d):
    ev = A.events(spark, d)
    a = ev.where("action = 'Addition'").select("ticker", F.trunc("ann", "MM").alias("m")).distinct().withColumn("a", F.lit(1))
    b = ev.where("action = 'Removal'").select("ticker", F.trunc("eff", "MM").alias("m")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["ticker", "m"], "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))


@query("g35_tier_stats", sql(f""", {WIN} SELECT tier, off, count(ar) AS n, round(avg(ar), 4) AS mean, round(stddev_samp(ar), 4) AS sd FROM win GROUP BY 1, 2""", "px", "bench", "ev"))
def g35(spark, d):
    return rounded(windows(spark, d).groupBy("tier", "off").agg(F.count("ar").alias("n"), F.avg("ar").alias("mean"), F.stddev_samp("ar").alias("sd")))


@query("f02_f03_ticker_forms", """WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'abc.x' WHEN 1 THEN '12345' WHEN 2 THEN 'toolong7' WHEN 3 THEN ' q' || p_size ELSE NULL END AS raw FROM part), h AS (SELECT id, string_split(upper(trim(raw)), '.')[1] AS h FROM t),
  c AS (SELECT id, CASE WHEN regexp_full_match(h, '[A-Z0-9]{1,6}') AND NOT regexp_full_match(h, '[0-9]+') THEN h END AS ticker FROM h) SELECT id, ticker, ticker || '.AX' AS dotted, ticker || ' AU Equity' AS spaced FROM c""")
def f02(spark, d):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "abc.x").when(k == 1, "12345").when(k == 2, "toolong7").when(k == 3, F.concat(F.lit(" q"), F.col("p_size").cast("string")))
    out = A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), TX.clean_ticker(raw).alias("ticker"))
    return out.withColumn("v", TX.venue_tickers(F.col("ticker"))).select("id", "ticker", "v.*")


@query("f35_month_parsing", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def f35(spark, d):
    k, day = F.col("o_orderkey") % 7, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy/MM/dd")).when(k < 3, F.date_format(day, "MMMM d, yyyy")).when(k < 5, F.date_format(day, "d MMM. yyyy")).otherwise(F.upper(F.date_format(day, "MMM dd yyyy")))
    return A.read(spark, d, "orders").select("o_orderkey", TX.parse_date(text).alias("day"))


@query("f38_action_names", "SELECT l_linenumber AS k, CASE l_linenumber WHEN 1 THEN 'Addition' WHEN 2 THEN 'Removal' WHEN 3 THEN 'Promotion' WHEN 4 THEN 'Demotion' END AS action, count(*) AS n FROM lineitem GROUP BY 1, 2")
def f38(spark, d):
    k = F.col("l_linenumber")
    text = F.when(k == 1, " Inclusion of").when(k == 2, "deletion").when(k == 3, "Promoted").when(k == 4, "demotion").otherwise("split")
    return A.read(spark, d, "lineitem").groupBy(k.alias("k"), TX.action_name(text).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("f39_quarters", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1, 2")
def f39(spark, d):
    return A.read(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query("p19_p25_gap_confidence", sql(""", s AS (SELECT DISTINCT date FROM fl) SELECT event_id, off_cycle, CASE WHEN eff - (SELECT max(date) FROM s WHERE date < eff) <= 45 THEN 'exact' ELSE 'approximate' END AS confidence FROM ev""", "fl", "ev"))
def p19(spark, d):
    days = A.float_factors(spark, d).select("date").distinct()
    at = asof_by_day(A.events(spark, d).select("event_id", "off_cycle", "eff"), days, "eff", "date", [], strict=True)
    return at.select("event_id", "off_cycle", F.when(F.datediff("eff", "date_found") <= 45, "exact").otherwise("approximate").alias("confidence"))


REPLICATES = 200


@query("f28_bootstrap", sql(f""", {LEDGER}, b AS (SELECT action, sided_ret AS x, row_number() OVER (PARTITION BY action ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY action) AS n FROM led WHERE reason = 'ok' AND "exit" = 5),
  w AS (SELECT action, n, i AS k, CAST(r AS BIGINT) AS replicate FROM b, range({REPLICATES}) t(r)), h1 AS (SELECT *, ((((12345 + replicate) * 48271 + 11) % 2147483647) * 16807 + 7) % 2147483647 AS x1 FROM w),
  h2 AS (SELECT *, ((((x1 + k) * 48271 + 11) % 2147483647) * 16807 + 7) % 2147483647 AS x2 FROM h1), m AS (SELECT h.action, h.replicate, avg(b.x) AS mean FROM h2 h JOIN b ON b.action = h.action AND b.i = h.x2 % h.n GROUP BY 1, 2)
  SELECT action, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high FROM m GROUP BY 1""", "px", "ev"))
def f28(spark, d):
    ok = ledger(spark, d, (5,)).where("reason = 'ok'").select("action", "event_id", "sided_ret")
    return rounded(RS.bootstrap_interval(RS.bootstrap_means(ok, ["action"], "sided_ret", ["event_id"], REPLICATES), ["action"]))


#: Resamples, random books and least values of a cell, as in the study.
N_BOOT, N_PLACEBO, LEAST_TRADES, LEAST_BOOKS = 10_000, 5_000, 8, 5


def with_all(rows):
    """Every row under its own tier and under ALL."""
    return rows.withColumn("tier", F.explode(F.array("tier", F.lit("ALL"))))


@query("f28_bootstrap_cells")
def f28_cells(spark, d):
    """95 % interval of the mean sided return for every tier (or ALL), action and exit: 10,000 resamples (no SQL twin)."""
    by = ["tier", "action", "exit"]
    ok = with_all(ledger(spark, d).where("reason = 'ok'").select(*by, "event_id", "sided_ret"))
    return RS.bootstrap_interval(RS.blocked_bootstrap_means(ok, by, "sided_ret", "event_id", N_BOOT, LEAST_TRADES), by)


@query("f29_placebo_hold")
def f29(spark, d):
    """Placebo p of the mean sided return for every tier (or ALL), action and exit: 5,000 books of random windows of the same length (no SQL twin)."""
    by = ["tier", "action", "exit"]
    bars = A.prices(spark, d).select("ticker", "date", F.col("adjusted_close").cast("double").alias("px"))
    bars = written(bars.withColumn("bar_no", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1), "bars")
    ok = ledger(spark, d).where("reason = 'ok'")
    at = lambda c, name: bars.select("ticker", F.col("date").alias(c), F.col("bar_no").alias(name))
    trades = ok.join(at("entry_date", "b_in"), ["ticker", "entry_date"]).join(at("exit_date", "b_out"), ["ticker", "exit_date"]).select(
        *by, "ticker", (F.col("b_out") - F.col("b_in")).alias("hold_bars"), F.when(F.col("action") == "Addition", 1).otherwise(-1).alias("sign")
    )
    books = with_all(RS.placebo_holds(trades, bars, by, N_PLACEBO)).groupBy(*by, "replicate").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    null = books.where(F.col("n") >= LEAST_BOOKS).select(*by, "replicate", (F.col("total") / F.col("n")).alias("mean"))
    return RS.placebo_p(null, with_all(ok).groupBy(*by).agg(F.avg("sided_ret").alias("mean")), by)


MODEL_FEATURES = ["price", "balance", "nation", "absent"]


def model_rows(spark, d):
    orders = A.read(spark, d, "orders").where("o_orderstatus is not null")
    return orders.join(A.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.trunc("o_orderdate", "QUARTER").alias("quarter"), (F.col("o_orderstatus") == "O").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("price"), (F.col("c_acctbal") / 1e4).alias("balance"), (F.col("c_nationkey") / 25).alias("nation")
    )


@query("m03_out_of_fold_scores")
def m03(spark, d):
    """Time-ordered out-of-fold scores of a calibrated classifier of order status from order and customer features (no SQL twin)."""
    rows = model_rows(spark, d)
    out = ML.calibrated(ML.out_of_fold(rows, MODEL_FEATURES, "y", "quarter"), "y")
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("calibrated").alias("mean_calibrated"), F.avg("y").alias("observed"))


@query("m06_t07_importance", "SELECT 'logistic' AS kind, 'absent' AS feature, 0.0e0 AS weight UNION ALL SELECT 'forest', 'absent', 0.0e0 UNION ALL SELECT 'boosted', 'absent', 0.0e0")
def m06(spark, d):
    """Importances of three classifiers; of the features that all rows lack, whose importance SQL knows to be nothing."""
    rows, out = ML.balanced(written(ML.filled(model_rows(spark, d), MODEL_FEATURES), "model_rows"), "y"), None  # read by every classifier
    for kind in ("logistic", "forest", "boosted"):
        table = ML.importance(ML.pipeline(MODEL_FEATURES, "y", kind).fit(rows), MODEL_FEATURES, spark).select(F.lit(kind).alias("kind"), "feature", F.round("importance", 6).alias("weight"))
        out = table if out is None else out.unionByName(table)
    return out.where("feature = 'absent'")
