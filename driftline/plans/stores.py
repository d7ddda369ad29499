"""Queries through file sources and sinks: what is written to the shared folder and read back is what was there."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from driftline.operators import metrics as M
from driftline.operators import models as ML
from driftline.operators.quality import Thresholds, severity
from driftline.plans.panel import CUM, RET, SMALL, rounded, small_returns
from driftline.sources import adapters as A
from driftline.sources import files as S
from driftline.sources import responses as R
from driftline.sources import versions as V
from driftline.sources.adapters import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def priced(spark, d):
    return A.prices(spark, d).select("ticker", "date", "open", "high", "low", "close", "adjusted_close", "volume")


@query("s01_k03_price_files", sql(" SELECT ticker, date, close, NULL::DOUBLE AS vwap, 'vendor' AS source FROM px", "px"))
def s01(spark, d):
    """A file a ticker, written under its name and read back as a panel."""
    folder = S.new_folder(spark, "files") + "/vendor_raw"
    S.write_named_files(priced(spark, d), folder)
    return S.read_price_folder(spark, folder).select("ticker", "date", "close", "vwap", "source")


@query("s03_reconciled_or_raw", sql(" SELECT ticker, count(*) AS n, round(sum(volume), 2) AS volume FROM px GROUP BY 1", "px"))
def s03(spark, d):
    """There is no reconciled folder, so the raw one is read."""
    base = S.new_folder(spark, "panels")
    S.write_named_files(priced(spark, d), f"{base}/raw")
    found = S.read_first_found(spark, [f"{base}/reconciled", f"{base}/raw"])
    return rounded(found.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")), 2)


@query("s04_k03_price_loader", sql(" SELECT ticker, date, round(close, 6) AS close, volume FROM px WHERE ticker IN ('N03', 'N11') AND date BETWEEN DATE '1994-03-01' AND DATE '1995-06-30'", "px"))
def s04(spark, d):
    folder = S.new_folder(spark, "prices")
    S.write_partitioned(priced(spark, d), folder, format="csv")
    return rounded(S.read_prices(spark, folder, ["N03", "N11"], "1994-03-01", "1995-06-30").select("ticker", "date", "close", "volume"), 6)


@query("k03_partitioned_panel", sql(" SELECT ticker, date, close FROM px WHERE ticker = 'N07'", "px"))
def k03(spark, d):
    folder = S.new_folder(spark, "panel")
    S.write_partitioned(priced(spark, d), folder)
    return spark.read.parquet(folder).where("ticker = 'N07'").select("ticker", "date", "close")


@query("s11_k04_labels", sql(" SELECT ann AS announcement_date, eff AS effective_date, 'T' || substr(tier, 2) AS index, action, ticker, NULL::VARCHAR AS company_name FROM ev", "ev"))
def s11(spark, d):
    """Labels come back trimmed and in their proper case; the column they lack is null."""
    folder = S.new_folder(spark, "labels")
    ev = A.events(spark, d)
    S.write_labels(ev.select(F.col("ann").alias("announcement_date"), F.col("eff").alias("effective_date"), F.lower("tier").alias("index"), "action", F.concat(F.lit(" "), F.lower("ticker")).alias("ticker")), folder)
    return S.read_labels(spark, folder)


@query("s12_k01_shares", sql(" SELECT date, ticker, shares AS shares_outstanding, 'unknown' AS source, NULL::VARCHAR AS quality_flag FROM sh", "sh"))
def s12(spark, d):
    folder = S.new_folder(spark, "shares")
    S.write_csv(A.shares(spark, d).select("date", "ticker", F.col("shares").alias("shares_outstanding")), folder)
    return S.read_csv_table(spark, folder, S.SHARES_SCHEMA, {"source": "unknown"})


@query("s13_k05_ticker_master", "SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS canonical_ticker, n_name AS company_name, CAST(n_regionkey AS VARCHAR) AS sector, DATE '1992-01-01' + n_nationkey AS first_seen_date, n_nationkey % 3 = 0 AS active_flag, NULL::VARCHAR AS notes FROM nation")
def s13(spark, d):
    """The master table, united with one that is not there."""
    folder = S.new_folder(spark, "master")
    nation, key = A.read(spark, d, "nation"), F.col("n_nationkey")
    S.write_csv(nation.select(F.concat(F.lit("N"), F.lpad(key.cast("string"), 2, "0")).alias("canonical_ticker"), F.col("n_name").alias("company_name"), F.col("n_regionkey").alias("sector"), F.date_add(F.lit("1992-01-01").cast("date"), key.cast("int")).alias("first_seen_date"), (key % 3 == 0).alias("active_flag")), folder)
    return S.read_csv_table(spark, folder, S.MASTER_SCHEMA).unionByName(S.read_csv_table(spark, folder + "-absent", S.MASTER_SCHEMA))


@query("s17_snapshots", sql(" SELECT date AS snapshot, ticker, 'Company ' || ticker AS name, NULL::VARCHAR AS sector FROM fl", "fl"))
def s17(spark, d):
    folder = S.new_folder(spark, "snapshots")
    members = A.float_factors(spark, d).groupBy("date").agg(F.collect_list(F.struct("ticker", F.concat(F.lit("Company "), "ticker").alias("name"))).alias("items"))
    # A document a snapshot date, of as many members as an index has.
    members.select(F.to_json(F.create_map(F.col("date").cast("string"), "items")).alias("value")).repartition("value").write.text(folder)
    return spark.read.text(folder).transform(S.snapshot_rows)


@query("k08_versioned_upsert", """WITH o AS (SELECT *, year(o_orderdate) >= 1996 AS late FROM orders) SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) AS price FROM o
  WHERE late OR NOT EXISTS (SELECT 1 FROM o AS n WHERE n.late AND n.o_custkey = o.o_custkey)""")
def k08(spark, d):
    """Customers' orders in a versioned table: late orders replace all of their customers' earlier ones, twice over; a stage that is never published stays unseen."""
    path = S.new_folder(spark, "versions")
    orders = A.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"), (F.year("o_orderdate") >= 1996).alias("late"))
    early, late = orders.where("not late").drop("late"), orders.where("late").drop("late")
    V.upsert(spark, path, early, ["o_custkey"])
    V.upsert(spark, path, late, ["o_custkey"])
    V.stage(spark, path, early.withColumn("price", F.lit(0.0)), ["o_custkey"])
    V.upsert(spark, path, late, ["o_custkey"])
    return V.read(spark, path)


@query("k06_metrics_json", sql(f""", {RET}, {SMALL}, {CUM}, f AS (SELECT ticker, count(*) AS n, stddev_samp(ret) * sqrt(252) AS vol, min(drawdown) AS mdd FROM dd GROUP BY 1) SELECT ticker, n, round(vol, 6) AS vol, round(mdd, 6) AS max_drawdown FROM f""", "px"))
def k06(spark, d):
    folder = S.new_folder(spark, "metrics")
    S.write_json(M.performance(small_returns(spark, d)).select("ticker", "n", "vol", "max_drawdown"), folder)
    return rounded(spark.read.schema("ticker string, n long, vol double, max_drawdown double").json(folder), 6)


@query("h04_series_with_provenance", sql(" SELECT date, round(bench, 6) AS bench, 'ALL' AS ticker, 'lineitem' AS source, 'value by volume' AS note FROM bench", "bench"))
def h04(spark, d):
    folder = S.new_folder(spark, "series")
    S.write_csv(S.with_provenance(A.benchmark(spark, d), "ALL", "lineitem", "value by volume"), folder)
    return rounded(spark.read.schema("date date, bench double, ticker string, source string, note string").option("header", True).csv(folder), 6)


@query("h08_thresholds", """WITH x AS (SELECT CAST(round(l_discount * 100) AS INTEGER) AS p FROM lineitem), t AS (SELECT min(p) + 1 AS low, (min(p) + max(p)) // 2 AS medium, max(p) - 1 AS high FROM x)
  SELECT CASE WHEN p >= high THEN 'high' WHEN p >= medium THEN 'medium' WHEN p >= low THEN 'low' ELSE 'none' END AS severity, count(*) AS n, 25.0e0 AS jump FROM x, t GROUP BY 1""")
def h08(spark, d):
    """Settings that a job has written to a file, from the table's own range, applied to the table; what the file does not name keeps its default."""
    folder = S.new_folder(spark, "settings")
    discounts = A.read(spark, d, "lineitem").select(F.round(F.col("l_discount") * 100).cast("int").alias("p"))
    low, high = F.min("p"), F.max("p")
    S.write_json(discounts.agg(F.array(low + 1, F.floor((low + high) / 2).cast("int"), high - 1).alias("price")), folder)
    t = S.load_settings(spark, folder, Thresholds)
    return discounts.groupBy(severity(F.col("p"), t.price).alias("severity")).agg(F.count(F.lit(1)).alias("n")).withColumn("jump", F.lit(t.jump))


def _classified(spark, d):
    orders = A.read(spark, d, "orders").where("o_orderstatus is not null")
    return orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("price"), (F.month("o_orderdate") / 12).alias("month"))


@query("k07_saved_model", "SELECT count(*) AS n, 0 AS different FROM orders WHERE o_orderstatus IS NOT NULL")
def k07(spark, d):
    """A classifier saved and loaded scores every row as before."""
    folder, rows = S.new_folder(spark, "model"), ML.filled(_classified(spark, d), ["price", "month"])
    model = ML.pipeline(["price", "month"], "y").fit(ML.balanced(rows, "y"))
    ML.save(model, folder)
    score = lambda m, name: m.transform(rows).select("id", vector_to_array("probability")[1].alias(name))
    both = score(model, "before").join(score(ML.load(folder), "after"), "id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("after")).cast("int").alias("different"))


def _asked(spark, panel, path, **options):
    """The panel's keys and years read through requests to ``path``."""
    span = panel.agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b"), F.sort_array(F.collect_set("ticker")).alias("keys")).first()  # tickers are as few as nations
    return R.read_responses(spark, path, span.keys, (span.a, span.b), backoff=0, **options)


@query("s06_responses", sql(" SELECT ticker, date, round(close, 6) AS close, round(adjusted_close, 6) AS adjusted_close, volume, NULL::DOUBLE AS vwap, source FROM px, (VALUES ('vendor'), ('cache')) AS t(source)", "px"))
def s06(spark, d):
    """Prices by requests of which the first two fail, kept in a cache as they arrive; then once more from the cache, where requests get nothing."""
    base, panel = S.new_folder(spark, "responses"), S.written(priced(spark, d), "priced")
    R.record_responses(panel, f"{base}/recorded", failures=2)
    first = S.written(_asked(spark, panel, f"{base}/recorded", cache=f"{base}/cache", source="vendor"), "asked")
    again = _asked(spark, panel, f"{base}/nowhere", cache=f"{base}/cache", source="cache")
    return rounded(first.unionByName(again).select("ticker", "date", "close", "adjusted_close", "volume", "vwap", "source"), 6)


@query("s09_s10_fallback_chain", sql(" SELECT date, round(bench, 6) AS close, round(bench, 6) AS adjusted_close, 'second' AS source FROM bench", "bench"))
def s10(spark, d):
    """A benchmark from the first of three places that has it: a folder that is not there, a vendor that gives up too early, one whose close stands for the adjusted one."""
    base = S.new_folder(spark, "chain")
    series = S.written(A.benchmark(spark, d).select(F.lit("ALL").alias("ticker"), "date", F.col("bench").alias("close")), "series")
    R.record_responses(series, f"{base}/recorded", failures=1)
    vendor = lambda name, tries: _asked(spark, series, f"{base}/recorded", source=name, retries=tries, fill_adjusted=True)
    found = R.first_with_rows([S.read_price_folder(spark, f"{base}/absent"), vendor("first", 1), vendor("second", 2)])
    return rounded(found.select("date", "close", "adjusted_close", "source"), 6)
