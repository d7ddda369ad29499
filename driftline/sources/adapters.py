"""Panel and event views over the driver's tables, each with the SQL that defines it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.calendar import is_weekday


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ticker(nation):
    return F.concat(F.lit("N"), F.lpad(nation.cast("string"), 2, "0"))


def _cents():
    """Extended price in whole cents: integer sums do not depend on the order of rows."""
    return F.round(F.col("l_extendedprice") * 100).cast("long")


def _kept_percent():
    return F.lit(100) - F.round(F.col("l_discount") * 100).cast("long")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per ticker (nation of the supplier) on weekdays; ``k`` splits rows between the two vendors."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", F.to_date("l_shipdate").alias("date"))
    joined = items.where(is_weekday(F.col("date"))).join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return joined.groupBy(_ticker(F.col("s_nationkey")).alias("ticker"), "date").agg(
        F.min_by(unit, F.struct("l_orderkey", "l_linenumber", "l_suppkey", unit)).alias("open"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        (F.sum(_cents()) / 100.0 / F.sum("l_quantity")).alias("close"),
        (F.sum(_cents() * _kept_percent()) / 10_000.0 / F.sum("l_quantity")).alias("adjusted_close"),
        F.sum("l_quantity").alias("volume"),
        F.pmod(F.sum("l_orderkey"), F.lit(13)).alias("k"),
    )


def vendors(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two vendors' versions of the bars, with gaps and differences of every severity."""
    off = F.col("k") - 6
    a = bars.where("k <> 1").select("ticker", "date", "open", "high", "low", "close", "adjusted_close", "volume")
    b = bars.where("k <> 0").select(
        "ticker", "date", "open", "high", "low",
        (F.col("close") * (1 + off * 0.009)).alias("close"), (F.col("adjusted_close") * (1 + off * 0.009)).alias("adjusted_close"), (F.col("volume") * (1 + off * 0.15)).alias("volume"),
    )
    return a, b


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_discount", "l_quantity")
    return items.where(is_weekday(F.col("date"))).groupBy("date").agg((F.sum(_cents() * _kept_percent()) / 10_000.0 / F.sum("l_quantity")).alias("bench"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index changes: event_id, ticker, action, off_cycle, tier, ann, eff."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("ann"))
    joined = orders.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    first = F.substring("o_orderpriority", 1, 1)
    return joined.select(
        F.col("o_orderkey").alias("event_id"),
        _ticker(F.col("c_nationkey")).alias("ticker"),
        F.when(F.col("o_orderstatus") == "F", "Removal").otherwise("Addition").alias("action"),
        (F.col("o_orderstatus") == "P").alias("off_cycle"),
        F.when(first.isin("1", "2"), "T50").when(first == "3", "T100").otherwise("T200").alias("tier"),
        "ann",
        F.date_add("ann", 14).alias("eff"),
    )


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares outstanding per ticker at the start of each month with orders."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.trunc(F.to_date("o_orderdate"), "MM").alias("date"))
    joined = orders.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(_ticker(F.col("c_nationkey")).alias("ticker"), "date").agg((F.count(F.lit(1)) * 10_000).alias("shares"))


def float_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investable weight factors at half-year dates; those of the first region have none."""
    nations = read(spark, sf_dir, "nation").where("n_regionkey <> 0")
    dates = F.explode(F.sequence(F.lit("1992-01-01").cast("date"), F.lit("1999-01-01").cast("date"), F.expr("interval 6 months")))
    out = nations.select("n_nationkey", dates.alias("date"))
    return out.select(_ticker(F.col("n_nationkey")).alias("ticker"), "date", (F.lit(0.3) + 0.7 * ((F.col("n_nationkey") + F.month("date")) % 10) / 10).alias("iwf"))


C, K = "CAST(round(l_extendedprice * 100) AS BIGINT)", "(100 - CAST(round(l_discount * 100) AS BIGINT))"
#: SQL of the views above.
SQL = {
    "px": f"""px AS (SELECT 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS ticker, CAST(l_shipdate AS DATE) AS date,
  arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice / l_quantity)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum({C}) AS BIGINT) / 100.0e0 / sum(l_quantity) AS close, CAST(sum({C} * {K}) AS BIGINT) / 10000.0e0 / sum(l_quantity) AS adjusted_close,
  sum(l_quantity) AS volume, CAST(sum(l_orderkey) % 13 AS BIGINT) AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE isodow(CAST(l_shipdate AS DATE)) <= 5 GROUP BY 1, 2)""",
    "va": "va AS (SELECT * FROM px WHERE k <> 1)",
    "vb": "vb AS (SELECT ticker, date, open, high, low, close * (1 + (k - 6) * 0.009e0) AS close, adjusted_close * (1 + (k - 6) * 0.009e0) AS adjusted_close, volume * (1 + (k - 6) * 0.15e0) AS volume FROM px WHERE k <> 0)",
    "bench": f"bench AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum({C} * {K}) AS BIGINT) / 10000.0e0 / sum(l_quantity) AS bench FROM lineitem WHERE isodow(CAST(l_shipdate AS DATE)) <= 5 GROUP BY 1)",
    "ev": """ev AS (SELECT o_orderkey AS event_id, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ticker,
  CASE WHEN o_orderstatus = 'F' THEN 'Removal' ELSE 'Addition' END AS action, o_orderstatus = 'P' AS off_cycle,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'T50' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'T100' ELSE 'T200' END AS tier,
  CAST(o_orderdate AS DATE) AS ann, CAST(o_orderdate AS DATE) + 14 AS eff FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "sh": "sh AS (SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) * 10000 AS shares FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "fl": """fl AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ticker, CAST(d AS DATE) AS date, 0.3e0 + 0.7e0 * ((n_nationkey + month(d)) % 10) / 10 AS iwf
  FROM nation, generate_series(DATE '1992-01-01', DATE '1999-01-01', INTERVAL 6 MONTH) AS g(d) WHERE n_regionkey <> 0)""",
}


def sql(body: str, *views: str) -> str:
    """``body`` (which may begin with more ``name AS (...),`` views ending in a final select) behind the named views."""
    return "WITH " + ", ".join(SQL[v] for v in views) + body
