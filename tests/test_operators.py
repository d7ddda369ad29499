import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import events as E
from driftline.operators import models as ML
from driftline.operators import trading as B
from driftline.operators.asof import asof_backward, asof_forward, asof_lookup, latest_per_key
from driftline.operators.quality import reconcile, stale_runs
from driftline.operators.rules import decide, pair
from driftline.sources import files

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)


def test_asof_directions(spark):
    facts = spark.createDataFrame([(1, "A", D(5)), (2, "A", D(0)), (3, "B", D(5)), (4, "A", None), (5, None, D(5))], "id int, t string, at date")
    quotes = spark.createDataFrame([("A", D(1), 1.0), ("A", D(5), 2.0), ("A", D(20), 3.0), (None, D(1), 9.0)], "t string, d date, v double")
    back = {r.id: r.v for r in asof_backward(facts, quotes, ["t"], "at", "d", ["v"]).collect()}
    strict = {r.id: r.v for r in asof_backward(facts, quotes, ["t"], "at", "d", ["v"], strict=True).collect()}
    ahead = {r.id: r.v for r in asof_forward(facts, quotes, ["t"], "at", "d", ["v"]).collect()}
    near = {r.id: r.v for r in asof_forward(facts.withColumn("at", F.date_add("at", 6)), quotes, ["t"], "at", "d", ["v"], 3).collect()}
    assert (back[1], back[2], back[3], back[4]) == (2.0, None, None, None)
    assert (strict[1], strict[2]) == (1.0, None)
    assert (ahead[1], ahead[2], ahead[3]) == (2.0, 1.0, None)
    assert near[1] is None and near[2] is None
    latest = latest_per_key(quotes, ["t"], "d", F.lit(D(6))).where("t = 'A'").collect()
    assert [(r.d, r.v) for r in latest] == [(D(5), 2.0)]


def test_nothing_after_the_date_is_seen(spark):
    quotes = spark.createDataFrame([("A", D(i), float(i)) for i in range(10)], "t string, d date, v double")
    facts = spark.createDataFrame([(i, "A", D(i)) for i in range(10)], "id int, t string, at date")
    for r in asof_backward(facts, quotes, ["t"], "at", "d", ["v"]).collect():
        assert r.d_found <= r.at


def test_reconcile_and_stale(spark):
    cols = "ticker string, date date, open double, high double, low double, close double, adjusted_close double, volume double"
    bar = lambda d, c: ("A", D(d), c, c, c, c, c, 100.0)
    a = spark.createDataFrame([bar(0, 10.0), bar(1, 10.0), bar(3, 10.0)], cols)
    b = spark.createDataFrame([bar(0, 10.2), bar(1, 12.0), bar(2, 11.0)], cols)
    got = {r.date: r for r in reconcile(a, b).collect()}
    assert (got[D(0)].close, got[D(0)].adjusted_close, got[D(0)].price_severity, got[D(0)].drop) == (10.0, 10.2, "low", False)
    assert got[D(1)].price_severity == "high" and got[D(1)].drop
    assert (got[D(2)].close_source, got[D(2)].price_severity, got[D(2)].drop) == ("b", "missing", False)
    runs = stale_runs(spark.createDataFrame([("A", D(i), c) for i, c in enumerate([1.0, 1.0, 1.0, 2.0, None, None, None])], "ticker string, date date, close double"), least=2)
    assert [(r.date, r.stale_run) for r in runs.orderBy("date").collect()] == [(D(1), 2), (D(2), 3)]


def test_rules_and_pairing(spark):
    rows = [(f"T{i:03}", 1, i, i <= 3 or i == 12, i != 2) for i in range(1, 15)]
    ranked = spark.createDataFrame(rows, "ticker string, grp int, fmc_rank int, member boolean, liquidity_pass boolean")
    decided = {r.ticker: r.action for r in decide(ranked, 4, 10).collect()}
    assert (decided["T002"], decided["T004"], decided["T012"], decided["T001"]) == ("Removal", "Addition", "Removal", "no change")
    paired = {r.ticker: (r.action, r.confidence) for r in pair(decide(ranked, 6, 10), ["grp"]).collect()}
    assert [t for t, (a, _) in sorted(paired.items()) if a == "Addition"] == ["T004"]
    assert paired["T005"] == ("no change", "borderline")


def test_greedy_suppression(spark):
    ev = spark.createDataFrame([(i, "A", "Addition", D(d)) for i, d in enumerate([1, 5, 9, 20, 20])] + [(9, "A", "Removal", D(2))], "event_id int, ticker string, action string, ann date")
    kept = sorted((r.action, r.ann) for r in E.suppress_repeats(ev).collect())
    assert kept == [("Addition", D(1)), ("Addition", D(9)), ("Addition", D(20)), ("Removal", D(2))]


def test_suppression_across_years(spark):
    """Sparse, dense and gappy keys over many years, windows from none to over a year, against a plain walk."""
    rng = random.Random(8)
    days = {"dense": range(2000), "sparse": sorted(rng.sample(range(9000), 60)), "mixed": sorted(rng.sample(range(3000), 700)), "new year": [0, 363, 364, 365, 366, 371, 372, 373, 730]}
    rows = [(i, k, "Addition", dt.date(2001, 1, 1) + dt.timedelta(days=d)) for k, ds in days.items() for i, d in enumerate(ds)]
    ev = spark.createDataFrame(rows + [(0, None, "Addition", D(1)), (1, "dense", "Addition", None)], "event_id int, ticker string, action string, ann date")
    for window in (0, 1, 7, 400):
        want = []
        for k in days:
            last = None
            for _, t, _, d in rows:
                if t == k and (last is None or (d - last).days > window):
                    want.append((k, d))
                    last = d
        assert sorted((r.ticker, r.ann) for r in E.suppress_repeats(ev, window).collect()) == sorted(want)
    assert E.suppress_repeats(ev.limit(0)).count() == 0


def test_suppression_of_a_million_days_of_one_key(spark):
    ev = spark.range(1_000_000).select("id", F.lit("A").alias("ticker"), F.lit("Addition").alias("action"), F.date_add(F.lit("1000-01-01").cast("date"), F.col("id").cast("int")).alias("ann")).withColumnRenamed("id", "event_id")
    found = E.suppress_repeats(ev).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count_if(F.col("event_id") % 8 != 0).alias("off")).first()
    assert tuple(found) == (125_000, 0, 999_992, 0)


def test_exposure_limits(spark):
    rows = [(i, "long" if i < 8 else "short", D(0)) for i in range(10)]
    sized = B.enforce_exposure(B.size_positions(spark.createDataFrame(rows, "event_id int, side string, entry_date date")))
    weights = [r.weight for r in sized.collect()]
    assert sum(map(abs, weights)) <= 1.0 + 1e-9 and abs(sum(weights)) <= 0.2 + 1e-9
    with pytest.raises(ValueError):
        B.size_positions(sized, "unknown")


def test_folds_keep_time_order(spark):
    rows = [(i, D(i // 4), i % 2, float(i % 2) + 0.1 * (i % 7)) for i in range(120)]
    out = ML.out_of_fold(spark.createDataFrame(rows, "id int, day date, y int, x double"), ["x", "absent"], "y", "day", count=3)
    got = out.groupBy("fold").agg(F.min("day").alias("a"), F.max("day").alias("b")).orderBy("fold").collect()
    assert all(p.b < q.a for p, q in zip(got, got[1:]))
    assert out.where("y = 1").agg(F.avg("score")).first()[0] > out.where("y = 0").agg(F.avg("score")).first()[0]
    assert ML.calibrated(out, "y").where("calibrated is null").count() == 0


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "fmp_clean"
    folder.mkdir()
    (folder / "AAA.csv").write_text("date,open,close\n2024-01-02,1.0,2.0\n")
    (folder / "shares.csv").write_text("date,open,close\n2024-01-02,9.0,9.0\n")
    panel = files.read_price_folder(spark, str(folder)).collect()
    assert [(r.ticker, r.source, r.open, r.close, r.vwap) for r in panel] == [("AAA", "fmp", 1.0, 2.0, None)]
    assert files.read_price_folder(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "labels.csv").write_text("announcement_date,index,action,ticker\n2024-03-01,idx200, addition,bhp \n")
    label = files.read_labels(spark, str(tmp_path / "labels.csv")).collect()[0]
    assert (label.action, label.ticker, label["index"], label.company_name) == ("Addition", "BHP", "IDX200", None)
    (tmp_path / "snap.json").write_text('{"2024-01-01": [{"ticker": "A", "name": "Aa", "sector": "S"}], "2024-02-01": []}')
    assert [(str(r.snapshot), r.ticker, r.sector) for r in files.read_snapshots(spark, str(tmp_path / "snap.json")).collect()] == [("2024-01-01", "A", "S")]
    rows = spark.createDataFrame([("A", D(0), 1.0), ("B", D(1), 2.0)], "ticker string, date date, close double")
    files.write_partitioned(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("ticker", "close").collect())) == [("A", 1.0), ("B", 2.0)]
    assert sorted(r.close for r in files.upsert(rows, spark.createDataFrame([("A", D(0), 5.0)], rows.schema), "ticker").collect()) == [2.0, 5.0]


def test_asof_edges(spark):
    """Ties, null times, no quote, tolerance and the day-wise form against a loop."""
    from driftline.operators.asof import asof_backward, asof_by_day, asof_forward

    day = lambda n: None if n is None else dt.date(2024, 1, 1) + dt.timedelta(n)
    facts = [(1, "a", 3), (2, "a", 4), (3, "a", None), (4, "b", 9), (5, "c", 2), (6, "a", 3), (7, None, 3), (8, "a", 30)]
    quotes = [("a", 3, 30), ("a", 8, 80), ("b", 1, 10), ("a", None, 99)]
    f = spark.createDataFrame([(i, k, day(n)) for i, k, n in facts], "id int, k string, at date")
    q = spark.createDataFrame([(k, day(n), v) for k, n, v in quotes], "k string, d date, v int")

    def want(forward, keyed, tolerance=None, strict=False):
        out = {}
        for i, k, n in facts:
            fit = [(m, v) for kk, m, v in quotes if n is not None and m is not None and (not keyed or kk == k) and (m >= n if forward else m < n if strict else m <= n)]
            best = (min if forward else max)(fit, default=(None, None))
            out[i] = best[1] if best[0] is not None and (tolerance is None or best[0] - n <= tolerance) else None
        return out

    got = lambda df: {r["id"]: r["v"] for r in df.collect()}
    assert got(asof_backward(f, q, ["k"], "at", "d", ["v"])) == want(False, True)
    assert got(asof_backward(f, q, ["k"], "at", "d", ["v"], strict=True)) == want(False, True, strict=True)
    assert got(asof_forward(f, q, ["k"], "at", "d", ["v"])) == want(True, True)
    assert got(asof_forward(f, q, ["k"], "at", "d", ["v"], 4)) == want(True, True, 4)
    assert got(asof_by_day(f, q, "at", "d", ["v"])) == want(False, False)
    assert got(asof_by_day(f, q, "at", "d", ["v"], strict=True)) == want(False, False, strict=True)
    assert got(asof_by_day(f, q, "at", "d", ["v"], forward=True)) == want(True, False)


def test_hierarchy_tag(spark):
    from driftline.operators.rules import tag_hierarchy

    rows = spark.createDataFrame([("a", 1, "Addition", False), ("b", 1, "Removal", True), ("c", 1, "Addition", False), ("d", 1, "no change", True), ("e", 1, "Removal", True)], "ticker string, grp int, action string, member boolean")
    parents = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 1)], "ticker string, parent int")
    got = {r["ticker"]: (r["action"], r["predicted_member"]) for r in tag_hierarchy(rows, parents, "grp").collect()}
    assert got == {"a": ("Promotion", True), "b": ("Demotion", False), "c": ("Addition", True), "d": ("no change", True), "e": ("Removal", False)}


def test_facts_are_not_shuffled_to_a_small_lookup(spark):
    """What a look-up or a turnover finds is written, so its size is known and it is sent to the facts; hot keys stay where they are."""
    facts = spark.range(2000).selectExpr("id as event_id", "'A' as ticker", "date_add(date'2020-01-01', cast(id % 50 as int)) as entry_date", "date_add(date'2020-01-01', cast(id % 50 + 9 as int)) as exit_date")
    bars = spark.range(70).selectExpr("'A' as ticker", "date_add(date'2020-01-01', cast(id as int)) as date", "cast(id as double) as value")
    found = B.with_turnover(asof_lookup(facts, bars, ["ticker"], "entry_date", "date", ["value"]), bars)
    assert {r.event_id: (r.value, r.turnover) for r in found.collect()} == {i: (float(i % 50), i % 50 + 4.5) for i in range(2000)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
