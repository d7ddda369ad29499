"""Look-ups by distinct key and time, windows by distinct start, placebo windows, votes, flows and gates against plain Python."""

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.functions.calendar import index_windows, rebalance_months
from driftline.functions.stats import robust_vote
from driftline.operators import eventstudy as V
from driftline.operators import features as X
from driftline.operators import metrics as M
from driftline.operators import models as ML
from driftline.operators import resampling as RS
from driftline.operators import trading as B
from driftline.operators.asof import asof_backward, asof_forward, asof_lookup
from driftline.operators.quality import Thresholds
from driftline.sources import files as S

D = datetime.date


def test_lookup_is_the_asof_join(spark):
    rng = random.Random(1)
    day = lambda: D(2020, 1, 1) + datetime.timedelta(days=rng.randrange(40))
    facts = spark.createDataFrame([(i, rng.choice(["a", "b", None]), rng.choice([day(), None])) for i in range(300)], "id int, k string, at date")
    quotes = spark.createDataFrame([(k, D(2020, 1, 1) + datetime.timedelta(days=i), i) for k in ("a", "c") for i in range(0, 40, 3)], "k string, d date, v int")
    key = lambda df: sorted((r.id, str(r.d_found), str(r.v)) for r in df.where("k is not null").collect())
    for kinds in ({}, {"strict": True}):
        assert key(asof_lookup(facts, quotes, ["k"], "at", "d", ["v"], **kinds)) == key(asof_backward(facts, quotes, ["k"], "at", "d", ["v"], **kinds))
    assert key(asof_lookup(facts, quotes, ["k"], "at", "d", ["v"], forward=True, tolerance_days=1)) == key(asof_forward(facts, quotes, ["k"], "at", "d", ["v"], 1))
    assert asof_lookup(facts, quotes, ["k"], "at", "d", ["v"]).count() == 300
    assert asof_lookup(facts.limit(0), quotes, ["k"], "at", "d", ["v"]).count() == 0


def panel(spark, tickers=("A", "B"), days=60):
    rng = random.Random(3)
    rows = [(t, D(2020, 1, 1) + datetime.timedelta(days=i), 10 + rng.random(), 5.0 + rng.random(), 1000.0) for t in tickers for i in range(days) if rng.random() < 0.8]
    bars = spark.createDataFrame(rows, "ticker string, date date, adjusted_close double, close double, volume double")
    bench = bars.groupBy("date").agg(F.avg("adjusted_close").alias("bench"))
    return bars, bench


def test_cars_of_shared_starts(spark):
    bars, bench = panel(spark)
    events = spark.createDataFrame([(i, "AB"[i % 2], "Addition", False, "T50", D(2020, 1, 3) + datetime.timedelta(days=i % 20)) for i in range(120)], "event_id int, ticker string, action string, off_cycle boolean, tier string, ann date")
    rows = lambda df: {r.event_id: tuple(None if x is None else round(x, 9) for x in r[4:]) for r in df.collect()}
    assert rows(V.event_cars(events, bars, bench)) == rows(V.cumulated(V.event_windows(events, bars, bench)))


def test_placebo_windows_against_plain_draws(spark):
    bars, bench = panel(spark)
    ar = V.abnormal_returns(bars, bench)
    paths = {t: [r.ar or 0.0 for r in ar.where(F.col("ticker") == t).orderBy("bar_no").collect()] for t in ("A", "B")}
    assert all(r.ar is None for r in ar.where("bar_no = 0").collect())
    names = spark.createDataFrame([("g", "A", 4)] * 3 + [("g", "B", 4)] * 2 + [("h", "A", 200)], "cell_name string, ticker string, width int")
    got = RS.placebo_windows(names, ar, ["cell_name"], 4000, piece=2).collect()
    assert len(got) == 4000 and {(r.cell_name, r.n) for r in got} == {("g", 5)}  # a window longer than the series is left out
    rng = np.random.default_rng(1)
    table = {t: np.array([sum(p[s : s + 4]) for s in range(3, len(p) - 4 - 3)]) for t, p in paths.items()}
    plain = sum(rng.choice(table[t], 20_000) for t in "AAABB")
    mine = np.array([r.total for r in got])
    assert abs(mine.mean() - plain.mean()) < 5 * plain.std() / np.sqrt(4000) and abs(mine.std() / plain.std() - 1) < 0.08
    assert RS.placebo_windows(names.limit(0), ar, ["cell_name"], 10).count() == 0
    observed = spark.createDataFrame([("g", float(np.quantile(mine / 5, 0.9)))], "cell_name string, mean double")
    null = spark.createDataFrame([("g", float(x)) for x in mine / 5], "cell_name string, mean double")
    up, down = (RS.placebo_p(null, observed, ["cell_name"], F.lit(s)).first().p for s in (1.0, -1.0))
    assert abs(up - 0.1) < 0.01 and abs(down - 0.9) < 0.01


def test_vote(spark):
    rows = [(0.01, 0.01, None, True), (0.01, 0.2, None, False), (None, 0.01, 0.01, True), (0.01, 0.01, 0.2, False), (0.2, 0.2, 0.01, False), (None, 0.2, None, False)]
    df = spark.createDataFrame(rows, "w double, s double, p double, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", robust_vote(F.col("w"), F.col("s"), F.col("p"))).collect())


def test_flow_and_comparison(spark):
    ev = spark.createDataFrame([(1, "x", 0.5, None), (2, "y", None, 0.25), (3, None, 1.0, 1.0)], "id int, index string, weight double, prior double")
    assert [(r.id, r.money, r.flow) for r in X.passive_flow(ev, {"x": 10.0, "y": 4.0}).orderBy("id").collect()] == [(1, 10.0, 5.0), (2, 4.0, -1.0), (3, None, None)]
    series = spark.createDataFrame([("own", D(2020, 1, i), 0.01) for i in (2, 3)] + [("other", D(2020, 1, i), 0.5) for i in (1, 2, 4)] + [("other", D(2020, 1, 3), None)], "series string, date date, ret double")
    got = {r.series: (r.n, round(r.total_return, 6)) for r in M.comparison(series, "own").collect()}
    assert got == {"own": (2, 0.0201), "other": (1, 0.5)}


def test_entry_gate(spark):
    bars = spark.createDataFrame([("A", D(2020, 1, 1) + datetime.timedelta(days=i), 10.0, 10.0, 0.0 if i == 20 else 5000.0) for i in range(40)] + [("C", D(2020, 1, i), 1.0, 1.0, 1.0) for i in (6, 7, 8, 9)], "ticker string, date date, adjusted_close double, close double, volume double")
    ev = spark.createDataFrame([(1, "A", D(2020, 1, 6), D(2020, 1, 10)), (2, "B", D(2020, 1, 6), D(2020, 1, 10)), (3, "A", D(2019, 1, 6), D(2019, 1, 10)), (4, "A", D(2020, 3, 6), D(2020, 3, 10)), (5, "A", D(2020, 1, 20), D(2020, 1, 24)), (6, "A", D(2020, 1, 6), D(2020, 1, 7)), (7, "C", D(2020, 1, 6), D(2020, 1, 9)), (8, "A", D(2020, 2, 4), D(2020, 3, 10))], "event_id int, ticker string, ann date, eff date")
    got = {r.event_id: r.reason for r in B.entry_gate(ev, bars, 20_000.0).collect()}
    assert got == {1: "ok", 2: "no_price_file", 3: "no_history_at_event", 4: "entry_gap", 5: "zero_volume_endpoint", 6: "zero_or_negative_hold", 7: "illiquid_or_stale", 8: "exit_gap"}


def test_calibration_sees_earlier_folds_only(spark):
    rng = random.Random(2)
    rows = [(i, i // 40, rng.random(), int(rng.random() < 0.4)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, fold int, score double, y int")
    got = {r.id: r.calibrated for r in ML.calibrated(df, "y").collect()}
    changed = df.withColumn("y", F.when(F.col("fold") == 5, 1 - F.col("y")).otherwise(F.col("y")))
    assert {r.id: r.calibrated for r in ML.calibrated(changed, "y").collect()} == got  # the last fold's labels touch nothing
    assert all((got[i] == score) == (fold == 0) for i, fold, score, _ in rows)  # no fold before the first
    assert ML.calibrated(df.limit(0), "y").count() == 0


def test_importance_and_folds(spark):
    rng = random.Random(4)
    rows = [(i, i // 30, float(i % 2) + rng.random() / 10, rng.random(), i % 2) for i in range(180)]
    df = ML.balanced(ML.filled(spark.createDataFrame(rows, "id int, at int, good double, noise double, y int"), ["good", "noise"]), "y")
    for kind in ("logistic", "boosted"):
        table = ML.importance(ML.pipeline(["good", "noise"], "y", kind).fit(df), ["good", "noise"], spark).collect()
        assert [r.feature for r in table] == ["good", "noise"] and table[0].importance > table[1].importance
    scored = ML.out_of_fold(df.drop("weight"), ["good", "noise"], "y", "at", count=2)
    assert scored.where("fold > 0").count() == scored.count() > 0 and scored.where("(score > 0.5) <> (y = 1)").count() == 0


def counted(features, kind):
    return ML.CountedTrees(features, "y", kind, None)  # nothing to fall back on


def test_boosted_trees_of_counted_rows_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ML, "BOOSTS", 4)
    rng, rows, features = random.Random(8), [], ["a", "b", "absent"]
    for i in range(3000):
        a, b = rng.randrange(12), rng.randrange(9) / 3
        rows.append((i, i // 500, float(a), b, int(rng.random() < 0.1 + 0.06 * a + (0.2 if b > 1.5 else 0))))
    df = ML.balanced(ML.filled(spark.createDataFrame(rows, "id int, at int, a double, b double, y int"), features), "y")
    one, other = counted(features, "boosted").fit(df), ML.pipeline(features, "y", "boosted").by_rows.fit(df)
    assert type(ML.pipeline(features, "y", "boosted").fit(df).stages[0]).__name__ == "Bucketizer"  # 3,000 rows are 216 counted ones
    for a, b in zip(ML.importance(one, features, spark).collect(), ML.importance(other, features, spark).collect()):
        assert a.feature == b.feature and abs(a.importance - b.importance) < 1e-9
    chance = lambda m: {r.id: r.probability[1] for r in m.transform(df).select("id", "probability").collect()}
    got, want = chance(one), chance(other)
    assert len(got) == 3000 and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert set(ML.out_of_fold(df.drop("weight"), features, "y", "at", "boosted", 1).columns) == {*df.columns, "fold", "score"} - {"weight"}


def test_forest_of_counted_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ML, "TREES", 6)
    # Of 30,000 rows that are a few counted ones, 60 or one have the flag, and one may be odd: a node needs 5 rows, counted as rows.
    for flagged, odd, splits in ((1, False, False), (60, False, True), (60, True, True)):
        is_odd = (F.col("id") == 29_999) & F.lit(odd)
        df = spark.range(30_000).select("id", (F.col("id") < flagged).cast("double").alias("flag"), is_odd.cast("double").alias("odd"), F.when((F.col("id") < flagged) | is_odd, 1).otherwise(F.col("id") % 2).cast("int").alias("y"))
        model = counted(["flag", "odd"], "forest").fit(ML.balanced(df, "y"))
        assert {r.feature: r.importance for r in ML.importance(model, ["flag", "odd"], spark).collect()} == {"flag": float(splits), "odd": 0.0}
    shown = "".join(t.toDebugString for t in model.stages[-1].trees)
    assert "feature 0 <=" in shown and " in {" not in shown  # ordered, no categories
    ML.save(model, str(tmp_path / "forest"))
    assert ML.load(str(tmp_path / "forest")).stages[-1].getNumTrees == 6
    many = pa.record_batch([pa.array([1, 40, 3]), pa.array([5, -6, 7])], names=["rows", "cell"])
    (drawn,) = ML._drawn("rows", "cell", 4000)(iter([many]))
    for i, n in enumerate((1, 40, 3)):
        times = [drawn.column(f"tree_{t}")[i].as_py() for t in range(4000)]
        mean = sum(times) / 4000
        assert abs(mean - n) < 0.1 * n and abs(sum((x - mean) ** 2 for x in times) / 4000 - n) < 0.1 * n


def test_bucket_cuts(spark):
    df = spark.range(6400).select(F.col("id").cast("double").alias("many"), (F.col("id") % 3).cast("double").alias("few"), F.lit(0.0).alias("one"))
    many, few, one = ML.bucket_cuts(df, ["many", "few", "one"])
    assert few == [0.5, 1.5] and one == [0.0] and len(many) == 31 and all(abs(c - 200 * k) <= 2 for k, c in enumerate(many, 1))
    assert ML.bucket_cuts(df.limit(0), ["many"]) == [[0.0]]


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("A", D(2020, 1, i), float(i)) for i in (1, 2, 3)] + [("B", D(2021, 5, 1), None)], "ticker string, date date, close double")
    path = str(tmp_path / "p")
    S.write_partitioned(rows, path, format="csv")
    assert [(r.date, r.close) for r in S.read_prices(spark, path, ["A"], "2020-01-02").orderBy("date").collect()] == [(D(2020, 1, 2), 2.0), (D(2020, 1, 3), 3.0)]
    assert S.read_prices(spark, path).count() == 4 and S.read_prices(spark, path + "-none").count() == 0
    S.write_named_files(rows, str(tmp_path / "raw"))
    assert {(r.ticker, r.source) for r in S.read_first_found(spark, [str(tmp_path / "none"), str(tmp_path / "raw")]).collect()} == {("A", "raw"), ("B", "raw")}
    (tmp_path / "t.json").write_text('{"price": [1, 2, 3], "jump": 9.0}')
    assert S.load_settings(spark, str(tmp_path / "t.json"), Thresholds) == Thresholds(price=(1, 2, 3), jump=9.0)
    (tmp_path / "u.json").write_text('{"prise": 1}')
    with pytest.raises(ValueError):
        S.load_settings(spark, str(tmp_path / "u.json"), Thresholds)


def test_calendar_guards(spark):
    with pytest.raises(ValueError):
        index_windows(spark, "T20", {"T200": "quarterly"}, "2020-01-01", "2020-12-31")
    with pytest.raises(ValueError):
        rebalance_months("weekly")
    assert index_windows(spark, "X", {"X": "semi-annual"}, "2020-01-01", "2020-12-31").count() == 2
