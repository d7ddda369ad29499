"""Ranks and medians by ranges against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from driftline.functions.stats import signed_ranks
from driftline.operators import trading as B
from driftline.operators import ranks
from driftline.operators.features import rank_universe, terciles
from driftline.operators.ranks import summaries, value_counts, with_before


def rows_of(rng, groups=("a", "b", "c"), n=900):
    return [(g, None if rng.random() < 0.05 else float(rng.choice([rng.gauss(0, 3), rng.randrange(-4, 5), 0.0]))) for g in groups for _ in range(n if g == "a" else rng.randint(1, 40))]


def test_before_and_medians(spark):
    rows = rows_of(random.Random(1)) + [("d", 1.5), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    known = {}
    for g, x in rows:
        if x is not None:
            known.setdefault(g, []).append(x)
    for r in with_before(value_counts(df, ["g"], "x"), ["g"], "x").collect():
        assert (r.before, r.total, r.n) == (sum(y < r.x for y in known[r.g]), len(known[r.g]), sum(y == r.x for y in known[r.g]))


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_quantiles_by_narrowing(spark, monkeypatch, accuracy):
    """Exact whatever the sketch: with an accuracy of 3 its cuts are far off."""
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rows = rows_of(random.Random(7)) + [("d", 1.5), ("e", None), ("f", 2.0), ("f", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = {"low": 0.0, "p10": 0.1, "median": 0.5, "p75": 0.75, "top": 1.0}
    got = {r.g: r for r in summaries(df, ["g"], "x", at).collect()}
    known = {}
    for g, x in rows:
        if x is not None:
            known.setdefault(g, []).append(x)
    assert set(got) == set(known)
    for g, xs in known.items():
        r, xs = got[g], sorted(xs)
        assert (r.n, r.pos, r.neg, r.low, r.top) == (len(xs), sum(x > 0 for x in xs), sum(x < 0 for x in xs), xs[0], xs[-1])
        assert math.isclose(r.mean, statistics.fmean(xs), abs_tol=1e-9) and math.isclose(r.median, statistics.median(xs), abs_tol=1e-12)
        for name, q in at.items():
            k = q * (len(xs) - 1)
            assert math.isclose(r[name], xs[math.floor(k)] + (xs[math.ceil(k)] - xs[math.floor(k)]) * (k - math.floor(k)), abs_tol=1e-12)
    assert summaries(df.limit(0), ["g"], "x").count() == 0


def test_signed_ranks(spark):
    rows = rows_of(random.Random(2))
    for r in signed_ranks(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect():
        xs = sorted((abs(x), x) for g, x in rows if g == r.g and x)
        rank = lambda s: statistics.mean(i + 1 for i, y in enumerate(xs) if y[0] == s)
        ranks = {s: rank(s) for s in {x[0] for x in xs}}
        assert r.n == len(xs)
        for sign, got in ((1, r.w_plus), (-1, r.w_minus)):
            own = [ranks[s] for s, x in xs if x * sign > 0]
            assert got == (sum(own) if own else None)


def test_summary_sets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["T50", "T100"]), rng.choice([0, 5]), rng.choice(["Addition", "Removal"]), float(rng.randrange(-9, 10)), "ok" if rng.random() < 0.9 else "entry_gap") for _ in range(400)] + [("T200", 5, "Addition", 2.0, "ok")]
    got = {(r.tier, r.exit, r.action): (r.n, r.mean, r.median, r.std, r.win_rate) for r in B.ledger_summary(spark.createDataFrame(rows, "tier string, exit int, action string, sided_ret double, reason string")).collect()}
    sets = {}
    for t, e, a, x, reason in rows:
        if reason == "ok":
            for key in ((t, e, a), ("ALL", e, a), ("ALL", e, "ALL")):
                sets.setdefault(key, []).append(x)
    assert set(got) == set(sets)
    for key, xs in sets.items():
        n, mean, median, std, win = got[key]
        assert (n, median) == (len(xs), statistics.median(xs)) and abs(mean - statistics.mean(xs)) < 1e-9 and abs(win - sum(x > 0 for x in xs) / n) < 1e-9
        assert std is None if n == 1 else abs(std - statistics.stdev(xs)) < 1e-9


def test_terciles_of_values_that_vary_from_run_to_run(spark):
    """Sums of floats depend on the order of rows; a value that is a cut lies in the bucket below it all the same."""
    unsteady = F.udf(lambda i: i + random.random() / 2, "double").asNondeterministic()
    rows = spark.range(25).select("id", unsteady("id").alias("x"))
    got = {r.id: r.bucket for r in terciles(rows, "x").collect()}
    assert got == {i: "low" if i <= 8 else "mid" if i <= 16 else "high" for i in range(25)}


def test_numbers_by_ranges(spark):
    """Places in a group come from ranges: no window sorts a group as a whole, and null groups and values are numbered too."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 3.0]), f"t{i:04}") for i in range(3000)]
    ranked = rank_universe(spark.createDataFrame(rows, "g string, avg_fmc double, ticker string").withColumn("mdvt", F.lit(1.0)), ["g"])
    got = {r.ticker: r.fmc_rank for r in ranked.collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "row_number()" in line and "Window" in line) and "row_number()" in plan
