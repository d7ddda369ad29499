import datetime as dt
import math

import pandas as pd
from pyspark.sql import functions as F

from driftline.functions import stats as S
from driftline.functions.calendar import bday_add, rebalance_calendar, weekdays_between
from driftline.functions.text import despace, is_letter_spaced, normalise_ticker


def test_bday_add_against_pandas(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(20)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    steps = [-63, -7, -1, 0, 1, 4, 5, 11]
    for row in df.select("d", *[bday_add(F.col("d"), n).alias(f"n{i}") for i, n in enumerate(steps)]).collect():
        for i, n in enumerate(steps):
            want = (pd.Timestamp(row.d) + pd.tseries.offsets.BDay(n)).date()
            assert row[f"n{i}"] == want, (row.d, n)


def test_weekdays_and_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1), dt.date(2024, 3, 11)), (dt.date(2024, 3, 5), dt.date(2024, 3, 1)), (None, None)], "a date, b date")
    got = [r.x for r in df.select(weekdays_between(F.col("a"), F.col("b")).alias("x")).collect()]
    assert [len(x) for x in got] == [7, 0, 0]
    rows = {r.month: r for r in rebalance_calendar(spark, "2024-01-01", "2024-12-31").collect()}
    assert len(rows) == 4
    march, september = rows[dt.date(2024, 3, 1)], rows[dt.date(2024, 9, 1)]
    assert (march.announcement, march.effective) == (dt.date(2024, 3, 1), dt.date(2024, 3, 15))
    assert september.effective == dt.date(2024, 9, 20)


def test_text(spark):
    raw = ["BHP", "BHP.AX", "BHP.AU", "BHP AU EQUITY", "bhp", "BAD-TICKER!!!", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").orderBy("i")
    assert [r[0] for r in df.select(normalise_ticker(F.col("raw"))).collect()] == ["BHP"] * 5 + [None, None]
    lines = spark.createDataFrame([("I n d e x  A d d s",), ("plain words here and more",)], "line string")
    assert [tuple(r) for r in lines.select(is_letter_spaced(F.col("line")), despace(F.col("line"))).collect()] == [(True, "Index Adds"), (False, "plain words here and more")]


def test_p_values():
    assert math.isclose(S.t_p(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(S.t_p(1.0, 1), 0.5, rel_tol=1e-9)
    assert math.isclose(S.sign_p(1, 5), 0.375) and S.sign_p(5, 10) == 1.0
    assert math.isclose(S.wilcoxon_p(0, 6, 0), 0.03125)
    assert math.isclose(S.wilcoxon_p(1275 - 400, 50, 0), S.wilcoxon_p(400, 50, 0))


def test_sign_test_of_any_size():
    """The tail as a sum, and a tail of half a billion without one; the normal approximation is good there."""
    tail = lambda k, n: 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    for n in (1, 2, 7, 40, 333):
        for k in range(0, n + 1, max(1, n // 9)):
            assert math.isclose(S.sign_p(k, n), min(1.0, tail(k, n)), rel_tol=1e-9)
    n = 10**9
    k = n // 2 - 20_000
    assert math.isclose(S.sign_p(k, n), math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 4) / math.sqrt(2)), rel_tol=1e-3)
    assert math.isnan(S.sign_p(0, 0))
