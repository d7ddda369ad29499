"""Announcement texts: layouts, dates and edge cases that the written fixtures of the queries do not hold."""

import datetime

from pyspark.sql import functions as F

from driftline.functions.text import despace
from driftline.operators import announcements as N


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")


def test_sections_and_dates(spark):
    text = """Sydney, Sept. 5, 2014
Changes are effective after the close of trading on September 19, 2014.
S&P/ASX 50 Index - No change
Removal ORI Stray
S&P/ASX All Australian 200 Index – Effective Prior to the Open on Sep 22, 2014
Inclusion ab1 Some Name Ltd
S&P/ASX 200 Index – as stated
S&P/ASX 200 Deletion XYZ Other & Co
not an action line"""
    rows = {(r["index"], r.ticker): r for r in N.multi_index_events(files(spark, text, None, "", "no date")).collect()}
    day = datetime.date
    assert set(rows) == {("ALLAUS200", "AB1"), ("ASX200", "XYZ")}
    assert {r.announcement_date for r in rows.values()} == {day(2014, 9, 5)}
    assert rows["ALLAUS200", "AB1"].effective_date == day(2014, 9, 22) and rows["ASX200", "XYZ"].effective_date == day(2014, 9, 19)
    assert (rows["ASX200", "XYZ"].action, rows["ASX200", "XYZ"].company_name, rows["ALLAUS200", "AB1"].action) == ("Removal", "Other & Co", "Addition")
    errors = [r.error for r in N.parse_report(files(spark, text, None, "Sydney, May 1, 2014"), ["ASX200"]).orderBy("file").collect()]
    assert errors == [None, "no announcement date in header", "no effective date found"]
    assert N.multi_index_events(files(spark, "x").limit(0)).count() == 0


def test_one_index(spark):
    text = "SYDNEY, Jun 4, 2010\nS&P/ASX 200 Index – Effective June 18, 2010\nAddition AAA A\nS&P/ASX 100 Index - Effective June 18, 2010\nAddition BBB B"
    assert [(r.ticker, r.effective_date) for r in N.one_index_events(files(spark, text)).collect()] == [("AAA", datetime.date(2010, 6, 18))]
    assert N.one_index_events(files(spark, "SYDNEY, Jun 4, 2010\nAddition AAA A", None)).count() == 0


def test_dated(spark):
    prose = "New York, January 7, 2010\nOctober 26, 2011 - Foo Group (XASX: FGL) is to be removed and replaced by Bar (ASX:BIN), effective on Monday, October 31, 2011"
    rows = spark.createDataFrame([("1-asx200-removal.pdf", prose), ("2.pdf", "Sydney, Feb 30, 2011 Foo (ASX: A) to be added"), ("3-asx200-demerger.pdf", "Sydney, May 3, 2011: Foo (ASX: AB)"), ("4.pdf", None), (None, "Sydney, May 3, 2011 (ASX: Q) added")], "file string, text string")
    got = sorted((str(r.file), r.action, r.ticker, r.source_type, str(r.announcement_date), str(r.effective_date)) for r in N.dated_events(rows).collect())
    assert got == [
        ("1-asx200-removal.pdf", "Addition", "BIN", "removal-replacement", "2011-10-26", "2011-10-31"),
        ("1-asx200-removal.pdf", "Removal", "FGL", "removal", "2011-10-26", "2011-10-31"),
        ("3-asx200-demerger.pdf", "Addition", "AB", "demerger", "2011-05-03", "None"),
        ("None", "Addition", "Q", None, "2011-05-03", "None"),
    ]


def test_despace(spark):
    lines = ["S y d n e y ,  M a y  5 ,  2 0 1 4", "R e m o v a l A G O  A t l a s  I r o n", "a b c d", "Addition ABC Plain line of words", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").orderBy("i").select(despace(F.col("line"))).collect()]
    assert got == ["Sydney, May 5, 2014", "Removal AGO Atlas Iron", "a b c d", "Addition ABC Plain line of words", "", None]


def test_one_index_has_patterns_of_its_own(spark):
    """A line of the 300 is an event of the later layout only; of two dates without a comma between them the last counts."""
    text = "SYDNEY, Jun 4, 2010\neffective on June 11 2010 and on June 18, 2010\nS&P/ASX 200 Addition AAA A Ltd\nS&P/ASX 300 Removal BBB B Ltd\nRemoval CCC C Ltd"
    assert sorted((r.ticker, r.effective_date) for r in N.one_index_events(files(spark, text)).collect()) == [("AAA", datetime.date(2010, 6, 18)), ("CCC", datetime.date(2010, 6, 18))]
    assert sorted((r.ticker, r.effective_date) for r in N.multi_index_events(files(spark, text)).collect()) == [(t, datetime.date(2010, 6, 11)) for t in ("AAA", "BBB", "CCC")]


def test_texts_are_searched_once(spark):
    """Neither a filter nor a second use joins letters or searches for a release's dates again; dates are the first match's."""
    some = files(spark, "Sydney, May 1, 2014 effective after the close of trading on Friday, June 12, 2014 and on July 3, 2015", "none", None)
    report = N.parse_report(some, ["ASX200"])
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "SYDNEY" not in plan and "effective[" not in plan
    found = some.select(N.first_date(F.col("text"), N.EFFECTIVE).alias("day")).collect()
    assert [r.day for r in found] == [datetime.date(2014, 6, 12), None, None]
    assert "SYDNEY" not in N.dated_events(some)._jdf.queryExecution().optimizedPlan().toString()
