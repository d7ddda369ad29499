"""Queries over announcement texts.  The texts are written from the event table, so SQL knows what must be found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import text as T
from driftline.operators import announcements as N
from driftline.sources import adapters as A
from driftline.sources.adapters import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def letter_spaced(text):
    """A space between all letters of a word and two between words."""
    inside = F.regexp_replace(F.replace(text, F.lit(" "), F.lit("\u0001")), "(?<=[^\u0001\n])(?=[^\u0001\n])", " ")
    return F.replace(inside, F.lit("\u0001"), F.lit("  "))


def long_date(day):
    return F.date_format(day, "MMMM d, yyyy")


def releases(spark, d) -> DataFrame:
    """(file, text): eight events to a release, in sections of the tiers 100, 200 and 50.

    Of every 11 files one has no dateline, of every 13 one no effective date, of every 7 one no sections, and of every
    5 one is letter-spaced.  What a section's header says goes round by file and tier.
    """
    ev = A.events(spark, d).withColumn("file_no", F.expr("event_id div 8"))
    word = F.when(F.col("action") == "Addition", F.element_at(F.array(F.lit("Addition"), F.lit("Inclusion")), (F.col("event_id") % 2 + 1).cast("int"))).otherwise(
        F.element_at(F.array(F.lit("Removal"), F.lit("Deletion"), F.lit("Exclusion")), (F.col("event_id") % 3 + 1).cast("int"))
    )
    line = F.concat_ws(" ", word, "ticker", F.concat(F.lit("Company "), F.col("event_id").cast("string"), F.lit(" Ltd")))
    files = ev.groupBy("file_no").agg(F.min("ann").alias("ann"), F.sort_array(F.collect_list(F.struct("event_id", "tier", line.alias("line")))).alias("rows"))
    no = F.col("file_no")
    of_tier = lambda t: F.transform(F.filter("rows", lambda r: r["tier"] == t), lambda r: r["line"])

    def section(number: int, turn: int):
        says = F.when((no + turn) % 4 == 0, F.concat(F.lit("Effective Prior to the Open on "), long_date(F.date_add("ann", 21)))).when((no + turn) % 4 == 1, "Effective as stated")
        says = says.when((no + turn) % 4 == 2, "No Change").otherwise(F.concat(F.date_format(F.date_add("ann", 28), "MMM"), F.lit(". "), F.date_format(F.date_add("ann", 28), "d, yyyy"), F.lit(" After Market Close")))
        return F.concat(F.array(F.concat(F.lit(f"S&P/ASX {number} Index – "), says)), of_tier(f"T{number}"))

    head = F.array(
        F.when(no % 11 == 0, "A release without a dateline").otherwise(F.concat(F.lit("SYDNEY, "), long_date(F.col("ann")), F.lit(": index changes"))),
        F.when(no % 13 == 0, "No day is given here").otherwise(F.concat(F.lit("Changes are effective prior to the open of trading on "), F.date_format(F.date_add("ann", 14), "EEEE, MMMM d, yyyy"))),
    )
    body = F.when(no % 7 == 0, F.transform("rows", lambda r: r["line"])).otherwise(F.concat(section(100, 0), section(200, 1), section(50, 2)))
    text = F.array_join(F.concat(head, body), "\n")
    return files.select(F.concat(F.lit("release-"), no.cast("string")).alias("file"), F.when(no % 5 == 0, letter_spaced(text)).otherwise(text).alias("text"))


RELEASED = """, f AS (SELECT *, event_id // 8 AS no, min(ann) OVER (PARTITION BY event_id // 8) AS fann, CASE tier WHEN 'T100' THEN 0 WHEN 'T200' THEN 1 ELSE 2 END AS turn FROM ev),
  g AS (SELECT *, 'release-' || no AS file, (no + turn) % 4 AS says, CASE WHEN no % 13 <> 0 THEN fann + 14 WHEN no % 7 <> 0 AND (no % 4 = 0 OR (no + 1) % 4 = 0 OR (no + 2) % 4 = 0) THEN fann + 21 END AS base,
    'Company ' || event_id || ' Ltd' AS company_name FROM f),
  x AS (SELECT file, no, fann AS announcement_date, CASE WHEN no % 7 = 0 THEN 'ASX200' ELSE 'ASX' || substr(tier, 2) END AS index,
    CASE WHEN no % 7 = 0 THEN base WHEN says = 0 THEN fann + 21 WHEN says = 3 THEN fann + 28 ELSE base END AS effective_date, action, ticker, company_name
    FROM g WHERE no % 11 <> 0 AND (no % 7 = 0 OR says <> 2)), y AS (SELECT * FROM x WHERE effective_date IS NOT NULL)"""


@query("x01_multi_index_events", sql(RELEASED + " SELECT file, announcement_date, index, effective_date, action, ticker, company_name FROM y", "ev"))
def x01(spark, d):
    return N.multi_index_events(releases(spark, d))


@query("x07_parse_report", sql(RELEASED + """, c AS (SELECT file, count(*) AS n, count(*) FILTER (WHERE index = 'ASX50') AS n50, count(*) FILTER (WHERE index = 'ASX100') AS n100, count(*) FILTER (WHERE index = 'ASX200') AS n200 FROM y GROUP BY 1),
  h AS (SELECT DISTINCT file, no, fann, base FROM g), e AS (SELECT *, CASE WHEN no % 11 = 0 THEN 'no announcement date in header' WHEN no % 7 = 0 AND base IS NULL THEN 'no effective date found' END AS error FROM h)
  SELECT file, error, CASE WHEN no % 11 <> 0 THEN fann END AS announcement_date, CASE WHEN error IS NULL THEN coalesce(n, 0) END AS n_events, CASE WHEN error IS NULL THEN coalesce(n50, 0) END AS "n_ASX50",
  CASE WHEN error IS NULL THEN coalesce(n100, 0) END AS "n_ASX100", CASE WHEN error IS NULL THEN coalesce(n200, 0) END AS "n_ASX200" FROM e LEFT JOIN c USING (file)""", "ev"))
def x07(spark, d):
    return N.parse_report(releases(spark, d), ["ASX50", "ASX100", "ASX200"])


@query("x02_one_index_events", sql(RELEASED + """, o AS (SELECT *, CASE WHEN base IS NOT NULL THEN base WHEN no % 7 <> 0 AND (no + 1) % 4 = 3 THEN fann + 28 END AS eff200 FROM g)
  SELECT file, fann AS announcement_date, eff200 AS effective_date, action, ticker, company_name FROM o WHERE no % 11 <> 0 AND no % 5 <> 0 AND eff200 IS NOT NULL
  AND (no % 7 = 0 OR (no + 1) % 4 > 1 OR tier = 'T200' OR (tier = 'T50' AND (no + 2) % 4 > 1))""", "ev"))
def x02(spark, d):
    """Over all files; letter-spaced ones, which this older layout does not have, give nothing."""
    return N.one_index_events(releases(spark, d))


def dated_files(spark, d) -> DataFrame:
    """(file, text): one event to a file, as a table, in prose with or without a replacement, as a demerger, or without a ticker."""
    ev, no = A.events(spark, d), F.col("event_id")
    other = F.concat(F.lit("X"), F.lpad((no % 97).cast("string"), 2, "0"))
    ann, eff = long_date(F.col("ann")), long_date(F.col("eff"))
    head = F.when(no % 2 == 0, F.concat(F.lit("SYDNEY, "), ann)).otherwise(F.concat(F.lit("New York, January 7, 2010\n"), ann, F.lit(" - news")))
    head = F.when(no % 17 == 0, "No date here").otherwise(head)
    when = F.when(no % 10 == 9, "with a day to be named").otherwise(F.concat(F.lit("effective prior to the open of trading on "), eff))
    name = lambda t: F.concat(F.lit("Company "), no.cast("string"), F.lit(" (XASX: "), t, F.lit(")"))
    t, word = F.col("ticker"), F.when(F.col("action") == "Addition", "Inclusion").otherwise("Deletion")
    table = F.concat(F.lit("S&P/ASX 100 Index\nAddition ZZ1 Other One\nS&P/ASX 200 Index\nAction  Code  Company\n"), word, F.lit(" "), t, F.lit(" Company "), no.cast("string"), F.lit("\nAddition "), other, F.lit(" Second\nS&P/ASX 300 Index\nRemoval ZZ2 Other Two"))
    kinds = [
        ("rebalance", table),
        ("removal", F.concat(name(t), F.lit(" is to be removed and will be replaced by Other (ASX:"), other, F.lit("), "), when)),
        ("merger", F.concat(F.lit("Index calculators will remove "), name(t), F.lit(" "), when)),
        ("addition", F.concat(name(t), F.lit(" is to be added "), when)),
        ("demerger", F.concat(F.lit("After the spin-off by "), name(t), F.lit(" of Unit (ASX: "), other, F.lit(") "), when)),
        ("notice", F.concat(F.lit("Nothing of note about a company to be added "), when)),
    ]
    text, kind = F.lit(None), F.lit(None)
    for i, (label, body) in enumerate(kinds):
        text, kind = F.when(no % 6 == i, body).otherwise(text), F.when(no % 6 == i, label).otherwise(kind)
    file = F.concat(F.lpad(no.cast("string"), 9, "0"), F.lit("-asx200-"), kind, F.lit(".txt"))
    return ev.select(file.alias("file"), F.concat_ws("\n", head, text).alias("text"))


DATED = """, b AS (SELECT event_id AS no, ticker AS t, 'X' || lpad(CAST(event_id % 97 AS VARCHAR), 2, '0') AS other, CASE WHEN event_id % 17 <> 0 THEN ann WHEN event_id % 6 > 0 AND event_id % 10 <> 9 THEN eff END AS ann, CASE WHEN event_id % 10 <> 9 THEN eff END AS eff, action AS a,
    lpad(CAST(event_id AS VARCHAR), 9, '0') || '-asx200-' || ['rebalance', 'removal', 'merger', 'addition', 'demerger', 'notice'][event_id % 6 + 1] || '.txt' AS file FROM ev),
  found AS (SELECT file, ann, NULL::DATE AS eff, a AS action, t AS ticker, 'Company ' || no AS company_name, 'rebalance' AS source_type FROM b WHERE no % 6 = 0
    UNION ALL SELECT file, ann, NULL, 'Addition', other, 'Second', 'rebalance' FROM b WHERE no % 6 = 0 UNION ALL SELECT file, ann, eff, 'Removal', t, '', 'removal' FROM b WHERE no % 6 = 1
    UNION ALL SELECT file, ann, eff, 'Addition', other, '', 'removal-replacement' FROM b WHERE no % 6 = 1 UNION ALL SELECT file, ann, eff, 'Removal', t, '', 'merger' FROM b WHERE no % 6 = 2
    UNION ALL SELECT file, ann, eff, 'Addition', t, '', 'addition' FROM b WHERE no % 6 = 3 UNION ALL SELECT file, ann, eff, 'Addition', other, '', 'demerger' FROM b WHERE no % 6 = 4),
  dated AS (SELECT * FROM found WHERE ann IS NOT NULL)"""


@query("x03_dated_events", sql(DATED + " SELECT file, ann AS announcement_date, eff AS effective_date, 'ASX200' AS index, action, ticker, company_name, source_type FROM dated", "ev"))
def x03(spark, d):
    return N.dated_events(dated_files(spark, d))


@query("x04_section_of_200", sql(" SELECT event_id, length('S&P/ASX 200 Index' || chr(10) || 'Action Code Company' || chr(10) || CASE WHEN action = 'Addition' THEN 'Inclusion' ELSE 'Deletion' END || ' ' || ticker || ' Company ' || event_id || chr(10) || 'Addition X00 Second' || chr(10)) AS chars FROM ev WHERE event_id % 6 = 0", "ev"))
def x04(spark, d):
    files = dated_files(spark, d).where("file like '%rebalance%'")
    section = N.section_of_200(F.regexp_replace("text", r"[ \t]{2,}", " "))
    return files.select(F.regexp_extract("file", "^([0-9]+)", 1).cast("long").alias("event_id"), F.char_length(section).cast("long").alias("chars"))


@query("x05_announcement_date", sql(" SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN ann WHEN event_id % 6 BETWEEN 1 AND 5 AND event_id % 10 <> 9 THEN eff END AS announcement_date FROM ev", "ev"))
def x05(spark, d):
    return dated_files(spark, d).select(F.regexp_extract("file", "^([0-9]+)", 1).cast("long").alias("event_id"), N.announced(F.col("text")).alias("announcement_date"))


@query("x06_first_mentions", sql(DATED + ", r AS (SELECT *, row_number() OVER (PARTITION BY ann, action, ticker ORDER BY file, source_type) AS i FROM dated) SELECT ann AS announcement_date, action, ticker, file, eff AS effective_date, 'ASX200' AS index, company_name, source_type FROM r WHERE i = 1", "ev"))
def x06(spark, d):
    return N.first_mention(N.dated_events(dated_files(spark, d)))


@query("f36_despaced_lines", """SELECT c_custkey, 'Removal ' || 'C' || c_custkey % 1000 || ' ' || c_name AS line FROM customer""")
def f36(spark, d):
    """Letter-spaced lines, in every other one of which the action word runs into the ticker."""
    customers = A.read(spark, d, "customer")
    ticker = F.concat(F.lit("C"), (F.col("c_custkey") % 1000).cast("string"))
    glued = F.concat(F.lit("Removal"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(""), ticker, F.lit(" "), F.col("c_name"))
    return customers.select("c_custkey", T.despace(letter_spaced(glued)).alias("line"))
