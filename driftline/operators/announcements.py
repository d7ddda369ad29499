"""Index change announcements: dates, sections and events extracted from the text of press releases.

Everything is column expressions over one row per file, and one explode for sections and lines: a file is split in
front of its section headers, so a section carries its own header and no row looks at another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import despace
from driftline.sources.files import written

# Patterns of the press releases (Java syntax).  Groups of a date are month, day, year.
MONTH = r"(January|February|March|April|May|June|July|August|September|October|November|December|Sept\.?|Jan\.?|Feb\.?|Mar\.?|Apr\.?|May\.?|Jun\.?|Jul\.?|Aug\.?|Sep\.?|Oct\.?|Nov\.?|Dec\.?)"
DATE = MONTH + r"\s+(\d{1,2}),?\s*(\d{4})"
ANNOUNCED = r"(?i)SYDNEY,?\s+" + DATE
EFFECTIVE = r"(?i)effective[^,]*?(?:on\s+(?:\w+,\s*)?|after\s+the\s+close\s+of\s+trading\s+on\s+)" + DATE
DATED_EFFECTIVE = r"(?i)effective\s+(?:prior to the open(?:\s+of trading)?\s+on|after the close of trading on|on)\s+(?:\w+,\s*)?" + DATE
HEADER = r"S&P/ASX\s*(300|200|100|50|20|All\s+Australian\s+200|All\s+Australian\s+50|All\s+Technology|All\s+Ordinaries)\b\s*Index\s*[^\w\s]\s*([^\n]*)"
ONE_DATE = r"(?i)S&P/ASX\s*200(?:\s*Index)?\s*[–—\-]\s*[A-Za-z ]*?\s*" + DATE
ONE_START, ONE_NEXT = r"S&P/ASX\s*200(?:\s*Index)?\s*[–—\-]\s*Effective", r"S&P/ASX\s*(?:50|100|300|All Ordinaries)\s*(?:Index)?\s*[–—\-]\s*Effective"
ONE_EFFECTIVE = r"(?i)effective[^,]*(?:on\s+(?:\w+,\s*)?|after\s+the\s+close\s+of\s+trading\s+on\s+)" + DATE
ONE_ACTION = r"(?i)^\s*(?:S&P/ASX\s*200\s+)?(Addition|Removal|Deletion|Inclusion|Exclusion)\s+([A-Z0-9]{1,6})\s+(.+?)\s*$"
ANY_SECTION = r"S&P/ASX\s*\d{2,3}\s*Index|All\s+Ordinaries|All\s+Australian\s*\d*|All\s+Technology|MidCap"
ACTION = r"(?i)^\s*(?:S&P/ASX\s*(?:20|50|100|200|300)\s+)?(Addition|Removal|Deletion|Inclusion|Exclusion)\s+([A-Z0-9]{1,6})\s+(.+?)\s*$"
ROW = r"(?i)^\s*(Addition|Removal|Deletion|Inclusion)\s+([A-Z0-9]{1,4})\s+(.+?)\s*$"
TICKER = r"\(X?ASX:\s*([A-Z0-9]{1,4})\)"
REPLACED = r"(?i)replaced by[^()]*\(X?ASX:\s*([A-Z0-9]{1,4})\)"
#: The date of the template that old releases carry.
TEMPLATE = "2010-01-07"


def as_date(month: Column, day: Column, year: Column) -> Column:
    """A date of a month's name or its first letters, and two numbers as text; null if there is no such day."""
    return F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.substring(month, 1, 3)), day, year), F.lit("MMM d yyyy")).cast("date")


def first_date(text: Column, pattern: str) -> Column:
    """The date in the first match of a pattern whose last three groups are month, day, year; null without one."""
    # The text is searched once; month, day and year stand at the end of what is found.
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", as_date(*[F.regexp_extract(found, f"(?i){DATE}$", i) for i in (1, 2, 3)]))


def announced(text: Column) -> Column:
    """The date after the dateline's city, else the first date anywhere that is not the template's."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + DATE), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, "(?i)" + DATE, i)
    days = F.filter(F.transform(found, lambda x: as_date(part(x, 1), part(x, 2), part(x, 3))), lambda x: x.isNotNull() & (x != F.lit(TEMPLATE).cast("date")))
    return F.coalesce(first_date(text, ANNOUNCED), F.try_element_at(days, F.lit(1)))


def despaced(text: Column) -> Column:
    """Every letter-spaced line of a text with its letters joined."""
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), despace), "\n")


def action_of(word: Column) -> Column:
    word = F.lower(word)
    return F.when(word.isin("addition", "inclusion"), "Addition").when(word.isin("removal", "deletion", "exclusion"), "Removal")


def index_name(name: Column) -> Column:
    """ASX200 and the like for numbered tiers, short names for the others."""
    bare = F.upper(F.regexp_replace(name, r"\s+", ""))
    return (
        F.when(bare.rlike("^[0-9]+$"), F.concat(F.lit("ASX"), bare))
        .when(bare == "ALLTECHNOLOGY", "ALLTECH").when(bare == "ALLORDINARIES", "ALLORDS")
        .otherwise(F.concat(F.lit("ALLAUS"), F.regexp_replace(bare, "[^0-9]", "")))
    )


def action_lines(rows: DataFrame, body: str, pattern: str) -> DataFrame:
    """A row for every line of ``body`` that states an action: + action, ticker, company_name, line_no."""
    lines = rows.select("*", F.posexplode(F.split(body, "\r?\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.select(*rows.columns, "line_no", action_of(part(1)).alias("action"), F.upper(part(2)).alias("ticker"), part(3).alias("company_name"))


def _read(files: DataFrame) -> DataFrame:
    """file, text (letter-spaced lines joined), announcement_date, default_date; written, so that no filter or second use searches a text again."""
    text = files.select("file", despaced(F.col("text")).alias("text"))
    return written(text.select("file", "text", first_date(F.col("text"), ANNOUNCED).alias("announcement_date"), first_date(F.col("text"), EFFECTIVE).alias("default_date")), "texts")


def multi_index_events(files: DataFrame) -> DataFrame:
    """(file, text) -> file, announcement_date, index, effective_date, action, ticker, company_name.

    Sections that change nothing are passed over with whatever lines they hold; a date in a section's header goes
    before the release's own; sections without any date, and files without an announcement date, give nothing; a
    file without section headers is one section of the 200.  A null text has no events.
    """
    return _events(_read(files))


def _events(read: DataFrame) -> DataFrame:
    """The events of texts that were read."""
    dated = read.where("announcement_date is not null")
    sections = dated.select("file", "announcement_date", "default_date", F.explode(F.split("text", f"(?i)(?={HEADER})", -1)).alias("body"), F.col("text").rlike(f"(?i){HEADER}").alias("headed"))
    head = lambda i: F.regexp_extract("body", f"(?i)^{HEADER}", i)
    own = sections.withColumn("name", head(1)).withColumn("rest", head(2)).where("(name <> '') = headed").where(~F.col("rest").rlike(r"(?i)^\s*no\s+change"))
    known = own.select(
        "file", "announcement_date", F.when(F.col("headed"), index_name(F.col("name"))).otherwise("ASX200").alias("index"),
        F.coalesce(first_date(F.col("rest"), "(?i)" + DATE), "default_date").alias("effective_date"), "body",
    ).where("effective_date is not null")
    return action_lines(known, "body", ACTION).drop("body", "line_no")


def parse_report(files: DataFrame, indices: list[str]) -> DataFrame:
    """A row per file: error (null if parsed), announcement_date, n_events, and a count for each of ``indices``."""
    read = _read(files)
    events = _events(read)
    counts = events.groupBy("file").agg(F.count(F.lit(1)).alias("n_events"), *[F.count_if(F.col("index") == i).alias(f"n_{i}") for i in indices])
    facts = read.select("file", "announcement_date", (~F.col("text").rlike(f"(?i){HEADER}") & F.col("default_date").isNull()).alias("undated"))
    error = F.when(F.col("announcement_date").isNull(), "no announcement date in header").when(F.col("undated"), "no effective date found")
    number = [F.when(error.isNull(), F.coalesce(c, F.lit(0))).alias(c) for c in ["n_events", *[f"n_{i}" for i in indices]]]
    return facts.join(counts, "file", "left").select("file", error.alias("error"), "announcement_date", *number)


def one_index_events(files: DataFrame) -> DataFrame:
    """(file, text) -> file, announcement_date, effective_date, action, ticker, company_name of the 200 alone.

    Its section runs from a header that says Effective to the next such header of another tier; a file without one
    is that section as a whole.  A line may name the 200 in front of its action, no other index.  This older layout
    has no letter-spaced lines: they are read as they stand and match nothing.  Files without an announcement date or any
    effective date give nothing; of several effective dates before the first comma the last counts.
    """
    text = F.coalesce("text", F.lit(""))
    dated = files.select("file", first_date(text, ANNOUNCED).alias("announcement_date"), F.coalesce(first_date(text, ONE_EFFECTIVE), first_date(text, ONE_DATE)).alias("effective_date"), text.alias("text"))
    after = F.regexp_extract("text", f"(?is)({ONE_START}.*)$", 1)
    body = F.when(after != "", F.regexp_replace(after, f"(?is){ONE_NEXT}.*$", "")).otherwise(F.col("text"))
    known = dated.where("announcement_date is not null and effective_date is not null").select("file", "announcement_date", "effective_date", body.alias("body"))
    return action_lines(known, "body", ONE_ACTION).drop("body", "line_no")


def section_of_200(text: Column) -> Column:
    """What stands from the first header of the 200 to the next header of another index; the whole text without one."""
    pieces = F.split(text, f"(?i)(?={ANY_SECTION})", -1)
    is_own = lambda p: p.rlike(r"(?i)^S&P/ASX\s*200\s*Index")
    is_head = lambda p: p.rlike(f"(?i)^(?:{ANY_SECTION})")
    start = F.array_position(F.transform(pieces, is_own), F.lit(True))
    rest = F.slice(pieces, start.cast("int"), F.size(pieces))
    other = F.array_position(F.transform(rest, lambda p: is_head(p) & ~is_own(p)), F.lit(True))
    own = F.when(other > 0, F.slice(rest, F.lit(1), other.cast("int") - 1)).otherwise(rest)
    return F.when(start > 0, F.array_join(own, "")).otherwise(text)


def dated_events(files: DataFrame) -> DataFrame:
    """(file, text) -> file, announcement_date, effective_date, index, action, ticker, company_name, source_type.

    A table of actions (restricted to the section of the 200) goes first; else prose is read: the first ticker is
    the subject, a replacement is an addition, and a demerger adds the second ticker.  The file's name gives the
    type.  Events without ticker or announcement date are dropped.
    """
    text = F.regexp_replace(despaced(F.col("text")), r"[ \t]{2,}", " ")
    kind = F.regexp_extract("file", "-asx200-([a-z]+)", 1)
    read = files.select("file", text.alias("text"), F.when(kind == "", "other").otherwise(kind).alias("source_type"))
    read = written(read.select("*", announced(F.col("text")).alias("announcement_date"), first_date(F.col("text"), DATED_EFFECTIVE).alias("effective_date")), "texts").where("announcement_date is not null")
    tabular = F.col("text").rlike(r"(?i)Action\s+Code\s+Company") | F.col("source_type").isin("rebalance", "quarterly")
    row = lambda s, i: F.regexp_extract(s, ROW, i)
    event = lambda action, ticker, company, kind: F.struct(action.alias("action"), F.upper(ticker).alias("ticker"), company.alias("company_name"), kind.alias("source_type"))
    kept = F.filter(F.split(section_of_200(F.col("text")), "\r?\n", -1), lambda s: F.trim(s).rlike(ROW))
    table = F.when(tabular, F.transform(kept, lambda s: event(action_of(row(F.trim(s), 1)), row(F.trim(s), 2), row(F.trim(s), 3), F.col("source_type"))))
    tickers, low = F.regexp_extract_all("text", F.lit(TICKER), F.lit(1)), F.lower("text")
    subject, second = F.try_element_at(tickers, F.lit(1)), F.try_element_at(tickers, F.lit(2))
    nothing, own = F.lit(""), F.col("source_type")
    other = F.regexp_extract("text", REPLACED, 1)
    removed = F.filter(
        F.array(event(F.lit("Removal"), subject, nothing, own), F.when(other != "", event(F.lit("Addition"), other, nothing, F.concat(own, F.lit("-replacement"))))), lambda x: x.isNotNull()
    )
    prose = (
        F.when(low.rlike(r"to be removed|\bremove\b"), removed)
        .when(low.rlike(r"to be added|\badd(ed)?\b"), F.array(event(F.lit("Addition"), subject, nothing, own)))
        .when((own == "demerger") | low.rlike("spin-off|demerger"), F.array(event(F.lit("Addition"), F.coalesce(second, subject), nothing, F.lit("demerger"))))
    )
    found = read.select("file", "announcement_date", "effective_date", F.explode(F.when(F.size(F.coalesce(table, F.array())) > 0, table).otherwise(prose)).alias("e"))
    return found.where("e.ticker is not null and e.ticker <> ''").select("file", "announcement_date", "effective_date", F.lit("ASX200").alias("index"), "e.*")


def first_mention(events: DataFrame) -> DataFrame:
    """Of events with the same announcement date, action and ticker the one from the first file by name."""
    best = events.groupBy("announcement_date", "action", "ticker").agg(F.min_by(F.struct("file", "effective_date", "index", "company_name", "source_type"), F.struct("file", "source_type")).alias("e"))
    return best.select("announcement_date", "action", "ticker", "e.*")
