"""Text expressions for extracting events from semi-structured lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_ticker(raw: Column) -> Column:
    """Trimmed, upper case, one venue suffix dropped, spaces and slashes removed; null if that is not 1 to 8 letters and digits."""
    bare = F.translate(F.regexp_replace(F.upper(F.trim(raw)), r"( AU EQUITY|\.AU|\.AX| AU)$", ""), " /", "")
    return F.when(bare.rlike("^[A-Z0-9]{1,8}$"), bare)


def is_letter_spaced(line: Column) -> Column:
    """Whether a line is set with spaces between its letters: five tokens or more, over 60 percent of one character."""
    tokens = F.filter(F.split(line, " ", -1), lambda t: t != "")
    return (F.size(tokens) >= 5) & (F.size(F.filter(tokens, lambda t: F.char_length(t) == 1)) > 0.6 * F.size(tokens))


def despace(line: Column) -> Column:
    """A letter-spaced line with its letters joined; two spaces or more stand for one.

    An action word that ran into the ticker behind it is parted from it again.
    """
    joined = F.trim(F.replace(F.replace(F.regexp_replace(line, " {2,}", "\u0001"), F.lit(" "), F.lit("")), F.lit("\u0001"), F.lit(" ")))
    parted = F.regexp_replace(joined, r"(?i)^(Addition|Removal|Deletion|Inclusion|Exclusion)([A-Z0-9]{1,6})\b", "$1 $2")
    return F.when(is_letter_spaced(line), parted).otherwise(line)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))


def carry_sections(numbered: DataFrame, key: str, header: str) -> DataFrame:
    """+ section: the line number of the last header at or above the line, null before the first."""
    at = F.when(F.col("line").rlike(header), F.col("line_no"))
    frame = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.withColumn("section", F.last(at, ignorenulls=True).over(frame))


def clean_ticker(raw: Column) -> Column:
    """What stands before the first dot; null if it is digits only or not 1 to 6 letters and digits."""
    head = F.substring_index(F.upper(F.trim(raw)), ".", 1)
    return F.when(head.rlike("^[A-Z0-9]{1,6}$") & ~head.rlike("^[0-9]+$"), head)


def venue_tickers(ticker: Column) -> Column:
    """Struct of the forms that venues write a ticker in."""
    return F.struct(F.concat(ticker, F.lit(".AX")).alias("dotted"), F.concat(ticker, F.lit(" AU Equity")).alias("spaced"))


def parse_date(text: Column) -> Column:
    """A date such as ``March 5, 2024`` or ``5 Mar. 2024``; null if it is neither."""
    month_first = F.regexp_extract(text, r"^\s*([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),?\s+(\d{4})\s*$", 0) != ""
    pick = lambda p, i: F.regexp_extract(text, p, i)
    a, b = r"^\s*([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),?\s+(\d{4})\s*$", r"^\s*(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\.?,?\s+(\d{4})\s*$"
    month = F.initcap(F.when(month_first, pick(a, 1)).otherwise(pick(b, 2)))
    day = F.when(month_first, pick(a, 2)).otherwise(pick(b, 1))
    year = F.when(month_first, pick(a, 3)).otherwise(pick(b, 3))
    return F.try_to_timestamp(F.concat_ws(" ", month, day, year), F.lit("MMM d yyyy")).cast("date")


def action_name(text: Column) -> Column:
    """One of the four actions for the words that announcements use; null for others."""
    word = F.lower(F.trim(text))
    return (
        F.when(word.rlike("^(addition|added|inclusion|include|entry)"), "Addition")
        .when(word.rlike("^(removal|removed|deletion|exclusion|delete)"), "Removal")
        .when(word.rlike("^promot"), "Promotion")
        .when(word.rlike("^demot"), "Demotion")
    )
