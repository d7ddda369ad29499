"""Event tables: source priority, suppression of near repeats, coverage, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.sources.files import written


def by_priority(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def suppress_repeats(events: DataFrame, days: int = 7) -> DataFrame:
    """Per (ticker, action): drop an event within ``days`` of the last one kept; null keys and dates are left out.

    What is kept depends on what was kept before, so a year of a key is summed up as a function: from the day until which
    events are barred when it begins to the day until which they are when it ends.  Only the first ``days`` days of
    the year can be barred from before, so the function is a table of ``days`` + 1 values.  A key's functions, one
    a year, are composed in order, and each year then keeps its own days.  No task holds more than a year of a key's days.
    """
    key = ["ticker", "action", "first"]
    first = F.unix_date(F.trunc("ann", "YEAR").cast("date"))
    years = events.dropna(subset=["ticker", "action", "ann"]).withColumn("first", first).groupBy(*key).agg(F.array_sort(F.collect_set(F.unix_date("ann"))).alias("found"))
    years = written(years, "event-years")
    bar = lambda until, d: F.when(d > until, d + days).otherwise(until)
    table = F.transform(F.sequence(F.lit(0), F.lit(days)), lambda j: F.aggregate("found", F.col("first") - 1 + j, bar))
    keys = years.select(*key, table.alias("table")).groupBy("ticker", "action").agg(F.array_sort(F.collect_list(F.struct("first", "table"))).alias("years"))
    start = F.struct(F.lit(-(1 << 30)).alias("until"), F.array().cast("array<struct<first:int,until:int>>").alias("entries"))

    def step(state, year):
        barred = F.greatest(F.lit(0), state["until"] - year["first"] + 1)
        entry = F.struct(year["first"].alias("first"), (year["first"] - 1 + barred).alias("until"))
        return F.struct(F.get(year["table"], barred).alias("until"), F.concat(state["entries"], F.array(entry)).alias("entries"))

    entries = keys.select("ticker", "action", F.inline(F.aggregate("years", start, step)["entries"]))
    none = F.array().cast("array<int>")
    fold = lambda s, d: F.when(d > s["until"], F.struct((d + days).alias("until"), F.concat(s["kept"], F.array(d)).alias("kept"))).otherwise(s)
    inside = F.aggregate("found", F.struct("until", none.alias("kept")), fold)["kept"]
    kept = years.join(entries, key).select("ticker", "action", F.explode(inside).alias("ann")).withColumn("ann", F.date_from_unix_date("ann"))
    best = by_priority(events, ["ticker", "action", "ann"], [F.col("event_id")])
    return best.join(kept, ["ticker", "action", "ann"])


def coverage(events: DataFrame, priced: DataFrame) -> DataFrame:
    """Per ticker: n_events, actions (sorted, joined), first and last announcement, whether it has prices."""
    has = priced.select("ticker").distinct().withColumn("priced", F.lit(True))
    summary = events.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_events"), F.array_join(F.array_sort(F.collect_set("action")), "|").alias("actions"), F.min("ann").alias("first_ann"), F.max("ann").alias("last_ann")
    )
    return summary.join(has, "ticker", "left").withColumn("priced", F.coalesce("priced", F.lit(False)))


def snapshot_changes(members: DataFrame) -> DataFrame:
    """members: snapshot, item -> snapshot, item, change: 'added' if not in the snapshot before, 'removed' if not in this one.

    The first snapshot adds nothing.  Snapshots are numbered by the distinct list of them.
    """
    seq = members.select("snapshot").distinct().withColumn("seq", F.row_number().over(Window.orderBy("snapshot")))
    here = members.join(seq, "snapshot").select("seq", "item")
    nxt = here.select((F.col("seq") + 1).alias("seq"), "item")
    added = here.join(nxt, ["seq", "item"], "left_anti").where("seq > 1").withColumn("change", F.lit("added"))
    removed = nxt.join(here, ["seq", "item"], "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed).join(seq, "seq").select("snapshot", "item", "change")


def quarter_counts(events: DataFrame) -> DataFrame:
    """quarter, additions, removals, off_cycle, total on every quarter between the first and the last."""
    q = F.trunc("ann", "QUARTER").cast("date")
    by = events.groupBy(q.alias("quarter")).agg(
        F.count_if((F.col("action") == "Addition") & ~F.col("off_cycle")).alias("additions"), F.count_if(F.col("action") == "Removal").alias("removals"), F.count_if("off_cycle").alias("off_cycle")
    )
    span = by.agg(F.min("quarter").alias("a"), F.max("quarter").alias("b"))
    axis = span.select(F.explode(F.sequence("a", "b", F.expr("interval 3 months"))).alias("quarter"))
    out = axis.join(by, "quarter", "left").fillna(0, ["additions", "removals", "off_cycle"])
    return out.withColumn("total", F.col("additions") + F.col("removals") + F.col("off_cycle"))
