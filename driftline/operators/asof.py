"""As-of joins by union and window: no range join, and no task sorts the whole series of a key.

A quote side and a fact side are put in one column order and cut into ranges of time.  The last quote of each range (going
forward: the first) is one row; it is carried to the head of the key's later ranges, and within a range the nearest
quote is carried along the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.sources.files import written

PART = "year"


def _sides(facts: DataFrame, quotes: DataFrame, keys: list[str], at: str, quote_at: str, payload: list[str], facts_after: bool):
    carried = F.struct(F.col(quote_at).alias("at"), *[F.col(c) for c in payload]).alias("_quote")
    left = facts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(at).alias("_at"), F.struct(*facts.columns).alias("_fact"))
    right = quotes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(quote_at).alias("_at"), carried)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn("_side", F.when(F.col("_fact").isNotNull(), F.lit(int(facts_after))).otherwise(F.lit(int(not facts_after))))


def _nearest(both: DataFrame, n_keys: int, forward: bool, part: str) -> DataFrame:
    """The facts of ``both`` with the quote before them (forward: after them) in the order of time and side, as ``_quote``.

    Ranges are calendar units, ``part`` long; times that are neither dates nor timestamps have one range.  Per key and range
    one row goes from the first step to the second, whatever the range holds; both are shuffled by key and range.
    """
    dated = isinstance(both.schema["_at"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    keys = [f"_k{i}" for i in range(n_keys)]
    dealt = both.withColumn("_part", F.date_trunc(part, "_at") if dated else F.lit(0))
    nearest = F.min_by if forward else F.max_by
    heads = dealt.groupBy(*keys, "_part").agg(nearest("_quote", F.when(F.col("_quote").isNotNull(), F.col("_at"))).alias("_quote"))
    order = F.col("_part").desc_nulls_first() if forward else F.col("_part").asc_nulls_first()
    passed = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_quote", F.last("_quote", ignorenulls=True).over(passed)).where("_quote is not null").withColumn("_side", F.lit(-1))
    # Sorted backwards when it looks forward, so that the frame grows by a row at a time.
    along = F.col("_at").desc_nulls_first() if forward else F.col("_at").asc_nulls_first()
    frame = Window.partitionBy(*keys, "_part").orderBy(F.col("_side") >= 0, along, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = dealt.unionByName(heads, allowMissingColumns=True)
    return whole.withColumn("_quote", F.last("_quote", ignorenulls=True).over(frame)).where("_fact is not null")


def asof_backward(facts: DataFrame, quotes: DataFrame, keys: list[str], at: str, quote_at: str, payload: list[str], strict: bool = False, part: str = PART) -> DataFrame:
    """facts + payload of the last quote at or before (``strict``: before) ``at``, and its time as ``quote_at`` + '_found'.

    Facts without such a quote get nulls; a null time matches nothing.  ``part`` is the length of the ranges that are
    sorted apart ('year', 'month', 'day', 'hour'): the result is the same, a denser series takes a shorter one.
    """
    both = _sides(facts, quotes.where(F.col(quote_at).isNotNull()), keys, at, quote_at, payload, not strict)
    found = _nearest(both, len(keys), False, part)
    return found.select("_fact.*", F.col("_quote.at").alias(f"{quote_at}_found"), *[F.col(f"_quote.{c}").alias(c) for c in payload])


def asof_forward(facts: DataFrame, quotes: DataFrame, keys: list[str], at: str, quote_at: str, payload: list[str], tolerance_days: int | None = None, part: str = PART) -> DataFrame:
    """facts + payload of the first quote at or after ``at``; nulls where it is more than ``tolerance_days`` calendar days later.

    Facts without such a quote, or with a null time, get nulls.  ``part`` as in ``asof_backward``.
    """
    both = _sides(facts, quotes.where(F.col(quote_at).isNotNull()), keys, at, quote_at, payload, True)
    found = _nearest(both, len(keys), True, part)
    late = F.lit(False) if tolerance_days is None else F.datediff(F.col("_quote.at"), F.col("_at")) > tolerance_days
    keep = lambda c, name: F.when(~late, F.col(f"_quote.{c}")).alias(name)
    return found.select("_fact.*", keep("at", f"{quote_at}_found"), *[keep(c, c) for c in payload])


def asof_lookup(facts: DataFrame, quotes: DataFrame, keys: list[str], at: str, quote_at: str, payload: list[str], forward: bool = False, tolerance_days: int | None = None, strict: bool = False, part: str = PART) -> DataFrame:
    """As-of join for facts that share keys and times: each distinct (keys, ``at``) is looked up once, then joined back by equality.

    The sort of a range holds its quotes and at most one row a time, however many facts a hot key has.  What is found is
    written, so that its size is known and facts are not shuffled to a small table; else the join back can be split by adaptive execution.
    Null keys or times match nothing.
    """
    marks = facts.select(*keys, at).dropna().distinct()
    if forward:
        found = asof_forward(marks, quotes, keys, at, quote_at, payload, tolerance_days, part)
    else:
        found = asof_backward(marks, quotes, keys, at, quote_at, payload, strict, part)
    found = written(found, "found")
    return facts.join(found, [*keys, at], "left").select(*[facts[c] for c in facts.columns], f"{quote_at}_found", *payload)


def asof_by_day(facts: DataFrame, quotes: DataFrame, at: str, quote_at: str, payload: list[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """As-of join without a key: each distinct ``at`` is looked up once, then joined back by equality.

    The sort holds one row per day, however many facts a day has; a null time matches nothing.
    """
    days = facts.select(F.col(at).alias("_day")).where("_day is not null").distinct().withColumn("_all", F.lit(0))
    marks = quotes.select(quote_at, *payload).withColumn("_all", F.lit(0))
    if forward:
        found = asof_forward(days, marks, ["_all"], "_day", quote_at, payload)
    else:
        found = asof_backward(days, marks, ["_all"], "_day", quote_at, payload, strict)
    return facts.join(found.drop("_all"), F.col(at) == F.col("_day"), "left").drop("_day")


def latest_per_key(quotes: DataFrame, keys: list[str], at: str, asof: Column) -> DataFrame:
    """The last row of each key at or before ``asof``, by partial aggregation (no sort)."""
    rest = [c for c in quotes.columns if c not in keys]
    best = quotes.where(F.col(at) <= asof).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
