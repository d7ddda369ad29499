"""Price histories by request as a Spark data source: a partition a key and year, retries with backoff, a write-through cache.

``spark.read.format("driftline_responses")`` with the options

* ``path``: where requests go: ``http(s)://...`` with ``{key}``, ``{start}`` and ``{end}`` in it, or a folder of recorded responses,
  ``key=<key>/year=<year>/*``, a JSON object a line with ``attempt``, ``status`` and ``body``: the n-th attempt gets the line of attempt n,
  any further one the last line;
* ``keys``: comma-separated, ``years``: ``first-last``: what can be asked for;
* ``cache``: a folder that all executors share, or none; ``use``: ``cache_first`` (ask for what the cache lacks), ``refresh`` (ask, and take
  the cache where that fails) or ``cache_only``;
* ``retries``, ``backoff`` (seconds, times the number of the attempt), ``source`` (the name in the column ``source``).

A body is ``{"historical": [{"date": ..., "open": ..., "adjClose": ...}]}``.  Missing values are null; where no row has
``adjClose`` and ``fill_adjusted`` is true, the close stands for it.  A key and year that can't be had gives no rows.  A request is for a
year, so a task holds a year of bars of one key and a lost one asks again for that alone; the cache file takes
its place by a rename, so two tasks that race leave one whole file.  ``register`` turns on that filters on ``ticker`` and
``date`` reach the source: requests outside them are never made.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FORMAT = "driftline_responses"
NUMBERS = ("open", "high", "low", "close", "adjusted_close", "volume", "vwap")
SCHEMA = "ticker string, date date, source string, " + ", ".join(f"{c} double" for c in NUMBERS)
CACHED = pa.schema([("date", pa.date32()), *[(c, pa.float64()) for c in NUMBERS]])
WHOLE = pa.schema([("ticker", pa.string()), ("date", pa.date32()), ("source", pa.string()), *[(c, pa.float64()) for c in NUMBERS]])
USES = ("cache_first", "refresh", "cache_only")


@dataclass
class YearOfKey(InputPartition):
    key: str
    year: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _recorded(path: str, key: str, year: int, attempt: int) -> tuple[int, str]:
    system, folder = _place(f"{path}/key={key}/year={year}")
    lines = []
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            with system.open_input_stream(info.path) as stream:
                lines += [json.loads(line) for line in stream.read().decode().splitlines() if line]
    if not lines:
        return 404, ""
    told = sorted(lines, key=lambda r: r["attempt"])
    answer = next((r for r in told if r["attempt"] >= attempt), told[-1])
    return answer["status"], answer.get("body") or ""


def _asked(url: str, key: str, year: int) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url.format(key=key, start=date(year, 1, 1), end=date(year, 12, 31)), timeout=30) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""
    except OSError:  # no connection, or one that broke
        return 0, ""


class ResponseReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.cache, self.use = options["path"], options.get("cache"), options.get("use", "cache_first")
        self.retries, self.backoff = int(options.get("retries", 3)), float(options.get("backoff", 0.5))
        self.source, self.fill = options.get("source", "responses"), options.get("fill_adjusted", "false").lower() == "true"
        self.keys = sorted({k.strip() for k in options["keys"].split(",") if k.strip()})
        first, last = (int(y) for y in options["years"].split("-"))
        self.first, self.last = date(first, 1, 1), date(last, 12, 31)
        if self.use not in USES or (self.use == "cache_only" and not self.cache):
            raise ValueError(f"use is one of {USES}, and cache_only needs a cache")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keys and the span of dates; every filter goes back to Spark too, which has the last word on rows."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ticker",):
                self.keys = [k for k in self.keys if k == f.value]
            elif isinstance(f, In) and f.attribute == ("ticker",):
                self.keys = [k for k in self.keys if k in f.value]
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("date",) and isinstance(f.value, date):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, f.value)
            yield f

    def partitions(self) -> list[YearOfKey]:
        return [YearOfKey(k, y) for k in self.keys for y in range(self.first.year, self.last.year + 1)] if self.first <= self.last else []

    def read(self, partition: YearOfKey | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        bars = self._bars(partition.key, partition.year)
        if bars is not None and len(bars):
            named = {"ticker": pa.array([partition.key] * len(bars)), "source": pa.array([self.source] * len(bars))}
            yield from pa.table([named[c] if c in named else bars[c] for c in WHOLE.names], schema=WHOLE).to_batches()

    def _bars(self, key: str, year: int) -> pa.Table | None:
        kept = self._cached(key, year) if self.use != "refresh" else None
        if kept is not None or self.use == "cache_only":
            return kept
        bars = self._fetched(key, year)
        if bars is None:
            return self._cached(key, year)
        if self.cache and len(bars):
            self._keep(key, year, bars)
        return bars

    def _fetched(self, key: str, year: int) -> pa.Table | None:
        """None if every attempt failed."""
        for attempt in range(1, self.retries + 1):
            web = self.path.startswith(("http://", "https://"))
            status, body = _asked(self.path, key, year) if web else _recorded(self.path, key, year, attempt)
            if status == 200:
                return self._parsed(body, year)
            if attempt < self.retries:
                time.sleep(self.backoff * attempt)
        return None

    def _parsed(self, body: str, year: int) -> pa.Table:
        rows = json.loads(body).get("historical") or []
        if self.fill and not any("adjClose" in r for r in rows):
            rows = [r | {"adjClose": r.get("close")} for r in rows]
        days = [date.fromisoformat(r["date"][:10]) for r in rows]
        names = {"adjusted_close": "adjClose"}
        bars = pa.table([pa.array(days, pa.date32()), *[pa.array([r.get(names.get(c, c)) for r in rows], pa.float64()) for c in NUMBERS]], schema=CACHED)
        inside = pa.array([d.year == year for d in days], pa.bool_())
        return bars.filter(inside).sort_by("date")

    def _cache_file(self, key: str, year: int) -> tuple[fs.FileSystem, str, str]:
        system, folder = _place(f"{self.cache}/key={key}")
        return system, folder, f"{folder}/{year}.parquet"

    def _cached(self, key: str, year: int) -> pa.Table | None:
        if not self.cache:
            return None
        system, _, file = self._cache_file(key, year)
        return pq.read_table(file, filesystem=system, partitioning=None).cast(CACHED) if system.get_file_info(file).type == fs.FileType.File else None

    def _keep(self, key: str, year: int, bars: pa.Table) -> None:
        system, folder, file = self._cache_file(key, year)
        system.create_dir(folder, recursive=True)
        half = f"{folder}/.{year}-{uuid.uuid4().hex}"
        pq.write_table(bars, half, filesystem=system)
        system.move(half, file)


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ResponseReader:
        return ResponseReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)


def read_responses(spark: SparkSession, path: str, keys: list[str], years: tuple[int, int], **options) -> DataFrame:
    """The source as a panel; ``options`` are those of the module's docstring."""
    register(spark)
    reader = spark.read.format(FORMAT).option("path", path).option("keys", ",".join(keys)).option("years", f"{years[0]}-{years[1]}")
    return reader.options(**options).load()


def record_responses(panel: DataFrame, path: str, failures: int = 0) -> None:
    """A panel (ticker, date and numbers) as recorded responses, each after ``failures`` attempts that get status 503.

    Spark writes them, a line a key, year and attempt; a body holds the year's bars of one key.
    """
    from pyspark.sql import functions as F

    bar = F.struct(F.col("date").cast("string").alias("date"), *[F.col(c).alias("adjClose" if c == "adjusted_close" else c) for c in NUMBERS if c in panel.columns])
    told = panel.groupBy(F.col("ticker").alias("key"), F.year("date").alias("year")).agg(F.to_json(F.struct(F.collect_list(bar).alias("historical"))).alias("body"))
    each = told.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(failures + 1))))
    answer = F.struct("attempt", F.when(F.col("attempt") <= failures, 503).otherwise(200).alias("status"), F.when(F.col("attempt") > failures, F.col("body")).alias("body"))
    each.select("key", "year", F.to_json(answer).alias("value")).repartition("key", "year").write.partitionBy("key", "year").text(path)


def first_with_rows(candidates: list[DataFrame]) -> DataFrame:
    """The first candidate that has any row, else the last: a chain of fallbacks.  Each is asked for one row until one has it."""
    return next((c for c in candidates[:-1] if not c.isEmpty()), candidates[-1])
