"""File sources and sinks: panels from folders of CSV files, snapshots from JSON, texts from binary files, partitioned panels."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adjusted_close", "volume", "vwap")]
)
LABEL_SCHEMA = T.StructType([T.StructField(c, T.DateType() if c.endswith("date") else T.StringType()) for c in ("announcement_date", "effective_date", "index", "action", "ticker", "company_name")])
SHARES_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), T.StructField("shares_outstanding", T.LongType()), T.StructField("source", T.StringType()), T.StructField("quality_flag", T.StringType())])
ACTIONS = ("Addition", "Removal", "Promotion", "Demotion")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Where it is not set, a session in one process (``local[...]``, as in tests) gets a temporary one; a cluster is refused.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftline-checkpoints-"))
        found = context.getCheckpointDir()
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else writes to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and every later use reads the table."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names; globs count if anything matches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; those that are missing are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_price_folder(spark: SparkSession, folder: str, source: str | None = None, skip: tuple[str, ...] = ("shares", "iwf")) -> DataFrame:
    """All CSV files of a folder as one panel; the ticker is the file's stem, the source the folder's name less its ending.

    The files of a folder share one header; columns that it lacks are null.  A folder without CSV files gives
    an empty panel.
    """
    full = T.StructType([*PRICE_SCHEMA, T.StructField("ticker", T.StringType()), T.StructField("source", T.StringType())])
    if not exists(spark, f"{folder}/*.csv"):
        return empty(spark, full)
    name = source or folder.rstrip("/").rsplit("/", 1)[-1].removesuffix("_clean").removesuffix("_raw")
    raw = spark.read.option("header", True).csv(f"{folder}/*.csv")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return ensure_columns(raw.select("*", stem.alias("ticker"), F.lit(name).alias("source")), full).where(~F.col("ticker").isin(*skip))


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, defaults: dict[str, str] | None = None) -> DataFrame:
    """A reference table with missing columns as nulls (or defaults); an empty table if the file is not there."""
    if not exists(spark, path):
        return empty(spark, schema)
    rows = ensure_columns(spark.read.option("header", True).csv(path), schema)
    return rows.fillna(defaults or {})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Index change labels: tickers trimmed and upper-cased, index upper, action title case; rows with other actions are refused."""
    rows = read_csv_table(spark, path, LABEL_SCHEMA)
    clean = rows.withColumns({"ticker": F.upper(F.trim("ticker")), "index": F.upper("index"), "action": F.initcap(F.trim("action"))})
    known = F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    return clean.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("invalid action: "), F.coalesce("action", F.lit("null"))))))


def prefer(first: DataFrame, second: DataFrame, key: str = "ticker") -> DataFrame:
    """All of ``first``, and of ``second`` only the keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """JSON of date -> [{ticker, name, ...}] as rows (snapshot, ticker, name, sector)."""
    return snapshot_rows(spark.read.option("wholetext", True).text(path))


def snapshot_rows(text: DataFrame) -> DataFrame:
    """(value: JSON of date -> [{ticker, name, ...}]) -> snapshot, ticker, name, sector; what is not JSON gives nothing."""
    kind = "map<string,array<struct<ticker:string,name:string,sector:string>>>"
    return text.select(F.explode(F.from_json("value", kind)).alias("snapshot", "items")).select(F.to_date("snapshot").alias("snapshot"), F.explode("items").alias("i")).select("snapshot", "i.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of text files of any extension, whole; bytes that are not UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("text"))


def write_partitioned(panel: DataFrame, path: str, by: str = "ticker", format: str = "parquet") -> None:
    """A panel in folders by ``by``, a file a year and key, each sorted by date.

    One shuffle, so that a folder is not written by every task; years part a hot key over several tasks.
    """
    dealt = panel.repartition(by, F.year("date")).sortWithinPartitions(by, "date")
    dealt.write.mode("overwrite").partitionBy(by).option("header", True).format(format).save(path)


def write_named_files(panel: DataFrame, folder: str, by: str = "ticker") -> None:
    """One CSV file per key, named after it, as ``read_price_folder`` reads them; for panels whose keys fit a task each.

    Spark writes the files; the driver only gives them their names.
    """
    spark, parts = panel.sparkSession, f"{folder}/_parts"
    panel.repartition(by).sortWithinPartitions(by, "date").write.partitionBy(by).option("header", True).csv(parts)
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(place(f"{parts}/{by}=*/*.csv")):
        at = status.getPath()
        fs.rename(at, place(f"{folder}/{at.getParent().getName().split('=', 1)[1]}.csv"))
    fs.delete(place(parts), True)


def read_prices(spark: SparkSession, path: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A panel of CSV files in folders by ticker: the required columns of some tickers from ``start`` to ``end``, both included.

    Only the folders of those tickers are listed and read.  A folder that is not there gives an empty panel.
    """
    full = T.StructType([*PRICE_SCHEMA, T.StructField("ticker", T.StringType())])
    if not exists(spark, path):
        return empty(spark, full)
    rows = spark.read.option("header", True).csv(path)
    rows = rows if tickers is None else rows.where(F.col("ticker").isin(tickers))
    return ensure_columns(rows, full).where(F.col("date").between(F.coalesce(F.lit(start).cast("date"), F.col("date")), F.coalesce(F.lit(end).cast("date"), F.col("date"))))


def read_first_found(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The panel of the first folder that holds CSV files (reconciled before raw); an empty one if none does."""
    found = [f for f in folders if exists(spark, f"{f}/*.csv")]
    return read_price_folder(spark, (found or folders)[0])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


MASTER_SCHEMA = T.StructType(
    [T.StructField(c, T.DateType() if c.endswith("date") else T.BooleanType() if c.endswith("flag") else T.StringType()) for c in ("canonical_ticker", "company_name", "sector", "first_seen_date", "active_flag", "notes")]
)


def write_json(rows: DataFrame, path: str) -> None:
    """Metrics or settings, a JSON object a row; nulls are written too."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_settings(spark: SparkSession, path: str, kind):
    """A dataclass from a JSON object in a small file; values that the file lacks keep their defaults, others are refused."""
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    given, known = json.loads(text), {f.name for f in fields(kind)}
    if not set(given) <= known:
        raise ValueError(f"unknown settings: {sorted(set(given) - known)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def with_provenance(series: DataFrame, name: str, source: str, note: str) -> DataFrame:
    """A series + the name it goes by, where it is from and a note."""
    return series.withColumns({"ticker": F.lit(name), "source": F.lit(source), "note": F.lit(note)})


def write_labels(labels: DataFrame, path: str) -> None:
    bad = labels.where(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"invalid action: {bad[0]['action']}")
    labels.write.mode("overwrite").option("header", True).csv(path)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing without the keys that ``new`` has, and all of ``new``."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
