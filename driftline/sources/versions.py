"""A keyed table that is changed by upserts and stays whole when a job fails between write and swap.

``path/data/<id>/bucket=<b>`` holds rows, in a fixed number of buckets by a hash of the key.  A version is a small file
under ``path/versions`` that names, for every bucket, the folder that holds it.  An upsert writes the buckets it touches
to a new folder (``stage``) and then adds a version that names them (``publish``): readers see the old version until
Spark has marked the new one as written, and a stage that is never published is never read.  Folders are not changed
once they are written, so a reader keeps what it began to read.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


@dataclass(frozen=True)
class Version:
    """number: 0 for a table without a version; folders: bucket -> folder, buckets without rows have none."""

    number: int
    schema: T.StructType
    key: list[str]
    buckets: int
    folders: dict[int, str]


def _numbers(spark: SparkSession, path: str, marked: bool) -> list[int]:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/*{'/_SUCCESS' if marked else ''}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return [int((s.getPath().getParent() if marked else s.getPath()).getName()) for s in found]


def live(spark: SparkSession, path: str) -> Version | None:
    """The last version that was written whole; None if there is none."""
    numbers = _numbers(spark, path, True)
    if not numbers:
        return None
    text = spark.read.text(f"{path}/versions/{max(numbers)}").first().value
    told = json.loads(text)
    return Version(max(numbers), T.StructType.fromJson(told["schema"]), told["key"], told["buckets"], {int(b): f for b, f in told["folders"].items()})


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The live version's rows, of some buckets only if ``only`` is given; an upsert that runs meanwhile doesn't change them."""
    now = live(spark, path)
    if now is None:
        raise ValueError(f"no version at {path}")
    return _rows(spark, path, now, only)


def _rows(spark: SparkSession, path: str, now: Version, only: list[int] | None = None) -> DataFrame:
    places = [f"{path}/data/{f}/bucket={b}" for b, f in now.folders.items() if only is None or b in only]
    return spark.read.schema(now.schema).parquet(*places) if places else spark.createDataFrame([], now.schema)


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def stage(spark: SparkSession, path: str, new: DataFrame, key: list[str], buckets: int = BUCKETS) -> Version:
    """Write the buckets that ``new`` touches, with all of ``new`` and the live rows of other keys, and publish nothing.

    All rows of a key in ``new`` take the place of all its rows in the table, so a rerun gives the same table; a null in a
    key equals a null.  ``new`` has the table's columns (the first upsert gives them); an empty ``new`` changes nothing.
    """
    now = live(spark, path) or Version(0, T.StructType([T.StructField(f.name, f.dataType) for f in new.schema]), list(key), buckets, {})
    if list(key) != now.key or sorted(new.columns) != sorted(now.schema.names):
        raise ValueError(f"the table has key {now.key} and columns {now.schema.names}")
    add = new.select(*[F.col(f.name).cast(f.dataType) for f in now.schema])
    touched = sorted(r.bucket for r in add.select(bucket_of(now.key, now.buckets).alias("bucket")).distinct().collect())  # ``buckets`` rows at most
    keys = add.select(*[F.col(k).alias(f"_new_{k}") for k in now.key]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in now.key]
    kept = _rows(spark, path, now, touched).join(keys, same, "left_anti")
    folder = uuid.uuid4().hex
    merged = kept.unionByName(add).withColumn("bucket", bucket_of(now.key, now.buckets))
    merged.repartition("bucket", F.xxhash64(*now.schema.names) % 8).write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    return Version(now.number, now.schema, now.key, now.buckets, now.folders | {b: folder for b in touched})


def publish(spark: SparkSession, path: str, staged: Version) -> int:
    """Make a staged version the live one; refused if another was published since it was staged."""
    now = live(spark, path)
    if (now.number if now else 0) != staged.number:
        raise ValueError("another version was published meanwhile: stage again")
    number = max([0, *_numbers(spark, path, False)]) + 1
    told = json.dumps({"schema": json.loads(staged.schema.json()), "key": staged.key, "buckets": staged.buckets, "folders": staged.folders})
    spark.range(1).select(F.lit(told).alias("value")).coalesce(1).write.text(f"{path}/versions/{number}")
    return number


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], buckets: int = BUCKETS) -> int:
    """``stage`` and ``publish``; the number of the new version."""
    return publish(spark, path, stage(spark, path, new, key, buckets))


def tidy(spark: SparkSession, path: str) -> list[str]:
    """Delete the data that the live version doesn't name (old versions, stages that failed); for times without readers and writers."""
    now, place = live(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    used = set(now.folders.values()) if now else set()
    gone = [s.getPath() for s in fs.globStatus(place(f"{path}/data/*")) or [] if s.getPath().getName() not in used]
    for at in gone:
        fs.delete(at, True)
    return [at.getName() for at in gone]
