"""Shared helpers of the training-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.files import new_folder

#: ASCII white space and its complement, as the query contracts define words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back; ``options`` are the writer's.

    The table survives the loss of any executor; it is smaller than a row checkpoint because it is
    columnar and compressed.  The folder belongs to the application and goes with it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables whose consumers are materialized themselves; Spark's cleaner drops the shuffle files behind them."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.stored_at
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller can never clash with internal names."""
    return df.select(*[F.col(f"`{n}`") for n in names])
