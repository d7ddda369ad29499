"""Versioned upserts: against a dict of rows, a failure between write and swap, reruns, null keys, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.sources import versions as V

SCHEMA = "k string, d int, x double"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_against_a_dict(spark, path):
    rng, want = random.Random(4), {}
    for _ in range(4):
        keys = rng.sample(["a", "b", "c", "d", "e", None, ""], 3)
        new = [(k, rng.randint(1, 3), float(rng.randint(1, 9))) for k in keys for _ in range(rng.randint(1, 3))]
        for k in keys:
            want[k] = [r for r in new if r[0] == k]
        V.upsert(spark, path, spark.createDataFrame(new, SCHEMA), ["k"], 4)
        assert rows(V.read(spark, path)) == sorted((r for own in want.values() for r in own), key=str)
    only = V.bucket_of(["k"], 4)
    assert V.read(spark, path, [1]).where(only != 1).count() == 0
    assert V.live(spark, path).number == 4


def test_failure_between_write_and_swap(spark, path, monkeypatch):
    """The staged rows are never seen; a rerun, and a rerun of that, give the table that was wanted."""
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], SCHEMA)
    new = spark.createDataFrame([("b", 2, 5.0), ("c", 2, 6.0)], SCHEMA)
    V.upsert(spark, path, old, ["k"], 8)
    held = V.read(spark, path)
    with monkeypatch.context() as m:
        m.setattr(V, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            V.upsert(spark, path, new, ["k"], 8)
    assert rows(V.read(spark, path)) == rows(old)
    # a version whose file was begun but never marked as written isn't live either
    begun = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/2")
    begun.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(begun)
    assert rows(V.read(spark, path)) == rows(old)
    want = [("a", 1, 1.0), ("b", 2, 5.0), ("c", 2, 6.0)]
    for number in (3, 4):
        assert V.upsert(spark, path, new, ["k"], 8) == number and rows(V.read(spark, path)) == want
    assert rows(held) == rows(old)
    assert len(V.tidy(spark, path)) >= 2 and rows(V.read(spark, path)) == want and V.tidy(spark, path) == []


def test_untouched_buckets_keep_their_files(spark, path):
    V.upsert(spark, path, spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("d"), F.lit(0.5).alias("x")), ["k"], 16)
    before = V.live(spark, path).folders
    V.upsert(spark, path, spark.createDataFrame([("7", 2, 1.5)], SCHEMA), ["k"], 16)
    after = V.live(spark, path).folders
    assert sum(after[b] != before[b] for b in before) == 1 and V.read(spark, path).count() == 1000
    assert V.read(spark, path).where("k = '7'").first().x == 1.5


def test_edges(spark, path):
    with pytest.raises(ValueError):
        V.read(spark, path)
    none = spark.createDataFrame([], SCHEMA)
    V.upsert(spark, path, none, ["k"])
    assert V.read(spark, path).columns == ["k", "d", "x"] and V.read(spark, path).count() == 0
    V.upsert(spark, path, spark.createDataFrame([("a", 1, None)], SCHEMA).select("x", "d", "k"), ["k"])
    V.upsert(spark, path, none, ["k"])
    assert rows(V.read(spark, path)) == [("a", 1, None)]
    one, two = (V.stage(spark, path, spark.createDataFrame([("b", i, 1.0)], SCHEMA), ["k"]) for i in (1, 2))
    V.publish(spark, path, one)
    with pytest.raises(ValueError):
        V.publish(spark, path, two)
    with pytest.raises(ValueError):
        V.stage(spark, path, none, ["d"])
