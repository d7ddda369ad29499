"""Exact deduplication by skew-safe combining.

Texts are equal when identical after deleting white space.  Three combining stages, each grouping by the
digest *and* the full normalised content, so a digest collision can never merge two texts:

1. local: Spark's map-side partial aggregation collapses repeats inside a task before anything is shuffled;
2. salted: (digest, content, salt) groups merge what the tasks found, a hot text being spread over the salts;
3. global: the few salt winners of a text are combined.

Every document then finds its winner by digest alone where that digest has one content (which stage 3 has
established on full contents), and by digest and content for digests with several contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import SPACE, materialize, own_columns

#: More than twice the range of a 64-bit id, so that the length decides first and the id second.
_LENGTH_STEP = "20000000000000000000"


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, content, digest and rank: the higher rank stays (more code points, then the smaller id, null ids last)."""
    n = F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("decimal(38,0)")
    step = F.lit(_LENGTH_STEP).cast("decimal(20,0)")
    null_id = F.lit("9999999999999999999").cast("decimal(19,0)")
    rank = (n * step).cast("decimal(38,0)") - F.coalesce(F.col("id").cast("decimal(19,0)"), null_id)
    return (
        own_columns(docs, id_col, text_col).toDF("id", "text")
        .select("id", normalised(F.col("text")).alias("content"), rank.cast("decimal(38,0)").alias("rank"))
        .withColumn("digest", F.unhex(F.sha2("content", 256)))
    )


def content_groups(keyed: DataFrame, salts: int) -> DataFrame:
    """One row per distinct content: digest, content, keep_id, group_size."""
    salted = (
        keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "content", "salt")
        .agg(F.max_by("id", "rank").alias("id"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "content").agg(F.max_by("id", "rank").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text, then the smallest id, stays.

    Edge cases: a null text is empty, so null, empty and blank texts form one group; an empty table gives an
    empty result; a null id loses every tie and is kept only where its group has no other id; rows that
    repeat an id each get a row (``kept`` marks all rows of the id that stays); other columns are ignored,
    whatever their names; very long texts are compared whole.
    """
    keyed = _keyed(docs, id_col, text_col)
    groups = content_groups(keyed, salts)
    # Stage 3 compared full contents: the digests with one content need no text to find their group again.
    by_digest = materialize(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")
        ),
        "digests",
    )
    found = keyed.select("id", "digest").join(by_digest.where("contents = 1").drop("contents"), "digest")
    collided = by_digest.where("contents > 1").select("digest")
    if not collided.isEmpty():
        rare = keyed.join(collided, "digest", "left_semi").join(groups, ["digest", "content"])
        found = found.unionByName(rare.select("digest", "id", "keep_id", "group_size"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
