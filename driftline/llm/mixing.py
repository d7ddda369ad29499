"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is laid out as one shuffled stream of words and cut into blocks of equal size.  Slots of the
mix are numbered; slot ``i`` gets the golden-ratio point ``frac(i * phi)``, which is mapped through the
cumulative targets (in blocks) to a source.  Slots are ranked per source, and rank ``r`` takes block
``r mod blocks`` of its source.  What a source gives is what the schedule serves: its share of the slots to
within the discrepancy of the sequence (a few blocks, whatever the size of the mix).  Only slots that would
go through a source more often than documents may repeat take nothing.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, materialize, own_columns

#: Fractional part of the golden ratio, in units of 2^-64: point i is (i * GOLDEN mod 2^64) / 2^64, cut to 53 bits.
GOLDEN = 11400714819323198485
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Buckets of the hashed order within a source: prefix sums run per bucket, so no source meets in one task.
ORDER_BUCKETS = 1024
#: Cells of the unit interval by which points find their source.
CELLS = 4096
#: A block has 1/LEAST_SLOTS of the mix's words, but at most MOST_BLOCK: a few blocks are then a small part of any mix.
LEAST_SLOTS, MOST_BLOCK = 1 << 16, 256
#: Up to this many sources the table that maps points to sources is broadcast (a row a source and cell); beyond, slots are shuffled to it.
FEW_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """source, source_size -> + weight, target: all words shared by weight, no source above max_repeat times its size.

    Water filling in closed form: sources ordered by capacity per weight fill first; the level of the rest
    is what remains over their weights.  The table has one row per source, so its windows are small.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    sized = sizes.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * F.lit(max_repeat)
    by_ratio = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    filled = sized.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weights"),
        F.coalesce(F.sum(cap).over(by_ratio), F.lit(0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)).alias("weights_before"),
    )
    # The level were this source and all after it (in order of capacity) uncapped; the first that fits is the level.
    level = (F.col("total") - F.col("caps_before")) / (F.col("all_weights") - F.col("weights_before"))
    fits = F.col("level") * F.col("weight") <= cap
    found = filled.withColumn("level", level).withColumn("final", F.min(F.when(fits, F.struct("weights_before", "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), cap.cast("double")).otherwise(F.least(F.col("final") * F.col("weight"), cap.cast("double")))
    return found.select("source", "source_size", "weight", F.round(target, 6).alias("target"))


def source_streams(docs: DataFrame) -> DataFrame:
    """id, source, size -> + start: where the document begins in its source's shuffled stream of words.

    Order within a source: md5 of the id.  Two-level prefix sums: per (source, leading bits) bucket, then
    over the buckets of a source, which are at most ORDER_BUCKETS rows.
    """
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    leading = F.conv(F.substring("key", 1, 4), 16, 10).cast("long")
    keyed = docs.withColumn("key", key).withColumn("bucket", F.floor(leading * F.lit(ORDER_BUCKETS) / F.lit(1 << 16)))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select(
        F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("words").over(order.partitionBy("source")), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(buckets.hint("merge"), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .select("id", "source", "size", (F.col("before") + F.col("inside")).alias("start"))
    )


def block_size(targets: DataFrame, least_slots: int = LEAST_SLOTS, most: int = MOST_BLOCK) -> int:
    """Words of a block, from the words of the mix (one number is read by the driver)."""
    words = targets.agg(F.sum("target")).first()[0] or 0
    return max(1, min(most, int(words) // least_slots))


def golden_point(slot: Column) -> Column:
    """frac(slot * golden ratio) with 53 bits; exact for any slot number below 5e18, as decimals do not wrap."""
    product = slot.cast("decimal(19,0)") * F.lit(Decimal(GOLDEN))
    return F.floor(F.pmod(product, F.lit(Decimal(1 << 64))) / F.lit(Decimal(1 << 11))).cast("long") / F.lit(float(1 << 53))


def schedule(targets: DataFrame, block: int, chunk: int = 1 << 14, max_repeat: int = 3, first_slot: int = 0) -> DataFrame:
    """Slots of the mix that take something: slot, source, rank, blk (block of the source's stream).

    Slots begin at ``first_slot``.  Ranks per source are counted per chunk of slots first and summed over
    chunks, so that a source with a third of all slots is ranked by many tasks.
    """
    spark = targets.sparkSession
    by_name = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    sized = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    # A target in blocks allows for the short block at the end of each round through a source.
    shares = sized.withColumn("share", F.col("target") * F.col("blocks") / F.col("source_size"))
    shares = shares.withColumn("low", F.coalesce(F.sum("share").over(by_name), F.lit(0.0))).withColumn("high", F.col("low") + F.col("share"))
    shares = materialize(shares.select("source", "blocks", "low", "high"), "shares")
    total = shares.agg(F.max("high").alias("all"))
    slots = F.ceil(F.round(F.coalesce(F.col("all"), F.lit(0.0)), 3)).cast("long")  # rounded, as targets are
    # One row per chunk of slots, expanded in parallel; the number of chunks follows the words of the mix.
    chunks = total.select("all", slots.alias("slots")).where("slots > 0").select("*", F.explode(F.expr(f"sequence(0L, (slots - 1) div {chunk}L)")).alias("chunk"))
    chunks = chunks.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk")
    first = F.col("chunk") * F.lit(chunk)
    numbered = chunks.select("chunk", "all", F.explode(F.sequence(first, F.least(first + F.lit(chunk - 1), F.col("slots") - 1))).alias("slot"))
    numbered = numbered.withColumn("slot", F.col("slot") + F.lit(first_slot))
    # The point's source by an equi-join on cells of the unit interval, whatever the number of sources.
    cell = lambda x: F.floor(x / F.col("all") * F.lit(CELLS))
    ranges = shares.crossJoin(F.broadcast(total)).select("source", "blocks", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    drawn = numbered.withColumn("point", golden_point(F.col("slot")) * F.col("all")).withColumn("cell", cell(F.col("point"))).drop("all")
    # Slots grow with the documents and must never be the broadcast side, however small Spark takes an expanded sequence to be.
    few = shares.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    drawn = (drawn.join(F.broadcast(ranges), "cell") if few else drawn.hint("merge").join(ranges, "cell")).where("point >= low and point < high").select("source", "blocks", "chunk", "slot")
    per_chunk = drawn.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = per_chunk.select(
        F.col("source").alias("c_source"), F.col("chunk").alias("c_chunk"),
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    local = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = drawn.select("source", "blocks", "chunk", "slot", local.alias("local")).join(
        before.hint("merge"), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("chunk") == F.col("c_chunk"))
    )
    rank = F.col("before") + F.col("local")
    return ranked.where(rank < F.col("blocks") * F.lit(max_repeat)).select("slot", "source", rank.alias("rank"), (rank % F.col("blocks")).alias("blk"))


def mix_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None, max_repeat: int = 3):
    """(documents with their stream place, source targets, mixed pieces).

    Pieces: slot, rank, source, id, start, from_word, n_words - which words of which document each slot takes.
    ``block`` is the number of words of a block, by default that of ``block_size``.
    """
    sized = own_columns(docs, id_col, source_col, text_col).toDF("id", "source", "text").select("id", "source", word_count(F.col("text")).alias("size"))
    sized = materialize(sized, "sizes")  # texts are read and counted once
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeat), "targets")
    streams = source_streams(sized)
    block = block or block_size(targets)
    b = F.lit(block)
    pieces = (
        streams.where("size > 0")
        .select("id", "source", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("blk"))
        .withColumn("from_word", F.greatest(F.col("blk") * b - F.col("start"), F.lit(0)))
        .withColumn("n_words", F.least(F.col("size"), (F.col("blk") + 1) * b - F.col("start")) - F.col("from_word"))
    )
    slots = schedule(targets, block, max_repeat=max_repeat).select("slot", "rank", F.col("source").alias("t_source"), F.col("blk").alias("t_blk"))
    # Both sides grow with the documents, so neither may be broadcast, however well it packs.
    mixed = slots.hint("merge").join(pieces, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("blk") == F.col("t_blk")))
    return streams, targets, mixed.select("slot", "rank", "source", "id", "start", "from_word", "n_words")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None, max_repeat: int = 3) -> DataFrame:
    """Per document: ``id_col``, size, source_size, target, taken.

    ``taken`` are the words of the slots that the schedule served: near the target of the source (within a few
    blocks), at most ``max_repeat`` times the size of any document.

    A source with no words has target 0; a null source is a source of its own, last in order; a null or
    empty text has size 0 and is never taken; rows that repeat an id (or have none) are separate documents,
    each with its own place in the stream; an empty table gives an empty result; other columns are ignored.
    """
    streams, targets, mixed = mix_pieces(docs, id_col, text_col, source_col, block, max_repeat)
    taken = mixed.groupBy("source", "start").agg(F.sum("n_words").alias("taken")).select(
        F.col("source").alias("m_source"), F.col("start").alias("m_start"), "taken"
    )
    facts = targets.select(F.col("source").alias("f_source"), "source_size", "target")
    return (
        streams.join(taken.hint("merge"), (F.col("size") > 0) & (F.col("start") == F.col("m_start")) & F.col("source").eqNullSafe(F.col("m_source")), "left")
        .join(facts, F.col("source").eqNullSafe(F.col("f_source")))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
