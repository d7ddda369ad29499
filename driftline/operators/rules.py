"""Index membership rules: buffered decisions, pairing of additions and removals, hybrid scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.features import min_max
from driftline.operators.ranks import beside, row_numbers


def decide(ranked: DataFrame, add_buffer: int, del_buffer: int) -> DataFrame:
    """ranked: fmc_rank, member, liquidity_pass -> + action, confidence, reason.

    A member that fails liquidity leaves; another leaves beyond the removal buffer; a liquid outsider enters
    within the addition buffer.  Confidence is high five percent beyond the buffer.
    """
    member, liquid, rank = F.coalesce("member", F.lit(False)), F.coalesce("liquidity_pass", F.lit(False)), F.col("fmc_rank")
    action = F.when(member & ~liquid, "Removal").when(member & (rank > del_buffer), "Removal").when(~member & liquid & (rank <= add_buffer), "Addition").otherwise("no change")
    confidence = (
        F.when(member & ~liquid, "high")
        .when(member & (rank > 1.05 * del_buffer), "high").when(member & (rank > del_buffer), "medium")
        .when(~member & liquid & (rank <= 0.95 * add_buffer), "high").when(~member & liquid & (rank <= add_buffer), "medium")
        .otherwise("low")
    )
    reason = (
        F.when(member & ~liquid, "fails liquidity").when(member & (rank > del_buffer), F.concat(F.lit("rank "), rank.cast("string"), F.lit(" beyond removal buffer")))
        .when(~member & ~liquid, "not liquid").when(~member & (rank <= add_buffer), F.concat(F.lit("rank "), rank.cast("string"), F.lit(" within addition buffer"))).otherwise("inside buffers")
    )
    return ranked.withColumns({"action": action, "confidence": confidence, "reason": reason})


def pair(decided: DataFrame, by: list[str]) -> DataFrame:
    """Balance additions and removals within ``by``: backfill forced removals with the best liquid outsiders, then trim both sides to the shorter.

    Counts are a row a group, and places come from ranges, so no group meets in one task.
    """
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    forced = (F.col("action") == "Removal") & ~F.coalesce("liquidity_pass", F.lit(False))
    spare = (F.col("action") == "no change") & ~F.coalesce("member", F.lit(False)) & F.coalesce("liquidity_pass", F.lit(False))
    marked = decided.withColumns({"forced": forced, "spare": spare})
    placed = row_numbers(marked, [*by, "spare"], [F.col("fmc_rank").asc(), F.col("ticker").asc()], "_place")
    needed = F.greatest(F.lit(0), count(F.col("forced")) - count(F.col("action") == "Addition"))
    told = beside(placed, placed.groupBy(*by).agg(needed.alias("_needed")), by)
    filled = told.withColumn("fill", F.col("spare") & (F.col("_place") <= F.col("_needed"))).withColumns(
        {
            "action": F.when(F.col("fill"), "Addition").otherwise(F.col("action")),
            "confidence": F.when(F.col("fill"), "medium").otherwise(F.col("confidence")),
            "reason": F.when(F.col("fill"), F.concat("reason", F.lit("; backfill"))).otherwise(F.col("reason")),
        }
    )
    side = F.when(F.col("action") == "Addition", "add").when((F.col("action") == "Removal") & ~F.col("forced"), "drop").otherwise("rest")
    sided = filled.withColumn("side", side)
    order = F.when(F.col("side") == "drop", -F.col("fmc_rank")).otherwise(F.col("fmc_rank"))
    pairs = F.least(count(F.col("side") == "add"), count(F.col("side") == "drop"))
    numbered = row_numbers(sided, [*by, "side"], [order.asc(), F.col("ticker").asc()], "_at")
    counted = beside(numbered, numbered.groupBy(*by).agg(pairs.alias("_pairs")), by)
    trimmed = counted.withColumn("trim", (F.col("side") != "rest") & (F.col("_pairs") > 0) & (F.col("_at") > F.col("_pairs")))
    return trimmed.withColumns(
        {
            "action": F.when(F.col("trim"), "no change").otherwise(F.col("action")),
            "confidence": F.when(F.col("trim"), "borderline").otherwise(F.col("confidence")),
            "reason": F.when(F.col("trim"), F.concat("reason", F.lit("; trimmed to balance index count"))).otherwise(F.col("reason")),
        }
    ).drop("forced", "spare", "fill", "side", "trim", "_place", "_needed", "_at", "_pairs")


def tag_hierarchy(decided: DataFrame, parents: DataFrame, group: str) -> DataFrame:
    """Moves inside the ticker's parent group become Promotion or Demotion; + predicted_member.

    parents: ticker, parent (one row a ticker); tickers without a parent keep their action.
    """
    tagged = decided.join(parents, "ticker", "left").withColumn("_inside", F.coalesce(F.col("parent") == F.col(group), F.lit(False)))
    move = F.when(F.col("_inside") & (F.col("action") == "Addition"), "Promotion").when(F.col("_inside") & (F.col("action") == "Removal"), "Demotion").otherwise(F.col("action"))
    tagged = tagged.withColumn("action", move).drop("_inside", "parent")
    joins, leaves = F.col("action").isin("Addition", "Promotion"), F.col("action").isin("Removal", "Demotion")
    return tagged.withColumn("predicted_member", F.when(joins, F.lit(True)).when(leaves, F.lit(False)).otherwise(F.col("member")))


def conviction(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.60, "medium").when(score >= 0.45, "low").otherwise("none")


def hybrid_score(panel: DataFrame, weights: dict[str, float], by: list[str]) -> DataFrame:
    """+ hybrid (weighted mean of min-max scaled columns, clipped to [0, 1]) and its conviction bucket."""
    total = sum(weights.values())
    score = sum((min_max(c, by) * w for c, w in weights.items()), F.lit(0.0)) / total
    out = panel.withColumn("hybrid", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("bucket", conviction(F.col("hybrid")))
