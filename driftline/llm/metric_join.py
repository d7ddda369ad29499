"""Near-duplicate vectors by an exact metric range join.

Cosine >= c between vectors is Euclidean distance <= sqrt(2 - 2c) between their unit vectors.  Pivots (a
bounded sample) divide each label's vectors into cells of the nearest pivot.  A vector at distance d_j from
pivot j and d_h from its own pivot h is copied into cell j only when the triangle inequality leaves room for
a partner there: d_j - radius_j <= r, and (d_j^2 - d_h^2) / (2 d_hj) <= r, its distance to the half-space of
cell j.  So all partners of a vector are in its home cell, and the cells are joined independently.  Large
cells are joined in blocks of home vectors.  Identical vectors are one weighted vector throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import materialize, own_columns
from driftline.llm.components import connected_components

#: Vectors of a label to each pivot, most pivots in all (they are sent to every task), home vectors in a block.
PER_PIVOT, MOST_PIVOTS, BLOCK = 1500, 4096, 2048
_ROUNDING = 1e-9


def _usable(embedding):
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    raw = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    scale = np.abs(raw).max(axis=1, keepdims=True)  # keeps squares finite
    raw = raw / scale
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _by_space(batch: pa.RecordBatch):
    """(label, dimension, row numbers) of a batch with columns label, embedding first."""
    labels = batch.column(0).to_pylist()
    dims = [len(x) for x in batch.column(1)]
    spaces: dict[tuple, list[int]] = {}
    for i, space in enumerate(zip(labels, dims)):
        spaces.setdefault(space, []).append(i)
    return spaces.items()


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * units @ pivots.T))


def _home(pivots: dict):
    """(label, embedding, rep, n) -> + cell, away: the nearest pivot of the label and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for space, rows in _by_space(batch):
                if space in pivots:
                    d = _distances(_unit(batch.column(1).take(pa.array(rows)), space[1]), pivots[space])
                    cell[rows], away[rows] = d.argmin(axis=1), d.min(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(away)], names=["label", "embedding", "rep", "n", "cell", "away"])

    return run


def _copies(pivots: dict, radius: dict, reach: float):
    """(label, embedding, rep, n, cell, away) -> a row for the home cell and one for each cell that may hold a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {}  # pivot to pivot, calculated once a task
        for batch in batches:
            home = np.asarray(batch.column(4))
            take, cells, homes = [np.arange(batch.num_rows)], [home], [np.ones(batch.num_rows, dtype=bool)]
            for space, rows in _by_space(batch):
                if space not in pivots:
                    continue
                own, rows = home[rows], np.array(rows)
                d = _distances(_unit(batch.column(1).take(pa.array(rows)), space[1]), pivots[space])
                d_own = d[np.arange(len(rows)), own]
                if space not in apart:
                    apart[space] = np.maximum(2.0 * _distances(pivots[space], pivots[space]), 1e-300)
                beyond = (d * d - d_own[:, None] ** 2) / apart[space][own]
                room = (beyond <= reach + _ROUNDING) & (d - radius[space][None, :] <= reach + _ROUNDING)
                room[np.arange(len(rows)), own] = False
                at, cell = np.nonzero(room)
                take.append(rows[at])
                cells.append(cell.astype(np.int32))
                homes.append(np.zeros(len(at), dtype=bool))
            picked = batch.select([0, 1, 2, 3]).take(pa.array(np.concatenate(take)))
            yield pa.record_batch([*picked.columns, pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes))], names=["label", "embedding", "rep", "n", "cell", "home"])

    return run


class _Block:
    """Home vectors of one block, joined with the vectors of the cell as they stream by."""

    def __init__(self, dim: int, least: float):
        self.dim, self.least, self.homes, self.ids = dim, least, [], []
        self.ready = None

    def add_homes(self, raw: np.ndarray, ids: list[int]) -> None:
        self.homes.append(raw)
        self.ids += ids

    def join(self, raw: np.ndarray, ids: list[int], weights: list[int], edges: list[tuple[int, int]]) -> None:
        if self.ready is None:
            homes = np.concatenate(self.homes) if self.homes else np.empty((0, self.dim))
            self.ready = homes, np.sqrt((homes * homes).sum(axis=1)), np.array(self.ids, dtype=np.int64)
            self.links, self.group = np.zeros(len(homes), dtype=np.int64), np.arange(len(homes))
        homes, norms, own = self.ready
        other, weight = np.array(ids, dtype=np.int64), np.array(weights, dtype=np.int64)
        cosine = homes @ raw.T / (norms[:, None] * np.sqrt((raw * raw).sum(axis=1))[None, :])
        near = (cosine >= self.least) & (own[:, None] != other[None, :])
        self.links += near @ weight
        for j in np.nonzero(near.any(axis=0))[0]:
            rows = np.nonzero(near[:, j])[0]
            edges.append((int(own[rows[0]]), int(other[j])))
            for g in np.unique(self.group[rows]).tolist():
                if g != self.group[rows[0]]:
                    edges.append((int(own[rows[0]]), int(own[g])))
                    self.group[self.group == g] = self.group[rows[0]]


def _join(least: float):
    """Sorted (label, cell, block, dim, partner, rep, n, embedding) -> (a, b, links): spanning links, and links per home vector."""

    def out(edges, links):
        rows = [(a, b, None) for a, b in edges] + [(a, None, n) for a, n in links]
        return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, edges, links = None, None, [], []

        def close():
            if block is not None and block.ready is not None:
                links.extend(zip(block.ready[2].tolist(), block.links.tolist()))

        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(5)]))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and end - at < 4096:
                    end += 1
                if keys[at][:4] != key:
                    close()
                    key, block = keys[at][:4], _Block(keys[at][3], least)
                part = batch.slice(at, end - at)
                raw = np.asarray(part.column(7).flatten(), dtype=np.float64).reshape(-1, key[3])
                raw = raw / np.abs(raw).max(axis=1, keepdims=True)
                ids = part.column(5).to_pylist()
                if keys[at][4]:
                    block.join(raw, ids, part.column(6).to_pylist(), edges)
                else:
                    block.add_homes(raw, ids)
                at = end
            if len(edges) + len(links) > 50_000:
                yield out(edges, links)
                edges.clear(), links.clear()
        close()
        yield out(edges, links)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.98) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    ``least_cosine`` (which must be positive).

    Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a
    null label or id, link with nothing; vectors of different length never link; equal vectors link with each
    other; rows that repeat an id are one vertex of the graph and each gets a row: n_links is that of the row's
    own vector (equal vectors on other rows count, whatever their ids), component_id the smallest id that any
    vector of the id reaches; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    source = own_columns(vectors, id_col, vector_col, label_col).toDF("id", "embedding", "label")
    good = source.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding")))
    named = good.groupBy("label", "embedding").agg(F.min("id").cast("long").alias("least"), F.count(F.lit(1)).alias("n"))
    # A class has a number of its own: an id may stand for several vectors.  Written, so that the numbers are final.
    named = materialize(named.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    classes = named.select("label", "embedding", "rep", "n")
    large = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("m")).where(f"m > {PER_PIVOT}")
    wanted = large.agg(F.sum("m")).first()[0] or 0
    chosen = (
        classes.withColumn("dim", F.size("embedding")).join(large.select("label", "dim"), ["label", "dim"], "left_semi")
        .orderBy(F.xxhash64("embedding"), "embedding").limit(min(MOST_PIVOTS, math.ceil(wanted / PER_PIVOT))).select("label", "embedding").collect()
    ) if wanted else []
    found: dict[tuple, list] = {}
    for label, embedding in chosen:
        found.setdefault((label, len(embedding)), []).append(embedding)
    pivots = {space: _unit(pa.array(rows, pa.list_(pa.float64())), space[1]) for space, rows in found.items()}
    schema = f"label {classes.schema['label'].dataType.simpleString()}, embedding {classes.schema['embedding'].dataType.simpleString()}, rep long, n long"
    placed = materialize(classes.mapInArrow(_home(pivots), schema + ", cell int, away double"), "cells")
    radius = {space: np.zeros(len(rows)) for space, rows in pivots.items()}
    reached = placed.groupBy("label", F.size("embedding").alias("dim"), "cell").agg(F.max("away"), F.count(F.lit(1)).alias("homes"))
    if pivots:  # one row for each pivot at most
        known = spark.createDataFrame([(int(d),) for d in sorted({s[1] for s in pivots})], "dim int")
        for label, dim, cell, most, _ in reached.join(large.select("label", "dim"), ["label", "dim"], "left_semi").join(known, "dim", "left_semi").select("label", "dim", "cell", "max(away)", "homes").collect():
            if (label, dim) in radius:
                radius[label, dim][cell] = most
    reach = math.sqrt(2.0 - 2.0 * least_cosine)
    copies = placed.mapInArrow(_copies(pivots, radius, reach), schema + ", cell int, home boolean").withColumn("dim", F.size("embedding"))
    blocks = reached.select("label", "dim", "cell", F.ceil(F.col("homes") / F.lit(BLOCK)).cast("int").alias("blocks"))
    cells = copies.join(blocks, ["label", "dim", "cell"])
    homes = cells.where("home").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("partner", F.lit(False))
    partners = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("partner", F.lit(True))
    columns = ["label", "cell", "block", "dim", "partner", "rep", "n", "embedding"]
    key = ["label", "cell", "block", "dim"]
    dealt = homes.select(columns).unionByName(partners.select(columns)).repartition(*key).sortWithinPartitions(*key, "partner", "rep")
    joined = materialize(dealt.mapInArrow(_join(least_cosine), "a long, b long, links long"), "links")
    # Ids that stand for several vectors tie their classes together.
    owners = materialize(good.join(named.select("label", "embedding", "rep"), ["label", "embedding"]).select(F.col("id").cast("long").alias("id"), "rep"), "owners")
    several = owners.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    bridges = owners.join(several.select("id", "a"), "id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    roots = connected_components(joined.where("b is not null").select("a", "b").unionByName(bridges))
    links = joined.where("links is not null").select(F.col("a").alias("rep"), "links")
    rooted = named.select("rep", "least", "n").join(links, "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    rooted = materialize(rooted.select("rep", "least", (F.col("links") + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root")), "roots")
    component = rooted.groupBy("root").agg(F.min("least").alias("component"))
    per_class = rooted.join(component, "root").select("rep", "n_links", "component")
    linked = owners.join(per_class, "rep").select("id", "n_links", "component")
    alone = source.where(~(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding")))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
