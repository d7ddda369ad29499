"""Near-duplicate detection on word shingles by chosen-path set similarity join.

Documents with equal shingle sets form one class; one representative of each is searched.  In each of
several independent trees a representative walks from the root: at a node, the node's own hash selects a
minwise coordinate (and with the branching probability a second one), and the representative goes to the
child named by its minwise token there.  Similar sets share paths.  Nodes still large after the first levels
branch on; small nodes are compared exhaustively on the full shingle sets, each pair only in the first node
that the two share; nodes that are still large at the last level are indexed on prefixes of their sets, which
loses no link.  Inside a node only pairs not yet connected are compared, so what leaves a node is a
spanning set of its links, never all pairs.  Components of the links, joined over nodes, are exact but for
pairs that no tree brings together.  All trees draw from the same coordinates, so their misses go together: over
the binomial spread of a pair's agreement, one at the threshold of 0.85 (0.8) is missed with a chance of about
2e-6 (3e-5) where nodes are small after three levels, and 2e-4 (2e-3) where they branch on to six.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import materialize, own_columns
from driftline.llm.components import connected_components
from driftline.llm.streams import sorted_groups

#: Minwise coordinates of a document, independent trees, levels before the first comparison, most levels,
#: size up to which a node is compared, and the expected number of children (1 + BRANCH).
COORDINATES, TREES, FIRST_LEVELS, MOST_LEVELS, SMALL, BRANCH = 96, 12, 3, 6, 128, 0.25
#: Most members and most text bytes of a group that one task compares at once; larger nodes are compared in blocks.
BLOCK_ROWS, BLOCK_BYTES = 3000, 48 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.array([xxhash.xxh64_intdigest(f"coordinate {i}") for i in range(COORDINATES)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words: the whole sequence as one; no word: empty.

    A-Z are lower-cased; words are runs of anything but ASCII white space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        out = _mix(out ^ hashed[j : len(words) - width + 1 + j])
    return np.unique(out)


def minwise(tokens: np.ndarray) -> np.ndarray:
    """COORDINATES minwise values (32 bits each) of a non-empty set; long sets go in pieces of bounded memory."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(tokens), 2048):
        x = (tokens[at : at + 2048, None] ^ _SEEDS[None, :]) * _M1
        x ^= x >> np.uint64(32)
        x *= _M2
        best = np.minimum(best, x.min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, digests, signatures = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = shingle_set(text, k)
                    sizes.append(len(tokens))
                    digests.append(xxhash.xxh128_digest(tokens.tobytes()) + len(tokens).to_bytes(4, "big") if len(tokens) else None)
                    signatures.append(minwise(tokens) if len(tokens) else None)
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))],
                    names=["id", "text_hash", "n_shingles", "digest", "signature"],
                )

    return run


def _children(signatures: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: each (row, node) goes to the child at the node's first coordinate, some also at its second."""
    drawn = _mix(nodes ^ np.uint64(0x9E3779B97F4A7C15))
    first = (drawn % np.uint64(COORDINATES)).astype(np.int64)
    second = ((drawn >> np.uint64(20)) % np.uint64(COORDINATES)).astype(np.int64)
    also = (((drawn >> np.uint64(40)) & np.uint64(0xFFFF)) < np.uint64(int(BRANCH * 65536))) & (second != first)
    rows2 = np.concatenate([rows, rows[also]])
    parents = np.concatenate([nodes, nodes[also]])
    coordinate = np.concatenate([first, second[also]])
    token = signatures[rows2, coordinate].view(np.uint32).astype(np.uint64)
    return rows2, _mix(_mix(parents + np.uint64(1)) ^ (token << np.uint64(8)) ^ coordinate.astype(np.uint64))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int32).reshape(-1, COORDINATES)


def _roots(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = _mix(np.arange(1, trees + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures, ids = _matrix(batch.column(1)), np.asarray(batch.column(0), dtype=np.int64)
            rows, nodes = np.repeat(np.arange(len(ids)), trees), np.tile(starts, len(ids))
            for _ in range(FIRST_LEVELS):
                rows, nodes = _children(signatures, rows, nodes)
            yield pa.record_batch([pa.array(ids[rows]), pa.array(nodes.view(np.int64))], names=["id", "node"])

    return run


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, signature) -> (id, child)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = np.asarray(batch.column(1), dtype=np.int64).view(np.uint64)
        rows, children = _children(_matrix(batch.column(2)), np.arange(len(nodes)), nodes)
        yield pa.record_batch([pa.array(np.asarray(batch.column(0), dtype=np.int64)[rows]), pa.array(children.view(np.int64))], names=["id", "node"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int(np.count_nonzero(b[at] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _partners(sets: list[np.ndarray], percent: int):
    """For each set the others that may be linked with it, by an index on prefixes: a function from place to places.

    With the tokens of every set in one order, rarest first, linked sets share one of the first
    size - ceil(percent / 100 * size) + 1 tokens of each, so no link is lost.
    """
    tokens, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(tokens))
    ranks = np.split(rank[where], np.cumsum([len(s) for s in sets])[:-1])
    prefixes = [np.sort(r)[: len(r) - -(-percent * len(r) // 100) + 1] for r in ranks]
    owners = np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])
    entries = np.concatenate(prefixes)
    by_token = np.argsort(entries, kind="stable")
    owners, entries = owners[by_token], entries[by_token]

    def of(i: int) -> np.ndarray:
        met = np.zeros(len(sets), dtype=bool)
        for x, y in zip(np.searchsorted(entries, prefixes[i], "left").tolist(), np.searchsorted(entries, prefixes[i], "right").tolist()):
            met[owners[x:y]] = True
        return np.nonzero(met)[0]

    return of


def _spanning_links(node, members: list[tuple], k: int, percent: int, first: int, second: int) -> list[tuple[int, int]]:
    """Links that connect the members of a node, found by comparing full sets of pairs that are not yet connected.

    members: (id, block, text, size, signature, nodes).  Diagonal groups compare all their pairs, others those
    across blocks.  Only pairs whose sizes rule a link out are passed over, and in a node that stayed large also
    those that the index on prefixes rules out.
    """
    n = len(members)
    signatures = np.array([m[4] for m in members], dtype=np.int32)
    probe = signatures[:: max(1, n // 64)][:64]
    central = np.argsort([-int((probe == row).sum()) for row in signatures], kind="stable")
    members = [members[i] for i in central]
    blocks, sizes = np.array([m[1] for m in members]), np.array([m[3] for m in members], dtype=np.int64)
    shared = [frozenset(x for x in m[5] if x < node) for m in members]
    sets: list[np.ndarray | None] = [None] * n
    partners = None
    if n > SMALL:
        sets = [shingle_set(m[2], k) for m in members]
        partners = _partners(sets, percent)
    group = np.arange(n)
    out = []
    for i in range(n):
        rest = np.arange(i + 1, n)
        rest = rest[(group[rest] != group[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))]
        if first != second:
            rest = rest[blocks[rest] != blocks[i]]
        if partners is not None and len(rest):
            rest = np.intersect1d(rest, partners(i), assume_unique=True)
        for j in rest.tolist():
            if group[j] == group[i] or not shared[i].isdisjoint(shared[j]):
                continue
            for x in (i, j):
                if sets[x] is None:
                    sets[x] = shingle_set(members[x][2], k)
            if _linked(sets[i], sets[j], percent):
                out.append((members[i][0], members[j][0]))
                group[group == group[j]] = group[i]
    return out


def _compare(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for (node, first, second), members in sorted_groups(batches, 3):
            found += _spanning_links(node, members, k, percent, first, second)
            if len(found) > 10_000:
                yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
                found = []
        yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _leaves(reps: DataFrame, trees: int) -> DataFrame:
    """(id, node) of the nodes with two members or more; large nodes have branched on up to MOST_LEVELS."""
    paths = materialize(reps.select("id", "signature").mapInArrow(_roots(trees), "id long, node long"), "paths")
    done = []
    for level in range(FIRST_LEVELS, MOST_LEVELS + 1):
        # Written first, so that the joins below can be split at a hot node; nodes of one member never return.
        counts = materialize(paths.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "nodes")
        last = level == MOST_LEVELS
        done.append(paths.join(counts.where("n >= 2" if last else f"n between 2 and {SMALL}").select("node"), "node", "left_semi").select("id", "node"))
        if last:
            break
        large = paths.join(counts.where(f"n > {SMALL}").select("node"), "node", "left_semi")
        grown = large.join(reps.select("id", "signature"), "id").select("id", "node", "signature")
        paths = materialize(grown.mapInArrow(_deeper, "id long, node long"), "paths")
        if paths.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct()


def similar_links(reps: DataFrame, texts: DataFrame, k: int, percent: int, trees: int) -> DataFrame:
    """Spanning links (a, b) among representatives.

    reps: id, owner, text_hash, n_shingles, signature; texts: owner, text_hash, text.  The owner and the hash name
    a text, so that rows which repeat an owner with other texts cannot be taken for one another.
    """
    leaves = materialize(_leaves(reps, trees), "leaves")
    # Nodes of the same members in several trees are compared once.
    nodes = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members"))
    once = nodes.groupBy("n", "members").agg(F.min("node").alias("node"))
    members = leaves.join(once.select("node"), "node", "left_semi")
    per_id = members.groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("nodes")).join(reps, "id")
    wanted = texts.join(per_id.select("owner", "text_hash"), ["owner", "text_hash"], "left_semi").dropDuplicates(["owner", "text_hash"])
    described = per_id.join(wanted, ["owner", "text_hash"]).select("id", "text", "n_shingles", "signature", "nodes")
    sized = members.join(described.select("id", F.octet_length("text").alias("bytes")), "id")
    blocks = sized.groupBy("node").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_ROWS), F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("id", "node"), F.col("blocks")).cast("int")
    spread = members.join(blocks, "node").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = spread.select("node", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "id", "block")
    wide = groups.join(described, "id").select("node", "first", "second", "id", "block", "text", "n_shingles", "signature", "nodes")
    dealt = wide.repartition("node", "first", "second").sortWithinPartitions("node", "first", "second", "id")
    return dealt.mapInArrow(_compare(k, percent), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id (smallest id reachable by links), kept.

    Documents link when 100 * shared shingles >= ``percent`` * all shingles of the two.

    Edge cases: a null, empty or blank text has no shingles and is linked with nothing; a text with fewer
    words than a shingle is one shingle; equal sets are one class whatever their number; a row with a null id
    is its own null component; rows that repeat an id, whatever their texts, are one vertex of the graph: each
    gets a row, all with the smallest id that any of their texts reaches; an empty table gives an empty result;
    other columns are ignored; very long texts are used whole.
    """
    named = own_columns(docs, id_col, text_col).toDF("id", "text")
    source = named.select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("text_hash"))
    schema = "id long, text_hash long, n_shingles long, digest binary, signature array<int>"
    facts = materialize(source.select("id", "text", "text_hash").mapInArrow(_describe(shingle), schema), "shingles")
    filled = facts.where("n_shingles > 0 and id is not null")
    classes = filled.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("one"))
    # A class has a number of its own: an id may stand for several classes.  Written, so that the numbers are final.
    classes = materialize(classes.select("digest", "one.id", "one.text_hash", F.monotonically_increasing_id().alias("class")), "classes")
    chosen = classes.select("digest", F.col("id").alias("owner"), F.col("text_hash").alias("hash"), "class")
    of_row = filled.join(chosen, "digest")
    reps = (
        of_row.where((F.col("id") == F.col("owner")) & (F.col("text_hash") == F.col("hash")))
        .select(F.col("class").alias("id"), "owner", "text_hash", "n_shingles", "signature")
        .dropDuplicates(["id"])
    )
    texts = source.where("id is not null").select(F.col("id").alias("owner"), "text_hash", "text")
    links = similar_links(reps, texts, shingle, percent, trees)
    # Rows of a class, and classes of an id, are stars already; only links between classes and ids that bridge classes need rounds.
    by_id = materialize(of_row.select("id", "class").distinct(), "owners")
    bridges = by_id.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z")
    bridges = by_id.join(bridges.select("id", "a"), "id").where("class <> a").select("a", F.col("class").alias("b"))
    roots = connected_components(links.unionByName(bridges))
    rooted = classes.select("class", F.col("id").alias("least")).join(roots.withColumnRenamed("id", "class"), "class", "left").select("class", "least", F.coalesce("component", "class").alias("root"))
    rooted = materialize(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    found = by_id.join(rooted.join(least, "root").select("class", "component"), "class").groupBy("id").agg(F.min("component").alias("component"))
    return facts.select("id", "n_shingles").join(found, "id", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id").eqNullSafe(F.coalesce("component", "id"))).alias("kept"),
    )
