"""Removal of long repeated byte strings with a distributed, sparse enhanced suffix array.

A byte is removed if it lies in a string of LENGTH bytes that also starts somewhere else.  Every such string
holds an anchor: the least hashed GRAM-gram among those inside it, which equal strings have at the same
place.  So only the suffixes that start at anchors are needed, each with as many bytes to its left and right
as a string of LENGTH bytes around the anchor can reach (its context).

* Anchors whose gram occurs once anywhere are dropped by counting.
* Equal contexts are one class; a class with two members or more is repeated as a whole.
* Within a gram, the classes' suffixes are sorted, their common prefixes computed, and one stack scan visits
  the intervals of the common-prefix tree.  In an interval whose members share ``r`` bytes to the right, the
  left extensions are tested: members are divided by the bytes to the left, and those that share ``l`` bytes
  with ``l + r >= LENGTH`` form a maximal repeat with all its occurrences.  Each occurrence keeps the
  farthest left and right it is covered by.
* A gram with very many classes is not gathered: its strings of LENGTH bytes are counted by hash instead, many
  neighbouring ones at once where they are repeated together or not at all.

Occurrences then give intervals of their documents, which are united and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import discard, materialize, own_columns
from driftline.llm.streams import sorted_groups

LENGTH, GRAM = 400, 64
#: Classes of one gram that one task sorts; grams with more are counted by hashes of their strings.
MOST_CLASSES = 100_000

_BYTE = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], dtype=np.uint64)
_STEPS = np.array([xxhash.xxh64_intdigest(f"step {i}") | 1 for i in range(16)], dtype=np.uint64)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all ``size``-grams (a power of two), by doubling."""
    h, width, step = _BYTE[data], 1, 0
    while width < size:
        h = h[: len(h) - width] * _STEPS[step] + h[width:]
        width, step = 2 * width, step + 1
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, reduce, fill) -> np.ndarray:
    """reduce over every window of ``width`` values, in constant time per value: block prefixes meet block suffixes."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = reduce.accumulate(blocks, axis=1).ravel()
    behind = reduce.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes): every place that holds the least gram of some string of ``length`` bytes."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _gram_hashes(np.frombuffer(data, np.uint8), gram)
    width = length - gram + 1
    least = _sliding(h, width, np.minimum, np.iinfo(np.uint64).max)
    # A place is the least of some window if the greatest minimum among the windows over it is its own hash.
    edge = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0)
    at = np.nonzero(best == h)[0]
    return at, h[at]


def _context(data: bytes, at: int, length: int, gram: int) -> tuple[bytes, bytes]:
    return data[max(0, at - (length - gram)) : at], data[at : at + length]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                owners, places, grams, contexts = [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    data = _bytes(text)
                    at, h = anchors(data, length, gram)
                    if not len(at):
                        continue
                    owners.append(np.full(len(at), row))
                    places.append(at)
                    grams.append(h)
                    back = length - gram
                    contexts.append(np.fromiter((digest(data[max(0, x - back) : x + length], seed=min(x, back)) for x in at.tolist()), np.uint64, len(at)))
                if owners:
                    ids = part.column(0).take(pa.array(np.concatenate(owners)))
                    yield pa.record_batch(
                        [ids, pa.array(np.concatenate(places)), pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(contexts).view(np.int64))],
                        names=["id", "at", "gram", "context"],
                    )

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of the intervals of a common-prefix array by one stack scan, inner ones first.

    lcp[i] is what suffixes i and i + 1 share; an interval holds suffixes first..last, which share ``value``.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            yield top, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


class ContextTree:
    """Enhanced suffix array of contexts (bytes before the anchor, bytes from it), with the order of their left bytes beside it."""

    def __init__(self, contexts: list[tuple[bytes, bytes]], length: int):
        self.length, self.n = length, len(contexts)
        self.order = sorted(range(self.n), key=lambda i: contexts[i][1])
        self.lcp = [_common(contexts[a][1], contexts[b][1]) for a, b in zip(self.order, self.order[1:])]
        lefts = [c[0][::-1] for c in contexts]
        by_left = sorted(range(self.n), key=lambda i: lefts[i])
        self.left_lcp = np.array([_common(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])], dtype=np.int64)
        self.by_left = np.array(by_left)
        rank = np.empty(self.n, dtype=np.int64)
        rank[self.by_left] = np.arange(self.n)
        self.rank = rank[self.order]  # left rank of each suffix, in suffix order
        # No partner at all shares more to the left than a neighbour in left order does.
        padded = np.concatenate([[0], self.left_lcp, [0]])
        self.most_left = np.maximum(padded[:-1], padded[1:])[self.rank]

    def repeats(self) -> Iterator[tuple[list[int], int, int]]:
        """(members, l, r): every group that shares r bytes right and l left of the anchor, l + r >= length, and as a group no more."""
        for right, first, last in prefix_intervals(self.lcp):
            if right + int(self.most_left[first : last + 1].max()) < self.length:
                continue
            ranks = np.sort(self.rank[first : last + 1])
            shared = self._between(ranks)
            for left, a, b in prefix_intervals(shared.tolist()):
                if left + right >= self.length:
                    yield self.by_left[ranks[a : b + 1]].tolist(), left, right

    def _between(self, ranks: np.ndarray) -> np.ndarray:
        padded = np.append(self.left_lcp, np.iinfo(np.int64).max)
        return np.minimum.reduceat(padded, ranks)[:-1] if len(ranks) < self.n else self.left_lcp

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """How far left and right of its anchor each context is covered by repeats (0, 0: not at all).

        One stack scan over the suffix order, inner intervals first.  In an interval that shares ``right`` bytes
        the left extensions are tested at once: a member is in a repeat if a neighbour in left order shares at
        least ``length - right``.  Inner intervals share more to the right, so an outer one can only reach
        farther left; it is passed over when none of its members can (all have what their best neighbour shares).
        """
        before, after = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)  # in suffix order
        for right, first, last in prefix_intervals(self.lcp):
            here = slice(first, last + 1)
            need = self.length - right
            can = self.most_left[here]
            open_ = (can >= need) & ((before[here] < can) | (after[here] == 0))
            if not open_.any():
                continue
            at = np.argsort(self.rank[here])
            shared = np.concatenate([[-1], self._between(self.rank[here][at]), [-1]])
            most = np.maximum(shared[:-1], shared[1:])
            hit = most >= need
            rows = first + at[hit]
            before[rows] = np.maximum(before[rows], most[hit])
            after[rows] = np.maximum(after[rows], right)
        out_before, out_after = np.empty_like(before), np.empty_like(after)
        out_before[self.order], out_after[self.order] = before, after
        return out_before, out_after


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []

        def batch_of(rows):
            cols = list(zip(*rows)) if rows else [[]] * 4
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["gram", "context", "before", "after"])

        for (gram,), rows in sorted_groups(batches, 1):
            before, after = ContextTree([(r[1], r[2]) for r in rows], length).cover()
            for i in np.nonzero(after)[0].tolist():
                out.append((gram, rows[i][0], int(before[i]), int(after[i])))
            if len(out) > 20_000:
                yield batch_of(out)
                out.clear()
        yield batch_of(out)

    return run


def _nodes(length: int, starts: int, width: int, size: int):
    """(gram, context, left, right, within: array of (a, open)) -> parts of ``size`` starts of each node of ``width`` starts from a.

    A part holds the windows of ``length`` bytes that start a to b bytes before the anchor.  Returned are gram,
    context, a, open, and hashes of ``shared`` (the bytes all of them hold) and ``all`` (the bytes any of them
    holds; a context that ends before that stands for itself).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for gram, context, left, right, within in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    whole, n = left + right, len(left)
                    for node in within:
                        for a in range(node["a"], min(node["a"] + width, starts), size):
                            b = min(a + size, starts) - 1
                            if n < a or len(right) < length - b:
                                continue
                            every = whole[n - b : n + length - a] if n >= b and len(right) >= length - a else context.to_bytes(8, "little", signed=True)
                            rows.append((gram, context, a, node["open"], xxhash.xxh3_64_intdigest(whole[n - a : n + length - b]) - (1 << 63), xxhash.xxh128_digest(every)))
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["gram", "context", "a", "open", "shared", "all"])

    return run


def count_windows(contexts: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """gram, context, left, right (written) -> tables of gram, context, before, after: the repeats of each gram, without gathering it.

    Equal strings have their anchor at the same place, so windows are compared only with those that start as far before
    it; two contexts are two places.  Starts are counted in nodes of 49, then 7, then 1 (for 337 starts).  Where all bytes
    of a node's windows occur in two contexts, all its windows are repeated; where the bytes they share occur in one
    context only, none is.  Only what lies between is divided further, together with one context for each
    string of the node that is settled, for the others may repeat it.
    """
    starts = length - gram + 1
    sizes = [1]
    while sizes[0] * 7 < starts:
        sizes.insert(0, sizes[0] * 7)
    todo = contexts.withColumn("within", F.array(F.struct(F.lit(0).alias("a"), F.lit(True).alias("open"))))
    found, spent, width = [], [], starts
    for size in sizes:
        nodes = materialize(
            todo.select("gram", "context", "left", "right", "within").mapInArrow(_nodes(length, starts, width, size), "gram long, context long, a int, open boolean, shared long, all binary"), "windows"
        )
        strings = nodes.groupBy("gram", "a", "all").agg(F.count(F.lit(1)).alias("n"), F.min("shared").alias("shared"), F.min("context").alias("context"), F.max("open").alias("open"))
        strings = materialize(strings.withColumn("open", F.expr("open and n = 1")), "strings")
        twice = nodes.where("open").join(strings.where("n > 1").select("gram", "a", "all"), ["gram", "a", "all"], "left_semi")
        found.append(
            materialize(
                twice.groupBy("gram", "context").agg(
                    F.max(F.least(F.col("a") + size, F.lit(starts)) - 1).cast("long").alias("before"), F.max(F.lit(length) - F.col("a")).cast("long").alias("after")
                ),
                "cover",
            )
        )
        if size > 1:
            between = materialize(strings.groupBy("gram", "a", "shared").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open")).where("n > 1 and open").select("gram", "a", "shared"), "between")
            within = materialize(strings.join(between, ["gram", "a", "shared"], "left_semi").groupBy("gram", "context").agg(F.collect_list(F.struct("a", "open")).alias("within")), "within")
            todo = contexts.join(within, ["gram", "context"])
            discard(between)
        discard(nodes, strings, *spent)
        spent, width = [within] if size > 1 else [], size
    return found


def _extract(length: int, gram: int):
    """(text, wanted: array of (gram, context, at)) -> (gram, context, left, right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = []
                for text, wanted in zip(*[c.to_pylist() for c in batch.slice(start, 64).columns]):
                    data = _bytes(text)
                    rows += [(w["gram"], w["context"], *_context(data, w["at"], length, gram)) for w in wanted]
                cols = list(zip(*rows)) if rows else [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["gram", "context", "left", "right"])

    return run


def united(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, intervals) -> id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            sizes, spans, removed, digests = [], [], [], []
            for text, intervals in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                data = _bytes(text)
                found = united([(max(0, x["a"]), min(len(data), x["b"])) for x in intervals or []])
                kept, at = hashlib.sha256(), 0
                for a, b in found:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                sizes.append(len(data))
                spans.append([y for x in found for y in x])
                removed.append(sum(b - a for a, b in found))
                digests.append(kept.hexdigest())
            yield pa.record_batch(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(digests), pa.array(spans, pa.list_(pa.int64()))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )


def repeated_intervals(rows: DataFrame, length: int, gram: int, most_classes: int) -> DataFrame:
    """rows: id, text -> (id, intervals): byte intervals (a, b) covered by repeats, overlapping ones included."""
    found = materialize(rows.mapInArrow(_find_anchors(length, gram), f"id {rows.schema['id'].dataType.simpleString()}, at long, gram long, context long"), "anchors")
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("n > 1")
    # Written first, so that the join below stands on its own shuffle, which adaptive execution can split at a hot gram.
    grams = materialize(grams.select("gram", (F.col("c0") != F.col("c1")).alias("mixed")), "grams")
    again = materialize(found.join(grams, "gram"), "anchors")
    discard(found, grams)
    classes = again.groupBy("gram", "context", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("one"))
    classes = materialize(classes, "classes")
    wanted = classes.where("mixed").select("gram", "context", "one.id", "one.at").groupBy("id").agg(F.collect_list(F.struct("gram", "context", "at")).alias("wanted"))
    contexts = wanted.withColumnRenamed("id", "owner").join(rows, F.col("owner").eqNullSafe(F.col("id"))).select("text", "wanted").mapInArrow(_extract(length, gram), "gram long, context long, left binary, right binary")
    large = classes.where("mixed").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(f"n > {most_classes}").select("gram")
    some_large, spent = not large.isEmpty(), []
    if some_large:
        contexts = materialize(contexts, "contexts")
        spent.append(contexts)
        large = materialize(large, "grams")
        spent.append(large)
        small = contexts.join(large, "gram", "left_anti")
    else:
        small = contexts
    covered = small.repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(_scan(length), "gram long, context long, before long, after long")
    if some_large:
        hot = materialize(contexts.join(large, "gram", "left_semi"), "contexts")
        counted = count_windows(hot, length, gram)
        spent += [hot, *counted]
        for part in counted:
            covered = covered.unionByName(part)
    whole = classes.where("n > 1").select("gram", "context", F.lit(length - gram).cast("long").alias("before"), F.lit(length).cast("long").alias("after"))
    cover = materialize(covered.unionByName(whole).groupBy("gram", "context").agg(F.max("before").alias("before"), F.max("after").alias("after")), "cover")
    discard(classes, *spent)
    intervals = again.join(cover, ["gram", "context"]).select("id", (F.col("at") - F.col("before")).alias("a"), (F.col("at") + F.col("after")).alias("b"))
    per_doc = materialize(intervals.groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("intervals")), "intervals")
    discard(again, cover)
    return per_doc


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most_classes: int = MOST_CLASSES) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (their ends, flat).

    Texts are UTF-8 bytes; strings never cross documents; they are judged on the input, not on what is left.

    Edge cases: a null text is empty; texts shorter than ``length`` lose nothing; rows that repeat an id and
    its text are occurrences of their own (so all of a long enough one is removed); a null id is an id like others; an empty table gives an empty result; other columns are ignored; texts are used whole.
    """
    named = own_columns(docs, id_col, text_col).toDF("own", "text")
    source = named.select(F.struct("own", F.xxhash64("text").alias("text_hash")).alias("id"), "text")
    per_doc = repeated_intervals(source, length, gram, most_classes).withColumnRenamed("id", "found")
    cut = source.join(per_doc, F.col("id").eqNullSafe(F.col("found")), "left").select(F.col("id.own").alias("id"), "text", "intervals")
    kind = named.schema["own"].dataType.simpleString()
    return cut.mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>").withColumnRenamed("id", id_col)
