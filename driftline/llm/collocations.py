"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by key, and scores of the best cuts.

A shard is a few megabytes of text of one language as word ids, with breaks between pieces.  Its suffix array is
built by prefix doubling in numpy, ordered by as many words as the longest phrase has; intervals of common prefixes are
its n-grams with their counts.  Spark merges the counts of all shards by language and phrase.

A phrase cannot be more frequent than its parts.  So there are four rounds over the written shards: words are
counted by hash; then pairs of words with frequent hashes and triples of such pairs, by hash; then all phrases whose parts
of up to three words have frequent hashes, by the phrases themselves.  Hashes reach the shards as a bit filter of at most ``MOST_BITS``, whatever the data: it
never loses a frequent key, and what it lets through in excess is dropped by the merged counts of the last round, so
every count is exact and a full filter costs shuffle only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import materialize, own_columns

# Characters that end a piece and those that part words, as the query contract gives them.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

#: Bytes of text in a shard, bits of a filter at least and at most (32 MB), and filter bits for each key.
SHARD_BYTES, LEAST_BITS, MOST_BITS, BITS_PER_KEY = 2_000_000, 1 << 16, 1 << 28, 16
#: Keys are the upper 40 bits of hashes.
KEY_SHIFT = np.uint64(24)
#: Words of the longest parts that are counted by hash first.
KNOWN = 3
#: Parts into which the candidates of a language are dealt.
SALTS = 64

#: Shards in a row group, so that Spark's reader and writer hold no more of them at a time, however many a file has.
GROUP_ROWS = 8

_SHARD = "lang string, n long, ids binary, words binary"


def _packed(**columns: pa.Array) -> bytes:
    """Columns as one compressed value: Spark moves a shard as bytes, not as a row of arrays that it copies element by element."""
    batch, sink = pa.record_batch(list(columns.values()), names=list(columns)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(value: pa.Scalar) -> list[pa.Array]:
    return pa.ipc.open_stream(value.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch().columns


def _portions(text: bytes) -> Iterator[bytes]:
    """A text longer than a shard in parts that end where pieces do: at the last end that fits, else at the next."""
    at, ends = 0, [bytes([e]) for e in PIECE_ENDS]
    while len(text) - at > SHARD_BYTES:
        cut = max(text.rfind(e, at + 1, at + SHARD_BYTES) for e in ends)
        if cut < 0:
            cut = min((i for e in ends if (i := text.find(e, at + SHARD_BYTES)) >= 0), default=-1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, n, ids, words): a row per shard of n words; packed are ids, which number its distinct words (-1 ends a piece), and those words with counts."""
    source = own_columns(docs, lang_col, text_col).toDF("lang", "text").where(F.length("text") > 0)
    source = source.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), "text")
    upper = bytes(range(65, 91))
    plain = bytes.maketrans(PIECE_ENDS + BLANKS + upper, b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS) + upper.lower())

    def shard(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        # A line break becomes a word of its own, so one split gives words and breaks.
        parts = pa.array(b"\n".join(texts).translate(plain).replace(b"\n", b" \n ").split(b" "), pa.binary())
        found = parts.dictionary_encode()
        ids, words = found.indices.to_numpy().astype(np.int32), found.dictionary
        empty, cut = pc.index(words, b"").as_py(), pc.index(words, b"\n").as_py()
        ids = ids[ids != empty] if empty >= 0 else ids
        if cut >= 0:
            ids[ids == cut] = -1
        counts = np.bincount(ids[ids >= 0], minlength=len(words))
        keep = counts > 0
        number = np.append(np.cumsum(keep) - 1, -1).astype(np.int32)
        kept = words.filter(pa.array(keep)).cast(pa.string())
        values = [lang, int(counts.sum()), _packed(ids=pa.array(number[ids])), _packed(words=kept, counts=pa.array(counts[keep].astype(np.int64)))]
        return pa.record_batch([pa.array([v]) for v in values], names=["lang", "n", "ids", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        held = ((lang.as_py(), part) for batch in batches for lang, text in zip(batch.column(0), batch.column(1)) for part in _portions(text.as_py().encode()))
        for lang, text in held:
            texts.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sum(sizes.values()) >= SHARD_BYTES:
                full = max(sizes, key=sizes.get)
                sizes.pop(full)
                yield shard(full, texts.pop(full))
        for lang, rest in texts.items():
            yield shard(lang, rest)

    return source.mapInArrow(run, _SHARD)


def suffix_order(ids: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes with the one before), both by the first ``depth`` words.

    ``room`` is the number of words from a position to the end of its piece, at most ``depth``; a suffix is no longer.
    Ranks by 1, 2, 4, ... words come from pairs of ranks by half as many; a missing half ranks lowest.
    """
    n = len(ids)
    rank = np.where(room > 0, ids + 1, 0).astype(np.int64)
    length, order = 1, np.argsort(rank, kind="stable")
    while length < depth:
        step = min(length, depth - length)
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:]
        follow[room <= step] = 0
        key = rank * (int(rank.max(initial=0)) + 1) + follow
        order = np.argsort(key, kind="stable")
        ahead = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], ahead[1:] != ahead[:-1]])) if n else 0
        rank, length = fresh, length + step
    common, same = np.zeros(n, np.int8), np.ones(max(n - 1, 0), bool)
    padded = np.concatenate([ids, np.full(depth, -1, ids.dtype)])
    for k in range(depth):
        same &= (padded[order[1:] + k] == padded[order[:-1] + k]) & (room[order[1:]] > k) & (room[order[:-1]] > k)
        common[1:] += same
    return order, common


def interval_counts(order: np.ndarray, common: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position, count) of each n-gram of ``length`` words: intervals of suffixes that share as many."""
    starts = np.flatnonzero(common < length)
    counts = np.diff(np.append(starts, len(order)))
    whole = room[order[starts]] >= length
    return order[starts[whole]], counts[whole]


def reaching(room: np.ndarray, begins: np.ndarray, depth: int) -> np.ndarray:
    """Words from each position that phrases may have, at most ``depth``: one more than the next position's where a known part begins."""
    for _ in range(depth - 1):
        room = np.where(begins, np.minimum(1 + np.append(room[1:], 0), depth), room).astype(np.int8)
    return room


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    digest, start = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((digest(w, start) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def gram_hashes(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the phrases at some positions, from those of their words."""
    out = hashes[ids[at]]
    for k in range(1, length):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[ids[at + k]]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out


@dataclass
class KeyFilter:
    """Bits of hashed keys; a key is absent for certain where one of its two bits is missing."""

    bits: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        other = keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
        return (keys % np.uint64(size)).astype(np.int64), (other % np.uint64(size)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        one, two = self.places(hashes >> KEY_SHIFT, len(self.bits) * 8)
        bit = lambda at: (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bit(one) & bit(two)).astype(bool)


def key_filter(counts: DataFrame, least: int) -> KeyFilter:
    """The filter of all keys whose counts (key, f) sum to ``least``; its bits are set in Spark and collected, at most ``MOST_BITS``."""
    frequent = materialize(counts.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("key"), "keys")
    wanted, size = frequent.count() * BITS_PER_KEY, LEAST_BITS
    while size < min(wanted, MOST_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for at in KeyFilter.places(batch.column(0).to_numpy(), size):
                np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(own[at].view(np.int64))], names=["at", "bits"])

    rows = frequent.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return KeyFilter(bits.view(np.uint8))


def grams(ids: np.ndarray, hashes: np.ndarray, filters: list[KeyFilter], longest: int, shortest: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(word ids, first positions, counts, length) of a shard's phrases of ``shortest`` to ``longest`` words whose parts are all known.

    Filter i knows the parts of i + 1 words.
    """
    known = np.append(filters[0].has(hashes), False)[ids]
    begins = np.append(known[:-1] & known[1:], False) if len(ids) else np.zeros(0, bool)
    # Only known words stay; where the next one is no neighbour, ``begins`` says so.
    ids, begins = ids[known], begins[known]
    room = np.ones(len(ids), np.int8)
    for k, known_parts in enumerate(filters[1:], 2):
        room = reaching(room, begins, k)
        order, common = suffix_order(ids, room, k)
        at, counts = interval_counts(order, common, room, k)
        good = known_parts.has(gram_hashes(ids, hashes, at, k))
        # Suffixes that begin with a known part are intervals of the suffix array.
        place, edges = np.empty(len(ids), np.int64), np.zeros(len(ids) + 1, np.int64)
        place[order] = np.arange(len(ids))
        np.add.at(edges, place[at[good]], 1)
        np.add.at(edges, place[at[good]] + counts[good], -1)
        begins = np.zeros(len(ids), bool)
        begins[order] = np.cumsum(edges[:-1]) > 0
        room = np.minimum(room, k - 1)
    room = reaching(room, begins, longest)
    order, common = suffix_order(ids, room, longest)
    for length in range(shortest, longest + 1):
        yield ids, *interval_counts(order, common, room, length), length


def _phrases(words: pa.Array, ids: np.ndarray, at: np.ndarray, length: int) -> pa.Array:
    parts = [words.take(pa.array(ids[at + k])) for k in range(length)]
    return parts[0] if length == 1 else pc.binary_join_element_wise(*parts, " ")


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    for batch in batches:
        for lang, ids, words in zip(*batch.columns):
            yield lang.as_py(), _unpacked(ids)[0].to_numpy(zero_copy_only=False), _unpacked(words)[0]


def _keys(hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(hashes), 65_536):
        keys = (hashes[i : i + 65_536] >> KEY_SHIFT).astype(np.int64)
        yield pa.record_batch([pa.array(keys), pa.array(counts[i : i + 65_536].astype(np.int64))], names=["key", "f"])


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to ``longest`` words with f >= ``least``, and (lang, n) of all words."""
    stored = materialize(word_shards(docs, lang_col, text_col), "shards", **{"parquet.block.row.count.limit": GROUP_ROWS, "compression": "none"})
    shards = stored.select("lang", "ids", "words")
    send = shards.sparkSession.sparkContext.broadcast

    def words_by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, packed in zip(*batch.columns):
                words, counts = _unpacked(packed)
                yield from _keys(word_hashes(lang.as_py(), words), counts.to_numpy())

    filters = [key_filter(stored.select("lang", "words").mapInArrow(words_by_hash, "key long, f long"), least)]
    for k in range(2, min(KNOWN, longest) + 1):
        known = send(filters)

        def by_hash(batches: Iterator[pa.RecordBatch], k: int = k, known=known) -> Iterator[pa.RecordBatch]:
            for lang, ids, words in _shards_of(batches):
                hashes = word_hashes(lang, words)
                for own, first, counts, length in grams(ids, hashes, known.value, k, k):
                    yield from _keys(gram_hashes(own, hashes, first, length), counts)

        filters = [*filters, key_filter(shards.mapInArrow(by_hash, "key long, f long"), least)]
    known = send(filters)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words in _shards_of(batches):
            for own, first, counts, length in grams(ids, word_hashes(lang, words), known.value, longest):
                for i in range(0, len(first), 65_536):
                    part = _phrases(words, own, first[i : i + 65_536], length)
                    yield pa.record_batch([pa.array([lang] * len(part)), part, pa.array(counts[i : i + 65_536].astype(np.int64))], names=["lang", "phrase", "f"])

    merged = shards.mapInArrow(phrases, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    totals = stored.groupBy("lang").agg(F.sum("n").alias("n"))
    return materialize(merged.where(F.col("f") >= least), "phrases"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first ``most`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words with count a >= ``least`` has for a cut into two phrases with counts l and r the
    score floor(1000 * a * n / (l * r)), n being all words of the language; its lowest cut counts, of equal ones the
    one after the fewest words.  A phrase is dropped if a longer one of the same count holds it.

    Edge cases: A-Z count as a-z; a null language is ``und``; null and empty texts have no words; repeated rows count
    each; ties in score go to the higher count, then to the phrase first in the order of UTF-8 bytes; a text is
    counted whole whatever its length; an empty table gives an empty result; other columns are ignored.
    """
    counts, totals = phrase_counts(docs, least, longest, lang_col, text_col)
    size = F.size(F.split("phrase", " "))
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), size.alias("size")).where("size > 1")
    cuts = candidates.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    left, right = counts.toDF("lang", "first", "l"), counts.toDF("lang", "rest", "r")
    priced = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    # Languages are few and hot: a candidate meets its language's total in one of several copies of that row.
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    priced = priced.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    exact = "cast((cast(1000 as decimal(4, 0)) * cast(a as decimal(15, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as long)"
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    scored = priced.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a", "n", "salt").agg(best.alias("b")).select("lang", "phrase", "a", "n", "salt", "b.*")
    # Counts never rise with length: if any longer phrase has the same count, so has one that is a word longer.
    inside = (
        candidates.where("size > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = scored.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a")
    # Two levels, so that no task sorts all candidates of a language.
    order = "score desc, a desc, phrase"
    top = kept.withColumn("place", F.expr(f"row_number() over (partition by lang, salt order by {order})")).where(F.col("place") <= most)
    ranked = top.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang order by {order}) as long)")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
