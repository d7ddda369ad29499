"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

A text becomes one string with a leading white-space marker and every space replaced by the marker.  No
piece has a marker after another character, and none holds a character outside the vocabulary's alphabet or
two neighbours that are neighbours in no piece; the best segmentation of a text is therefore the
concatenation of the best segmentations of the stretches between such places.  Distinct stretches of a batch
are segmented together, one trie step for all of them at a time, and remembered in a bounded cache.
Characters that no piece covers become the byte pieces of their UTF-8 form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import own_columns

MARK = "▁"
#: What an uncovered character costs below the least score of a piece.
UNKNOWN_PENALTY = 10.0
#: Characters of texts taken together, stretches remembered by a worker, and the length from which a stretch is walked alone.
BATCH_CHARS, CACHE, LONG = 2_000_000, 400_000, 96


@dataclass
class PieceModel:
    """Pieces with scores as a double-array trie over character codes; a few hundred kilobytes, sent to every task."""

    pieces: list[str]
    scores: np.ndarray
    kinds: list[str]  # normal, byte, unknown or control
    alphabet: str = ""
    base: np.ndarray = field(default=None, repr=False)
    check: np.ndarray = field(default=None, repr=False)
    value: np.ndarray = field(default=None, repr=False)
    pairs: frozenset = frozenset()

    def __post_init__(self):
        normal = [(p, i) for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == "normal"]
        counts: dict[str, int] = {}
        for p, _ in normal:
            for c in p:
                counts[c] = counts.get(c, 0) + 1
        self.alphabet = "".join(sorted(counts, key=lambda c: (-counts[c], c)))
        self.pairs = frozenset(p[i : i + 2] for p, _ in normal for i in range(len(p) - 1))
        self.longest = max((len(p) for p, _ in normal), default=1)
        self.least = float(min((self.scores[i] for _, i in normal), default=0.0)) - UNKNOWN_PENALTY
        self.byte_ids = [-1] * 256
        for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
        self.unknown = next((i for i, kind in enumerate(self.kinds) if kind == "unknown"), 0)
        self.marker_inside = any(MARK in p.lstrip(MARK) for p, _ in normal)
        self._build(normal)

    def _build(self, normal: list[tuple[str, int]]) -> None:
        code = {c: i + 1 for i, c in enumerate(self.alphabet)}
        root: dict = {}
        for p, i in normal:
            node = root
            for c in p:
                node = node.setdefault(code[c], {})
            node[0] = i
        size = 4 * sum(map(len, (p for p, _ in normal))) + 4 * len(code) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        queue, recent = [(0, root)], 1
        for state, node in queue:
            value[state] = node.get(0, -1)
            codes = np.array(sorted(c for c in node if c), dtype=np.int64)
            if not len(codes):
                continue
            at = self._place(check, recent, codes)
            recent = max(recent, at - 2048)  # the search trails the frontier by a bounded stretch
            base[state] = at - codes[0]
            for c in codes.tolist():
                check[base[state] + c] = state
                queue.append((int(base[state]) + c, node[c]))
        end = int(np.nonzero(check != -1)[0].max()) + len(code) + 2
        self.base, self.check, self.value = (np.pad(x, (0, max(0, end - size)), constant_values=-1)[:end] for x in (base, check, value))

    @staticmethod
    def _place(check: np.ndarray, start: int, codes: np.ndarray) -> int:
        """The first place from ``start`` for the first of ``codes`` at which all of them fall on free cells."""
        at = max(start, int(codes[0]) + 1)
        while True:
            tried = at + np.flatnonzero(check[at : at + 512] == -1)
            fits = (check[tried[:, None] - codes[0] + codes[None, :]] == -1).all(axis=1)
            if fits.any():
                return int(tried[fits.argmax()])
            at += 512

    def table(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int32)
        out[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        return out


def log_scores(scores: np.ndarray) -> np.ndarray:
    """Scores of a file as log probabilities.

    Unigram files hold them already.  BPE files hold minus the rank of the merge (and a far rank for single
    characters); as sums of ranks compare badly, ranks become a Zipf law, log(1 / (rank + 2)) less the log of
    the total.
    """
    if not len(scores) or not np.equal(scores, np.round(scores)).all() or (scores > 0).any():
        return scores
    weights = 1.0 / (2.0 - scores)
    return np.log(weights / weights.sum())


def load_model(path: str) -> PieceModel:
    """The pieces, log scores and kinds of a SentencePiece model file, read on the driver."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(read.vocab_size())
    kind = lambda i: "byte" if read.is_byte(i) else "unknown" if read.is_unknown(i) else "control" if read.is_control(i) or read.is_unused(i) else "normal"
    return PieceModel([read.id_to_piece(i) for i in ids], log_scores(np.array([read.get_score(i) for i in ids])), [kind(i) for i in ids])


class Coder:
    """Encodes and decodes with one model; lives as long as the worker."""

    def __init__(self, model: PieceModel):
        self.model, self.codes = model, model.table()
        self.cache: dict[str, tuple[int, ...]] = {}
        inside = "" if model.marker_inside else MARK
        self.stretch = re.compile(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n+" if inside and "\n" not in model.alphabet else ".+", re.S)
        self.surface = [
            bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else " ⁇ ".encode() if kind == "unknown" else p.replace(MARK, " ").encode()
            for p, kind in zip(model.pieces, model.kinds)
        ]

    def _uncovered(self, c: str) -> tuple[int, ...]:
        ids = tuple(self.model.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))
        return ids if min(ids) >= 0 else (self.model.unknown,)

    def _alone(self, s: str) -> tuple[int, ...]:
        """One long stretch: pieces cannot cross a pair of neighbours that no piece holds, so it is cut there first."""
        m, out, start = self.model, [], 0
        base, check, value, scores = m.base.tolist(), m.check.tolist(), m.value.tolist(), m.scores.tolist()
        while start < len(s):
            end = start + 1
            while end < len(s) and s[end - 1 : end + 1] in m.pairs:
                end += 1
            codes = self.codes[[ord(c) for c in s[start:end]]].tolist()
            n = len(codes)
            best, frm, via = [0.0] + [float("-inf")] * n, [0] * (n + 1), [-1] * (n + 1)
            for i in range(n):
                state, single = 0, False
                for j in range(i, n):
                    to = base[state] + codes[j]
                    if not codes[j] or check[to] != state:
                        break
                    state = to
                    if value[state] >= 0:
                        single |= j == i
                        if best[i] + scores[value[state]] > best[j + 1]:
                            best[j + 1], frm[j + 1], via[j + 1] = best[i] + scores[value[state]], i, value[state]
                if not single and best[i] + m.least > best[i + 1]:
                    best[i + 1], frm[i + 1], via[i + 1] = best[i] + m.least, i, -1
            parts, at = [], n
            while at:
                parts.append((via[at],) if via[at] >= 0 else self._uncovered(s[start + at - 1]))
                at = frm[at]
            out += reversed(parts)
            start = end
        return tuple(chain.from_iterable(out))

    def _together(self, words: list[str]) -> None:
        m = self.model
        lengths = np.array([len(w) for w in words])
        n, width = len(words), int(lengths.max())
        codes = np.zeros((n, width + m.longest), np.int32)
        flat = self.codes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes[:, :width][np.arange(width)[None, :] < lengths[:, None]] = flat
        best = np.full((n, width + m.longest + 1), -np.inf)
        best[:, 0] = 0.0
        frm, via = np.zeros(best.shape, np.int32), np.full(best.shape, -1, np.int32)
        for i in range(width):
            rows = np.nonzero(lengths > i)[0]
            state, single = np.zeros(len(rows), np.int32), np.zeros(n, bool)
            here, live = best[:, i], rows
            for j in range(i, min(i + m.longest, width)):
                c = codes[live, j]
                to = m.base[state] + c
                ok = (c > 0) & (m.check[to] == state)
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                v = m.value[state]
                score = here[live] + m.scores[v]
                won = (v >= 0) & (score > best[live, j + 1])
                at = live[won]
                best[at, j + 1], frm[at, j + 1], via[at, j + 1] = score[won], i, v[won]
                if j == i:
                    single[live[v >= 0]] = True
            rest = rows[~single[rows]]
            rest = rest[here[rest] + m.least > best[rest, i + 1]]
            best[rest, i + 1], frm[rest, i + 1], via[rest, i + 1] = here[rest] + m.least, i, -1
        for word, n_chars, f, v in zip(words, lengths.tolist(), frm.tolist(), via.tolist()):
            at, parts = n_chars, []
            while at:
                parts.append((v[at],) if v[at] >= 0 else self._uncovered(word[at - 1]))
                at = f[at]
            self.cache[word] = tuple(chain.from_iterable(reversed(parts)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.stretch.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = sorted({w for words in cut for w in words if w not in self.cache}, key=lambda w: (len(w), w))
        short = [w for w in new if len(w) <= LONG]
        for at in range(0, len(short), 4096):
            self._together(short[at : at + 4096])
        long = {w: self._alone(w) for w in new if len(w) > LONG}  # not remembered: a text may be one such stretch
        if not long:
            return [list(chain.from_iterable(map(self.cache.__getitem__, words))) for words in cut]
        return [list(chain.from_iterable(long.get(w) or self.cache[w] for w in words)) for words in cut]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """The worker's coder for a broadcast model, kept between tasks so that its cache is."""
    model = shared.value
    if id(model) not in _coders:
        _coders.clear()
        _coders[id(model)] = Coder(model)
    return _coders[id(model)]


def _slices(column: pa.Array) -> Iterator[tuple[int, list]]:
    """Texts a few million characters at a time, whatever the size of the batch."""
    start, texts, chars = 0, [], 0
    for i, text in enumerate(column):
        text = text.as_py()
        texts.append(text)
        chars += len(text or "")
        if chars >= BATCH_CHARS:
            yield start, texts
            start, texts, chars = i + 1, [], 0
    if texts:
        yield start, texts


def encode_texts(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ids (piece ids), n_ids, n_byte_ids, round_trip (decoding the ids gives the text back).

    Edge cases: a null or empty text has no ids; only the space U+0020 becomes the marker, other white space
    is bytes; a text that holds the marker character itself decodes to a space there, and round_trip says so;
    ties go to the longer last piece; repeated rows and null ids are kept as they are; an empty table gives an
    empty result; other columns are ignored; a text is encoded whole whatever its length.
    """
    source = own_columns(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        byte_ids = frozenset(i for i in coder.model.byte_ids if i >= 0)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                ids = coder.encode(texts)
                same = [coder.decode(x) == (t or "") for x, t in zip(ids, texts)]
                lengths = np.array([len(x) for x in ids], dtype=np.int64)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(lengths.sum()))
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                is_byte = np.isin(flat, list(byte_ids)) if byte_ids else np.zeros(len(flat), bool)
                sums = np.concatenate([[0], np.cumsum(is_byte)])
                bytes_of = sums[np.cumsum(lengths)] - sums[np.cumsum(lengths) - lengths]
                yield pa.record_batch(
                    [batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(lengths), pa.array(bytes_of.astype(np.int64)), pa.array(same)],
                    names=[id_col, "ids", "n_ids", "n_byte_ids", "round_trip"],
                )

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_ids long, n_byte_ids long, round_trip boolean")


def decode_ids(encoded: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``id_col``, text.  Null ids decode to the empty text; broken UTF-8 to replacement characters."""
    source = own_columns(encoded, id_col, ids_col)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), pa.array([coder.decode(x or []) for x in part.column(1).to_pylist()])], names=[id_col, "text"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, text string").select(F.col(f"`{id_col}`"), "text")
