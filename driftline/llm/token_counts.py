"""Token counts of every prefix, by dynamic programming over a byte-level BPE vocabulary.

Two facts make the counts of all prefixes one pass.  A sequence of tokens is what the merges give for its bytes
exactly if each pair of neighbours is what they give for the bytes of the two; and the tokens of a prefix begin with
the tokens of a shorter one, all but the last.  So the last token of a prefix is the one token that ends there and
stands beside the last token of the prefix before it, and the count is that prefix's count and one.  The work is linear
in the text, whatever its stretches without white space.

A vocabulary's pattern first cuts a text into stretches that never share a token.  Where a cut text splits otherwise than
the whole (inside a contraction, at the end of a run of white space, inside a special string) the prefix has its own count;
what follows goes on from the whole's.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import own_columns

# The pattern of byte-level BPE vocabularies, and those of its contractions that split when cut.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT_CONTRACTIONS = ("'re", "'ve", "'ll")

#: The same for texts of ASCII alone, as the standard library matches it faster.
ASCII_PATTERN = r""" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""

#: Above every rank.
NEVER = 1 << 60

#: Characters of texts taken together, and counts and pairs that a worker remembers.
BATCH_CHARS, CACHE, PAIRS = 2_000_000, 12_000_000, 2_000_000


@dataclass
class Vocabulary:
    """Tokens as bytes, merges by rank, special strings, and letters and digits too new for the vocabulary's library."""

    tokens: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    special: tuple[str, ...]
    newer: str


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible ones for themselves, the rest from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE vocabulary from its JSON file (a small local file, read by the driver)."""
    from tokenizers.pre_tokenizers import ByteLevel

    given, letters = json.loads(Path(path).read_text("utf-8")), byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    special = tuple(t["content"] for t in given["added_tokens"])
    tokens = {raw(t): i for t, i in given["model"]["vocab"].items() if t not in special}
    ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in given["model"]["merges"])}
    known, cut = regex.compile(r"[\p{L}\p{N}]"), ByteLevel(add_prefix_space=False).pre_tokenize_str
    late = (c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn" and known.match(c))
    return Vocabulary(tokens, ranks, special, "".join(c for c in late if len(cut("!" + c)) == 1))


class PrefixCounter(dict):
    """A worker's counts: stretch -> number, and for each number the counts of the stretch's prefixes, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pattern = vocabulary, regex.compile(PATTERN)
        self.bytes_of = {i: t for t, i in vocabulary.tokens.items()}
        self.beginnings = {t[:i] for t in vocabulary.tokens for i in range(len(t) + 1)}
        #: States are beginnings of tokens: the longest that ends at a place; steps and tokens of a state are found when first met.
        self.states, self.state_of, self.steps, self.ending = [b""], {b"": 0}, {}, [()]
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[list, list] | None] = {}
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.ascii, self.late = re.compile(ASCII_PATTERN), frozenset(vocabulary.newer)
        self.newer = str.maketrans(dict.fromkeys(vocabulary.newer, "§"))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.starts, self.lengths, self.blank, self.led = array("i"), array("q"), array("i"), bytearray(), bytearray()

    def edges(self, token: int) -> tuple[list, list] | None:
        """The first and the last part of a token while merges build it, each with the rank of the merge that ends it.

        None if the merges give other tokens for its bytes: then it occurs nowhere.
        """
        if token not in self.made:
            raw, ranks = self.bytes_of[token], self.vocabulary.ranks
            parts, first, last = [raw[i : i + 1] for i in range(len(raw))], [], []
            while len(parts) > 1:
                rank, at = min((ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                if at == 0:
                    first.append((parts[0], rank))
                if at == len(parts) - 2:
                    last.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.made[token] = ([*first, (raw, NEVER)], [*last, (raw, NEVER)]) if parts == [raw] else None
        return self.made[token]

    def stands(self, before: int, token: int) -> bool:
        """Whether the merges leave ``token`` as it is behind ``before`` (-1: at the start).

        It does not if a part at the end of one and a part at the start of the other merge before other merges end
        them; of equal merges the left one comes first.
        """
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        own, ranks = self.edges(token), self.vocabulary.ranks
        found = own is not None
        if found and before >= 0:
            for left, ends in self.edges(before)[1]:
                if any(ranks.get((left, right), NEVER) < ends and ranks[left, right] <= until for right, until in own[0]):
                    found = False
                    break
        self.pairs[before << 32 | token] = found
        return found

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest beginning of a token that ends with it."""
        part = self.states[state] + bytes([byte])
        while part not in self.beginnings:
            part = part[1:]
        if part not in self.state_of:
            tokens = self.vocabulary.tokens
            self.state_of[part] = len(self.states)
            self.states.append(part)
            self.ending.append(tuple((len(part) - i, tokens[part[i:]]) for i in range(len(part)) if part[i:] in tokens))
        found = self.steps[state << 8 | byte] = self.state_of[part]
        return found

    def learn(self, raws: list[bytes]) -> Iterator[list[int]]:
        """Per stretch the counts of its prefixes of 0, 1, 2, ... bytes: of the tokens that end at a place, one stands.

        What a stretch shares at its start with the one before is not done again.  The list is good until the next.
        """
        steps, ending, pairs, step, stands = self.steps, self.ending, self.pairs, self.step, self.stands
        counts, last, states, done = [0], [-1], [0], b""
        for raw in raws:
            end = 0
            for a, b in zip(raw, done):
                if a != b:
                    break
                end += 1
            del counts[end + 1 :], last[end + 1 :], states[end + 1 :]
            done, state = raw, states[end]
            for byte in raw[end:]:
                end += 1
                key = state << 8 | byte
                state = steps[key] if key in steps else step(state, byte)
                states.append(state)
                for size, token in ending[state]:
                    pair = last[end - size] << 32 | token
                    if pairs[pair] if pair in pairs else stands(pair >> 32, token):
                        counts.append(counts[end - size] + 1)
                        last.append(token)
                        break
            yield counts

    def remember(self, stretches: list[str]) -> None:
        raws = [s.encode() for s in stretches]
        starts, lengths, flat, number = self.starts, self.lengths, self.flat, len(self.lengths)
        for stretch, raw, counts in zip(stretches, raws, self.learn(raws)):
            if len(raw) > len(stretch):  # a character's count is that of its last byte
                counts = [0] + [c for c, after in zip(counts[1:], chain(raw[1:], b"a")) if after & 0xC0 != 0x80]
            elif stretch in CUT_CONTRACTIONS:
                counts = [*counts[:2], 2, *counts[3:]]
            starts.append(len(flat) + 1)
            lengths.append(len(counts) - 1)
            flat.extend(counts)
            self[stretch] = number
            number += 1
        self.blank.extend(s.isspace() for s in stretches)
        self.led.extend(s[:1].isspace() for s in stretches)

    def stretches(self, text: str) -> list[str]:
        """The text cut by the pattern; characters too new for the vocabulary's library are neither letters nor digits."""
        if text.isascii():
            return self.ascii.findall(text)
        if self.late.isdisjoint(text):
            return self.pattern.findall(text)
        ends = np.cumsum([0] + [len(s) for s in self.pattern.findall(text.translate(self.newer))]).tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def of_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Counts of the prefixes of 1, 2, ... characters of texts in which special strings count for nothing."""
        if len(self.flat) > CACHE:
            self.forget()
        cut = [self.stretches(t) for t in texts]
        words = list(chain.from_iterable(cut))
        self.remember(sorted([w for w in set(words) if w not in self]))  # neighbours share their beginnings
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        lengths = np.frombuffer(self.lengths, np.int32)[ids].astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        starts = np.frombuffer(self.starts, np.int64)[ids] if len(ids) else np.zeros(0, np.int64)
        at = np.cumsum(lengths) - lengths
        whole = flat[starts + lengths - 1].astype(np.int64)
        before = np.cumsum(whole) - whole
        per_text = np.array([len(c) for c in cut], np.int64)
        firsts = np.cumsum(per_text) - per_text
        base = np.repeat(np.append(before, 0)[firsts], per_text)
        before -= base
        out = np.arange(int(lengths.sum()))
        out += np.repeat(starts - at, lengths)
        out = flat[out]
        out += np.repeat(before.astype(np.int32), lengths)
        if len(ids) > 1:  # a run of white space that the whole text cuts before its last character, and a prefix does not
            blank, led = np.frombuffer(self.blank, np.uint8)[ids], np.frombuffer(self.led, np.uint8)[ids]
            inside = np.ones(len(ids), bool)
            inside[firsts[firsts < len(ids)]] = False
            for i in np.flatnonzero(blank[:-1] & led[1:] & inside[1:]).tolist():
                run = (words[i] + words[i + 1][0]).encode()
                out[at[i + 1]] = before[i] + next(self.learn([run]))[-1]
        ends = np.cumsum([len(t) for t in texts])[:-1]
        return np.split(out, ends)

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the token counts of its prefixes of 0, 1, 2, ... characters, as the library gives them for each prefix.

        A special string is one token from its last character on; a prefix that ends inside one holds plain characters.
        """
        pieces, layout = [], []
        for text in texts:
            found = [m.span() for m in self.special.finditer(text)] if self.special else []
            at = 0
            for start, end in found:
                pieces.append(text[at : end - 1])
                layout.append((start - at, True))
                at = end
            pieces.append(text[at:])
            layout.append((0, False))
        zero, out, base, parts = np.zeros(1, np.int32), [], 0, []
        for values, (own, special) in zip(self.of_plain(pieces), layout):
            parts.append(values + np.int32(base) if base else values)
            if special:
                base += (int(values[own - 1]) if own else 0) + 1
                parts.append(np.array([base], np.int32))
            else:
                out.append(np.concatenate([zero, *parts]))
                base, parts = 0, []
        return out


_counters: dict[int, PrefixCounter] = {}


def _counter(shared) -> PrefixCounter:
    """The worker's counter of a broadcast vocabulary, kept between tasks so that what it remembers is."""
    vocabulary = shared.value
    if id(vocabulary) not in _counters:
        _counters.clear()
        _counters[id(vocabulary)] = PrefixCounter(vocabulary)
    return _counters[id(vocabulary)]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts (null: empty) up to two million characters at a time, whatever the size of the batch."""
    start, texts, chars = 0, [], 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if texts and chars + len(text) > BATCH_CHARS:
            yield start, texts
            start, texts, chars = i, [], 0
        texts.append(text)
        chars += len(text)
    if texts:
        yield start, texts


def prefix_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, counts (array: tokens of the first 0, 1, 2, ... code points of the text).

    The last entry is the count of the whole text.  ``tokens_of_prefix`` and ``longest_prefix`` answer questions from it.

    Edge cases: a null or empty text has the one count 0; counts may fall as a prefix grows, where a longer token
    replaces shorter ones; a special string inside a text is one token; repeated rows and null ids are kept as they are;
    an empty table gives an empty result; other columns are ignored; a text is counted whole whatever its length.
    """
    source = own_columns(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                counts = counter.counts(texts)
                offsets = np.cumsum([0] + [len(c) for c in counts]).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(counts)))
                yield pa.record_batch([batch.column(0).slice(start, len(texts)), rows], names=[id_col, "counts"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, counts array<int>")


def tokens_of_prefix(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points; of the whole text where it is shorter."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.element_at(counts, F.least(chars + 1, F.size(counts)).cast("int"))


def longest_prefix(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))
