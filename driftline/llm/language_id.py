"""Language identification of texts and of the spans of mixed texts.

Each word is scored per language by a naive Bayes model over its hashed character n-grams.  The script of
the word (by code point ranges) narrows the candidates to languages that were seen in that script.  Viterbi
over the word scores, with a penalty for every switch of language, labels the spans of a text.  The model is
learned from a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import own_columns

#: Buckets of hashed n-grams, longest n-gram, documents sampled per language (about), nats per switch of
#: language, least share of a language's letters for a script to be its own, words remembered by a worker.
BUCKETS, LONGEST, SAMPLE, SWITCH, SCRIPT_SHARE, CACHE = 1 << 16, 4, 3000, 8.0, 0.02, 300_000

#: First code point of ranges of scripts, in order; code points below the first are Latin.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3400, "Han"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF66, "Katakana"), (0x10000, "Other"), (0x20000, "Han"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_KIND = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def _marks() -> str:
    """Combining marks and joiners below 0x20000 (no script has its own above) as the inside of a character class: they continue a word and begin none."""
    joins = [unicodedata.category(chr(p)) in ("Mn", "Mc") or p in (0x200C, 0x200D) for p in range(0x20000)]
    edges = [p for p in range(1, len(joins)) if joins[p] != joins[p - 1]]
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(edges[::2], edges[1::2]))


_WORDS = re.compile(rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*")
_EDGE = 1  # code point that stands for the beginning and end of a word


def words_of(text: str | None) -> list[str]:
    """Runs of letters with the marks and joiners that follow them, lower-cased; a text with no letter has none."""
    found = _WORDS.findall(text.lower()) if text else []
    if text and text.isascii():
        return found
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]  # not of numeric signs alone


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of every word, edges included."""
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    edge = chr(_EDGE)
    points = np.frombuffer("".join(f"{edge}{w}{edge}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, buckets = [], []
    grams = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        grams = (grams[: len(points) - n + 1] if n > 1 else grams) * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        inside = owner[: len(points) - n + 1] == owner[n - 1 :]
        if n == 1:
            inside = inside & (points != _EDGE)
        mixed = grams * np.uint64(0x9E3779B97F4A7C15)
        owners.append(owner[: len(points) - n + 1][inside])
        buckets.append((mixed[inside] >> np.uint64(48)).astype(np.int64) % BUCKETS)
    return np.concatenate(owners), np.concatenate(buckets)


def _script_of(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words])
    return _KIND[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass
class LanguageModel:
    """Languages, centred log probabilities per bucket (BUCKETS x languages), and which scripts a language has."""

    languages: list[str]
    logs: np.ndarray
    scripts: np.ndarray  # scripts x languages, true where a word of the script may be of the language


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, bucket, n); buckets from BUCKETS on are letters by script."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for lang, text in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns]):
                words = words_of(text)
                if not words:
                    continue
                row = totals.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                row[:BUCKETS] += np.bincount(_features(words)[1], minlength=BUCKETS)
                row[BUCKETS:] += np.bincount(_script_of(words), weights=[len(w) for w in words], minlength=len(_NAMES)).astype(np.int64)
    for lang, row in totals.items():
        at = np.nonzero(row)[0]
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learn from about ``sample`` documents per language, picked by a hash of the id; rows without language or text are ignored.

    The driver receives at most BUCKETS counts per language, whatever the size of the corpus.
    """
    rows = own_columns(labelled, id_col, text_col, lang_col).toDF("id", "text", "lang").where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).collect()
    picked = F.lit(False)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    for r in sizes:
        picked = picked | ((F.col("lang") == r.lang) & (draw < F.lit(sample / r.docs)))
    counted = rows.where(picked).select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique().tolist())
    counts = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    if len(counted):
        counts[counted["bucket"].to_numpy(), counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()] = counted["n"].to_numpy()
    logs = np.log((counts[:BUCKETS] + 0.5) / (counts[:BUCKETS].sum(axis=0, keepdims=True) + 0.5 * BUCKETS)) if languages else np.zeros((BUCKETS, 0))
    if languages:
        logs -= logs.mean(axis=1, keepdims=True)
    scripts = counts[BUCKETS:] >= SCRIPT_SHARE * np.maximum(1, counts[BUCKETS:].sum(axis=0, keepdims=True))
    scripts[~scripts.any(axis=1)] = True  # a script of no language leaves all candidates
    return LanguageModel(languages, logs.astype(np.float32), scripts)


def _stretch_path(scores: np.ndarray, home: int, switch: float, opens: bool, closes: bool) -> list[int]:
    """Viterbi over one stretch whose neighbours (unless it ``opens`` or ``closes`` the text) are of language ``home``."""
    rows, k = scores.tolist(), scores.shape[1]
    now = [x if opens or j == home else x - switch for j, x in enumerate(rows[0])]
    back: list[list[int] | None] = [None]
    for row in rows[1:]:
        most = max(now)
        best, away = now.index(most), most - switch
        back.append([j if now[j] >= away else best for j in range(k)])
        now = [(x if x >= away else away) + y for x, y in zip(now, row)]
    last = [x if closes or j == home else x - switch for j, x in enumerate(now)]
    path = [last.index(max(last))]
    for step in reversed(back[1:]):
        path.append(step[path[-1]])
    return path[::-1]


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi: the language of each word that maximises summed scores less ``switch`` for every change.

    A stay away from the best single language costs at least one switch and gains at most its words' best gains.
    Words that lie in no run of words with summed gains above ``switch`` are therefore of that language in a
    best path, and each stretch of other words is decided by itself, between words of that language.
    """
    n, k = scores.shape
    scores = scores.astype(np.float64)
    whole = int(scores.sum(axis=0).argmax())
    path = np.full(n, whole, dtype=np.int64)
    if k == 1:
        return path
    gain = np.delete(scores, whole, axis=1).max(axis=1) - scores[:, whole]
    total = np.concatenate([[0.0], np.cumsum(gain)])
    # The best run of words that holds word t: from the lowest sum before it to the highest sum after it.
    run = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
    inside = np.concatenate([[False], run > switch, [False]])
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        path[start:end] = _stretch_path(scores[start:end], whole, switch, start == 0, end == n)
    return path


class Identifier:
    """Scores words with one model, remembering those it has met."""

    def __init__(self, model: LanguageModel):
        self.model, self.known = model, {}
        self.rows = np.zeros((0, len(model.languages)), np.float32)

    def _scores(self, words: list[str]) -> np.ndarray:
        m = self.model
        owner, bucket = _features(words)
        out = np.zeros((len(words), len(m.languages)))
        starts = np.argsort(owner, kind="stable")
        owner, values = owner[starts], m.logs[bucket[starts]]
        firsts = np.searchsorted(owner, np.arange(len(words)))
        out[:] = np.add.reduceat(values, firsts, axis=0)
        return np.where(m.scripts[_script_of(words)], out, out.min(axis=1, keepdims=True) - 50.0).astype(np.float32)

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.known, self.rows = {}, self.rows[:0]
        new = list({w for words in texts for w in words if w not in self.known})
        if new:
            start = len(self.rows)
            self.rows = np.concatenate([self.rows, *[self._scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]])
            self.known.update(zip(new, range(start, start + len(new))))
        return [self.rows[list(map(self.known.__getitem__, words))] for words in texts]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language of the most words, its share of the words, spans (begin, end, language) in code points) of each text."""
        words = [words_of(t) for t in texts]
        if not self.model.languages:
            return [("und", 0.0, [])] * len(texts)
        out = []
        for text, own, scores in zip(texts, words, self.scores(words)):
            if not own:
                out.append(("und", 0.0, []))
                continue
            path = best_path(scores)
            counts = np.bincount(path, minlength=len(self.model.languages))
            top = int(counts.argmax())
            changes = np.nonzero(np.diff(path))[0] + 1
            if len(changes):
                lowered = text.lower()
                places = [(x.start(), x.end()) for x in _WORDS.finditer(lowered) if any(map(str.isalpha, x[0]))]
                edges = [0, *changes.tolist(), len(path)]
                spans = [(places[a][0], places[b - 1][1], self.model.languages[path[a]]) for a, b in zip(edges, edges[1:])]
            else:
                spans = [(0, len(text), self.model.languages[top])]
            out.append((self.model.languages[top], float(counts[top] / len(path)), spans))
        return out


_identifiers: dict[int, Identifier] = {}


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: ``id_col`` (or with ``keep`` all columns), lang_pred, score, spans.

    lang_pred is a learned language, or ``und`` for a text that is null, empty or without letters, and for all where nothing was learned (score 0,
    no spans); score is the share of the text's words in lang_pred; ties go to the first language by name.
    Repeated rows and null ids are kept; an empty table gives an empty result; other columns are ignored
    (with ``keep`` they must not be named as the new ones); texts are used whole.
    """
    source = docs if keep else own_columns(docs, id_col, text_col)
    names = source.columns
    at_text = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if id(model) not in _identifiers:
            _identifiers.clear()
            _identifiers[id(model)] = Identifier(model)
        identifier = _identifiers[id(model)]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = identifier.label(part.column(at_text).to_pylist())
                spans = pa.array([[{"begin": a, "end": b, "lang": x} for a, b, x in s] for _, _, s in found], kind)
                kept = part.columns if keep else [part.column(0)]
                yield pa.record_batch([*kept, pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), spans], names=[*(names if keep else names[:1]), "lang_pred", "score", "spans"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in (source.schema if keep else source.schema[:1])]
    return source.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>"]))


def held_out(id_col: str = "doc_id"):
    """True for documents that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn_from_training_fold(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    return learn(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
