import itertools
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np

from driftline.llm import language_id as L
from driftline.llm.language_id import Identifier, best_path, held_out, identify, learn, learn_from_training_fold, words_of

SF = "/root/testdata/sf0.01"


def brute_path(scores, switch):
    n, k = scores.shape
    best = max(itertools.product(range(k), repeat=n), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])))
    return sum(scores[i, x] for i, x in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:]))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.normal(size=(rng.integers(1, 7), rng.integers(1, 4))) * 3
        p = best_path(scores, 2.0)
        got = sum(scores[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(got - brute_path(scores, 2.0)) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn_from_training_fold(docs)
    rows = identify(docs.withColumn("score", held_out()), model).join(docs.select("doc_id", "lang", held_out().alias("held")), "doc_id").where("held").collect()
    assert len(rows) > 250
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn_from_training_fold(docs)
    by = {}
    for r in docs.where("lang is not null").collect():
        by.setdefault(r.lang, []).append(r.text)
    rng = random.Random(3)
    long = lambda x: " ".join(next(t for t in rng.sample(by[x], 30) if len(words_of(t)) > 60).split()[:60])
    text = f"{long('de')} {long('fr')}"
    lang, score, spans = Identifier(model).label([text])[0]
    assert [s[2] for s in spans][0] == "de" and [s[2] for s in spans][-1] == "fr"
    assert 0.4 < score < 0.6 or len(spans) == 2


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (4, "кот и пёс", "ru"), (None, None, None), (7, "", "en"), (7, "123 ² --", "en"), (8, "кот", None), (8, "кот", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as spans")
    model = learn(docs)
    assert model.languages == ["en", "fr", "ru"]
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in identify(docs, model).collect())
    assert [g for g in got if g[0] in (0, 7)] == [(0, "und", 0.0), (7, "und", 0.0), (7, "und", 0.0)]
    assert [g[1] for g in got if g[0] == 8] == ["ru", "ru"]
    assert identify(docs.limit(0), model).count() == 0
    none = learn(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"}


def plain_words(text):
    """Walks the code points: a letter opens a word, letters, marks and joiners continue it."""
    out, now = [], ""
    for c in text.lower() + " ":
        letter = c.isalnum() and not c.isdecimal() and not c.isdigit() or c.isdigit() and not c.isdecimal()
        if letter or now and (unicodedata.category(c) in ("Mn", "Mc") or c in "\u200c\u200d"):
            now += c
        else:
            out += [now] if any(x.isalpha() for x in now) else []
            now = ""
    return out


def test_marks_stay_in_words():
    """Devanagari, Bengali, Tamil, Thai, vowelled Arabic and Hebrew, decomposed Latin, a joiner, a mark without a letter."""
    assert words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert words_of("বাংলা") == ["বাংলা"]
    assert words_of("தமிழ் மொழி") == ["தமிழ்", "மொழி"]
    assert words_of("ภาษาไทยที่ดี") == ["ภาษาไทยที่ดี"]
    assert words_of("مُحَمَّد שָׁלוֹם") == ["مُحَمَّد", "שָׁלוֹם"]
    assert words_of("Cafe\u0301s noir") == ["cafe\u0301s", "noir"]
    assert words_of("می\u200cخواهم") == ["می\u200cخواهم"]
    assert words_of("\u0301 1\u0301 \u200d") == []
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("aB é1_-\u0301\u093f\u0e34\u200dकதชע٣²") for _ in range(30))
        assert words_of(text) == plain_words(text)


def test_scripts_with_marks(spark):
    """Hindi against Marathi and Tamil: words of one script are told apart by their whole n-grams; a very long text as well."""
    hi, mr, ta = "यह हिन्दी में लिखा हुआ एक वाक्य है और इसमें शब्द हैं", "हे मराठीत लिहिलेले एक वाक्य आहे आणि त्यात शब्द आहेत", "இது தமிழில் எழுதப்பட்ட ஒரு வாக்கியம்"
    rows = [(2, hi, "hi"), (3, mr, "mr"), (5, ta, "ta"), (20, "हिन्दी में शब्द हैं", None), (21, "मराठीत शब्द आहेत", None), (22, "ஒரு வாக்கியம்", None), (23, (mr + " ") * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(docs, learn(docs)).collect()}
    assert [got[i] for i in (20, 21, 22, 23)] == ["hi", "mr", "ta", "mr"]


def plain_buckets(word):
    points, out = [1, *map(ord, word), 1], []
    for n in range(1, L.LONGEST + 1):
        for at in range(len(points) - n + 1):
            if n == 1 and points[at] == 1:
                continue
            h = 0
            for k in range(n):
                h = (h * 0x100000001B3 + points[at + k] + k + 1) % 2**64
            out.append((h * 0x9E3779B97F4A7C15 % 2**64 >> 48) % L.BUCKETS)
    return out


def plain_script(word):
    return [name for start, name in L.SCRIPTS if start <= ord(word[0])][-1]


def plain_identify(rows):
    """{doc_id: (language, score)} of (doc_id, text, lang) rows: counts, scores and the whole trellis in loops."""
    counts, letters, words = defaultdict(Counter), defaultdict(Counter), {i: words_of(t) for i, t, _ in rows}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1:
            for w in words[i]:
                counts[lang].update(plain_buckets(w))
                letters[lang][plain_script(w)] += len(w)
    langs = sorted(x for x in counts if counts[x])
    total = {x: sum(counts[x].values()) for x in langs}
    log = lambda x, b: math.log((counts[x][b] + 0.5) / (total[x] + 0.5 * L.BUCKETS))
    own = lambda x, s: letters[x][s] >= L.SCRIPT_SHARE * max(1, sum(letters[x].values()))

    def score(word):
        every = [[log(x, b) for x in langs] for b in plain_buckets(word)]
        sums = [sum(row[k] - sum(row) / len(row) for row in every) for k in range(len(langs))]
        script = plain_script(word)
        fits = [own(x, script) for x in langs]
        return [v if ok or not any(fits) else min(sums) - 50 for v, ok in zip(sums, fits)]

    known, out = {}, {}
    for i, _, _ in rows:
        if not words[i]:
            out[i] = "und", 0.0
            continue
        now, back = None, []
        for w in words[i]:
            row = known.setdefault(w, score(w))
            if now is None:
                now = row
                continue
            best = max(range(len(langs)), key=now.__getitem__)
            step = [k if now[k] >= now[best] - L.SWITCH else best for k in range(len(langs))]
            now = [max(now[k], now[best] - L.SWITCH) + row[k] for k in range(len(langs))]
            back.append(step)
        path = [max(range(len(langs)), key=now.__getitem__)]
        for step in reversed(back):
            path.append(step[path[-1]])
        many = Counter(path)
        top = min(many, key=lambda k: (-many[k], k))
        out[i] = langs[top], many[top] / len(path)
    return out


def test_whole_query_against_loops(spark):
    """Every document of the smallest table, with mixed, foreign, tied and very long texts added."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    texts = {lang: next(t for _, t, x in rows if x == lang and t and len(t) > 400) for lang in {r[2] for r in rows if r[2]}}
    some = sorted(texts)
    rows += [(-1, texts[some[0]] + " " + texts[some[1]], None), (-2, "кот и пёс", None), (-3, "q", None), (-4, (texts[some[2]] + " ") * 60, None), (-5, None, some[0]), (-6, "12 ²", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = plain_identify(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, learn_from_training_fold(df)).collect()}
    assert set(got) == set(want)
    assert [i for i in want if got[i][0] != want[i][0]] == []
    assert all(abs(got[i][1] - want[i][1]) < 0.01 for i in want)
    assert got[-5] == got[-6] == ("und", 0.0)


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(2, "same words here", "b"), (3, "same words here", "a"), (5, "same words here", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(docs, learn(docs)).collect()} == {"a"}
