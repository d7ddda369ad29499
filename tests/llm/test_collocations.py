import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from driftline.llm import collocations as c


def brute(docs, least, longest, most):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:most], 1)]
    return sorted(out)


def made(seed, docs=60):
    rng = random.Random(seed)
    words = "a B b. c, the über THE zz\tq x;y é 漢 -- 1 \x00  ".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(docs)]
    rows = [(rng.choice(["en", "de", None, "und", ""]), t) for t in texts]
    return rows + rows[:9] + [("en", None), ("en", ""), ("en", " . \n"), (None, "the zz q " * 200), ("fr", "x " * 500)]


@pytest.mark.parametrize("seed, least, shard", [(1, 2, 5_000_000), (2, 3, 400), (3, 5, 60)])
def test_matches_brute_force(spark, monkeypatch, seed, least, shard):
    monkeypatch.setattr(c, "SHARD_BYTES", shard)
    monkeypatch.setattr(c, "LEAST_BITS", 64)  # a filter so small that it lets much through
    rows = made(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 as f", "2 as phrase", "3 as n").repartition(3)
    got = c.collocations(docs, least=least, most=40).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, 5, 40)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert c.collocations(docs).collect() == []
    assert c.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_suffix_order_is_the_order_of_words():
    rng = np.random.default_rng(4)
    for _ in range(30):
        ids = rng.integers(-1, 4, rng.integers(0, 80)).astype(np.int32)
        room = c.reaching((ids >= 0).astype(np.int8), np.append((ids[:-1] >= 0) & (ids[1:] >= 0), False) if len(ids) else np.zeros(0, bool), 5)
        order, common = c.suffix_order(ids, room, 5)
        cut = [tuple(ids[i : i + room[i]].tolist()) for i in order]
        assert cut == sorted(cut) and len(set(order.tolist())) == len(ids)
        for length in range(1, 6):
            at, counts = c.interval_counts(order, common, room, length)
            want = Counter(tuple(ids[i : i + length].tolist()) for i in range(len(ids)) if room[i] >= length)
            assert {tuple(ids[i : i + length].tolist()): n for i, n in zip(at.tolist(), counts.tolist())} == want and len(at) == len(want)


def test_filter_never_loses_a_key(spark):
    hashes = c.word_hashes("en", pa.array([f"w{i}" for i in range(4000)]))
    keys = (hashes[:3000] >> c.KEY_SHIFT).astype(np.int64).tolist()
    rows = [(k, 1 + i % 2) for i, k in enumerate(keys)] + [(k, 1) for k in keys[::2]]
    known = c.key_filter(spark.createDataFrame(rows, "key long, f long"), 2)
    assert known.has(hashes[:3000]).all() and known.has(hashes[3000:]).mean() < 0.1
    assert c.key_filter(spark.createDataFrame(rows, "key long, f long"), 3).has(hashes).mean() == 0


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(c, "SHARD_BYTES", 20)
    text = b"one two, three four five six. seven" * 9
    assert b"".join(c._portions(text)) == text and max(map(len, c._portions(text))) <= 40
    assert list(c._portions(b"word " * 30)) == [b"word " * 30]


def test_shards_are_stored_as_bytes_in_small_row_groups(spark, monkeypatch):
    # As arrays of words, all shards of a file, a row group, stood in the executors' memory at once.
    stored, keep = {}, c.materialize
    monkeypatch.setattr(c, "SHARD_BYTES", 300)
    monkeypatch.setattr(c, "materialize", lambda df, name, **options: stored.setdefault(name, keep(df, name, **options)))
    rows = [("en" if i % 3 else None, f"b a, w{i} a A. " * 20) for i in range(120)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    _, totals = c.phrase_counts(docs.coalesce(1), least=2)
    shards = stored["shards"]
    assert {f.name: f.dataType.simpleString() for f in shards.schema} == {"lang": "string", "n": "bigint", "ids": "binary", "words": "binary"}
    groups = [f.metadata.row_group(i).num_rows for f in ds.dataset(shards.stored_at.removeprefix("file:")).get_fragments() for i in range(f.metadata.num_row_groups)]
    assert sum(groups) == shards.count() > 40 and max(groups) <= 8
    found = {"en": Counter(), "und": Counter()}
    for r in shards.collect():
        (ids,), (words, counts) = (c._unpacked(pa.scalar(bytes(b))) for b in (r.ids, r.words))
        assert [int(x) for x in np.bincount([i for i in ids.to_pylist() if i >= 0])] == counts.to_pylist() and sum(counts.to_pylist()) == r.n
        found[r.lang].update(dict(zip(words.to_pylist(), counts.to_pylist())))
    want = {"en": Counter(), "und": Counter()}
    for lang, text in rows:
        want[lang or "und"].update(re.findall(r"[^ ,.]+", text.lower()))
    assert found == want and {r.lang: r.n for r in totals.collect()} == {k: v.total() for k, v in want.items()}
