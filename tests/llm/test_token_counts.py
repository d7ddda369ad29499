import random

import pytest
from pyspark.sql import functions as F

from driftline.llm.token_counts import PrefixCounter, load_vocabulary, longest_prefix, prefix_counts, tokens_of_prefix

PATH = "/opt/tokenizers/byte_bpe_50k.json"
ATOMS = ["a", "aa", "the", " ", "  ", "\n", "\t", "'re", "'ll", "'l", "'s", "!", "!!", "don't", "<|endoftext|>", "<|endof", "1", "23", "é", "漢字", "\U0001f600", " ", "ing",
         "tion", "Zz", "x" * 9, "-" * 5, "_", "՘", "ㄴf", "हिन्दी", "\x00", "\x1c", "\x85", " '", "ThE", "\U0003134f"]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    given = Tokenizer.from_file(PATH)
    return lambda text: len(given.encode(text, add_special_tokens=False).ids)


def test_every_prefix_is_counted_as_the_library_counts_it(vocabulary, library):
    rng, counter = random.Random(11), PrefixCounter(vocabulary)
    texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 16))) for _ in range(150)]
    for text, counts in zip(texts, counter.counts(texts)):
        assert counts.tolist() == [library(text[:k]) for k in range(len(text) + 1)], repr(text)


def test_long_stretches_and_forgetting(vocabulary, library):
    rng, counter = random.Random(3), PrefixCounter(vocabulary)
    long = ["a" * 30_000, "".join(rng.choice("abAB") for _ in range(20_000)), "漢" * 5_000, " " * 3_000 + "x", "\n" * 999]
    assert [int(c[-1]) for c in counter.counts(long)] == [library(t) for t in long]
    counter.forget()
    assert [int(c[-1]) for c in counter.counts(long[::-1])] == [library(t) for t in long[::-1]]


def test_on_spark(spark, vocabulary, library):
    rows = [(1, None), (2, ""), (3, "It'll do."), (None, "a  b"), (3, "It'll do."), (4, "word " * 700), (5, "x<|endoftext|>y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 as counts", "1 as n")
    got = prefix_counts(docs, vocabulary).select("doc_id", "counts", tokens_of_prefix(F.col("counts"), 3).alias("three"), longest_prefix(F.col("counts"), 100).alias("fits")).collect()
    assert len(got) == len(rows)
    for (key, text), r in zip(rows, got):
        text = text or ""
        want = [library(text[:k]) for k in range(len(text) + 1)] if len(text) < 100 else None
        assert r.doc_id == key and (want is None or r.counts == want)
        assert r.counts[-1] == library(text) and r.three == library(text[:3])
        assert r.fits == max(k for k, c in enumerate(r.counts) if c <= 100)
    assert prefix_counts(docs.limit(0), vocabulary).count() == 0


def test_query_on_whole_table(spark, library):
    from driftline.llm import queries as q

    docs = {r.doc_id: r.text or "" for r in q.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = q.op11_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), library(text), library(text) > 512)
        assert library(text[: r.fitting_chars]) <= 512 and (r.over_limit or r.fitting_chars == len(text))
