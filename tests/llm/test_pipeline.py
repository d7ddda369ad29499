import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import brute

import corpus_pipeline as P
from driftline.llm.pieces import Coder, load_model


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(P.STAGES)
    first = P.materialize(stages["language"](spark, docs.unionByName(spark.createDataFrame([(-1, "12 34", "en", "s", 5), (-2, None, None, None, None)], docs.schema)), sf), "t")
    assert first.columns == columns
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}

    second = P.materialize(stages["exact_dedup"](spark, first, sf), "t")
    groups = {}
    for r in first.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), r.doc_id))
    assert second.columns == columns
    assert {r.doc_id for r in second.collect()} == {min(g)[1] for g in groups.values()}

    third = P.materialize(stages["near_dedup"](spark, second, sf), "t")
    found = brute.near({r.doc_id: r.text for r in second.collect()}, 5, 80)
    assert third.columns == columns
    assert {r.doc_id for r in third.collect()} == {i for i, (_, c) in found.items() if c == i}

    fourth = P.materialize(stages["mix"](spark, third, sf), "t")
    assert fourth.columns == columns
    taken = Counter(r.doc_id for r in fourth.collect())
    assert set(taken) <= {r.doc_id for r in third.collect()} and max(taken.values()) <= 3

    last = stages["encode"](spark, fourth, sf).collect()
    assert Counter(r.doc_id for r in last) == taken and all(r.round_trip for r in last)
    coder, texts = Coder(load_model(P.PIECES)), {r.doc_id: r.text for r in fourth.collect()}
    assert all(coder.decode(r.ids) == texts[r.doc_id] for r in last)


def test_null_and_repeated_ids(spark):
    """Rows are told apart by more than doc_id: none is lost for a null id, none passes or multiplies by a repeated one."""
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    filler = lambda word, n: " ".join(f"{word}{i}" for i in range(n))
    body = filler("near", 60)
    rows = [
        (None, filler("lone", 50), "s"), (None, filler("other", 50), "s"), (7, "same text", "s"), (7, "same  text", "s"), (7, filler("kept", 40), "t"),
        (9, "same text", "s"), (9, "same  text", "t"), (3, body, "t"), (5, body + " tail", "s"), (5, filler("five", 30), "t"), (None, body + " end", "u"),
    ]
    docs = P.materialize(spark.createDataFrame([(i, x, "en", s, len(x)) for i, x, s in rows], schema).repartition(3), "t")
    stages = dict(P.STAGES)

    second = P.materialize(stages["exact_dedup"](spark, docs, ""), "t")
    dropped = [(7, "same text"), (9, "same text"), (9, "same  text")]  # the longer original stays, then the smaller id
    wanted = Counter((i, x) for i, x, _ in rows) - Counter(dropped)
    assert second.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in second.collect()) == wanted

    third = P.materialize(stages["near_dedup"](spark, second, ""), "t")
    wanted -= Counter([(5, body + " tail"), (None, body + " end")])
    assert Counter((r.doc_id, r.text) for r in third.collect()) == wanted

    twice = P.materialize(third.unionByName(third).unionByName(third), "t")
    fourth = stages["mix"](spark, twice, "").collect()
    copies = Counter((r.doc_id, r.text) for r in fourth)
    assert set(copies) <= set(wanted) and max(copies.values()) <= 9  # three rows of each, each at most three times
    size = Counter()
    for r in twice.collect():
        size[r.source] += len(r.text.split())
    taken = Counter()
    for r in fourth:
        taken[r.source] += len(r.text.split())
    assert all(taken[s] <= 3 * size[s] for s in size)
    assert any(r.doc_id is None for r in fourth)


def test_row_key_follows_the_order_of_ids(spark):
    docs = spark.createDataFrame([(i, str(n)) for n, i in enumerate([5, None, 2, 5, -1, None, 2])], "doc_id long, row_key string").repartition(3)
    keyed, key = P.with_row_key(docs)
    found = [r.doc_id for r in sorted(keyed.collect(), key=lambda r: r[key])]
    assert key not in docs.columns and found == [-1, 2, 2, 5, 5, None, None]
    assert len({r[key] for r in keyed.collect()}) == 7


def test_empty_tables_and_clashing_columns(spark):
    """Each stage returns the columns of documents whatever they are called, and nothing for nothing."""
    extra = ["lang_pred", "score", "spans", "copies", "copy", "id", "row_key", "digest", "kept", "taken", "own_0", "count(1)"]
    rows = [(i, t, lang, s, 1, *[f"{name}{i}" for name in extra]) for i, (t, lang, s) in enumerate([("one text of words", "en", "a"), ("zwei Texte", "de", None), ("12 34", "en", "a"), (None, None, "b"), ("one text of words", None, "b"), ("", "en", "a")])]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{name}` string" for name in extra)
    docs = P.materialize(spark.createDataFrame(rows, schema), "t")
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, docs, ""), "t")
        assert P.materialize(stage(spark, docs.limit(0), ""), "t").count() == 0
        if name != "encode":
            assert out.columns == docs.columns
            assert all(r[f"{x}"] == f"{x}{r.doc_id}" for r in out.collect() for x in extra)
            docs = out
    assert docs.count() > 0


def test_nothing_to_learn_from(spark):
    """Without a single labelled text the language stage keeps what has letters."""
    docs = spark.createDataFrame([(1, "some words", None), (2, "12", None), (3, None, None), (4, "\u0431", None), (5, "", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.known_language(spark, docs, "").collect()} == {1, 4}
