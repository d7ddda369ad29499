import hashlib
import random

from driftline.llm import substring_dedup
from driftline.llm.substring_dedup import ContextTree, anchors, prefix_intervals, remove_repeats


def brute(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for where in seen.values():
        if len(where) > 1:
            for d, i in where:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for b, g in zip(data, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(5)]
    texts = [None, "", "x", "a" * 300, "ab" * 150]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut : rng.randint(cut, len(p))] if rng.random() < 0.5 else p, word()]
        texts.append("".join(parts))
    return texts


def test_intervals():
    assert sorted(prefix_intervals([2, 1, 3, 3, 0, 2])) == sorted([(2, 0, 1), (3, 2, 4), (1, 0, 4), (2, 5, 6), (0, 0, 6)])


def test_anchors_are_shared_by_equal_strings():
    rng = random.Random(2)
    body = bytes(rng.choice(b"abc") for _ in range(80))
    for _ in range(30):
        x = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        a, _ = anchors(body, 40, 8)
        b, _ = anchors(x + body, 40, 8)
        for i in range(len(body) - 39):
            assert {p - i for p in a if i <= p <= i + 32} >= {p - i - len(x) for p in b if i <= p - len(x) <= i + 32 and p - len(x) in set(a)}
            assert any(i <= p <= i + 32 and p + len(x) in set(b) for p in a)


def test_repeat_groups_and_cover():
    rng = random.Random(4)
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for _ in range(60):
        contexts = list({(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))), bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 8)))) for _ in range(rng.randint(2, 25))})
        if len(contexts) < 2:
            continue
        want_l, want_r, want_pairs = [0] * len(contexts), [0] * len(contexts), set()
        for i, a in enumerate(contexts):
            for j, b in enumerate(contexts):
                l, r = share(a[0][::-1], b[0][::-1]), share(a[1], b[1])
                if i != j and l + r >= 7:
                    want_l[i], want_r[i] = max(want_l[i], l), max(want_r[i], r)
                    want_pairs.add((i, j))
        tree = ContextTree(contexts, 7)
        before, after = tree.cover()
        assert (before.tolist(), after.tolist()) == (want_l, want_r)
        assert {(i, j) for members, _, _ in tree.repeats() for i in members for j in members if i != j} == want_pairs


def run(spark, texts, length, gram, most):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as id", "2 as gram")
    rows = remove_repeats(df, length=length, gram=gram, most_classes=most).collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_against_all_strings(spark):
    for seed, most in ((1, 20_000), (2, 3)):
        texts = corpus(seed)
        assert run(spark, texts, 64, 8, most) == brute(texts, 64)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "q" * 70), (1, "r" * 30 + "s" * 50), (1, "r" * 30 + "s" * 50), (None, "r" * 20 + "s" * 45), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df, length=64, gram=8).collect())
    want = sorted(x[:3] for x in brute([t for _, t in rows], 64))
    assert got == want
    assert remove_repeats(df.limit(0)).count() == 0


def test_planted_passages_of_over_fifty_words(spark):
    """Passages in two documents each go whole from 400 bytes on, shorter ones stay, clean documents lose nothing; n_bytes is the input's size in all."""
    rng = random.Random(9)
    words = lambda n, most: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, most))) for _ in range(n))
    docs, want = [], []
    for most in (5, 11) * 12:
        passage = words(rng.randint(51, 70), most)
        for end in (("<", ">"), ("[", "]")):  # so that no shared blank lengthens the passage
            docs.append(words(40, 7) + end[0] + passage + end[1] + words(60, 7))
            want.append((len(docs[-1]), len(passage) if len(passage) >= 400 else 0))
    for _ in range(24):
        docs.append(words(150, 7))
        want.append((len(docs[-1]), 0))
    assert {r > 0 for _, r in want[:48]} == {True, False}
    got = sorted(remove_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed) for r in got] == want


def test_hot_gram_is_counted_in_few_strings(spark, monkeypatch):
    """A line repeated behind many beginnings: exact, and far fewer strings are counted than the 57 windows of each context."""
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("klmnopqrst") for _ in range(n))
    line = "the line that all repeat; "
    texts = [made(rng.randint(20, 60)) + line * rng.randint(4, 8) + made(rng.randint(0, 90)) for _ in range(150)]
    tables, keep = {"windows": [], "contexts": []}, substring_dedup.materialize

    def counted(df, name):
        out = keep(df, name)
        if name in tables:
            tables[name].append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "materialize", counted)
    assert run(spark, texts, 64, 8, 10) == brute(texts, 64)
    assert tables["contexts"][-1] > 500
    assert sum(tables["windows"]) < 20 * tables["contexts"][-1]
