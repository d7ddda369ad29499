"""Exact and near deduplication, vector joins, mixing and components, against brute force, with edge cases."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

import brute
from pyspark.sql import functions as F

from driftline.llm import metric_join, mixing, near_dedup as nd
from driftline.llm.components import connected_components
from driftline.llm.exact_dedup import exact_dedup
from driftline.llm.mixing import golden_point, mix_pieces, mix_sources, schedule


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((40, 30), (60, 80)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)]
        df = spark.createDataFrame(links, "a long, b long")
        want = brute.components(range(200), [x for x in links if x[0] is not None])
        got = {r.id: r.component for r in connected_components(df).collect()}
        assert got == {i: want[i] for i in got}
        assert set(got) == {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert connected_components(df.limit(0)).count() == 0


def test_exact(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "é"), (8, "e"), (9, "x" * 200_000), (10, "x" * 200_000), (11, "a b"), (None, "ab"), (12, "z"), (12, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "'k' as content", "2 as id")
    got = exact_dedup(df, salts=3).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    by_text = {hashlib.sha256(k.encode()).hexdigest(): (min(g)[3], len(g)) for k, g in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_text[r.text_sha256]
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup(df.limit(0)).count() == 0


def near_corpus(rng, groups=25):
    words = [f"w{i}" for i in range(400)]
    docs, i = {}, 0
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, 12)):
            text = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.05]) else w for w in base]
            docs[i] = " ".join(text) if rng.random() < 0.9 else "  ".join(text).upper()
            i += 1
    docs |= {i: "", i + 1: None, i + 2: " \t\n", i + 3: "one", i + 4: "ONE", i + 5: "one two", i + 6: "é É", i + 7: "é é"}
    return docs


def test_near_against_brute_force(spark):
    for seed, k, percent in ((1, 3, 85), (2, 5, 80)):
        docs = near_corpus(random.Random(seed))
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 as node", "2 as id", "'s' as signature")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(df, shingle=k, percent=percent).collect()}
        assert got == {i: (n, c, c == i) for i, (n, c) in brute.near(docs, k, percent).items()}


def test_near_in_blocks_and_deeper_levels(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 10)
    monkeypatch.setattr(nd, "SMALL", 6)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = {i: " ".join(w if rng.random() > 0.01 else f"x{rng.randrange(900)}" for w in base) for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(df, shingle=3, percent=85).collect()}
    assert got == brute.near(docs, 3, 85)


def test_large_nodes_lose_no_link():
    """The index on prefixes against all pairs: links found span the same components."""
    rng = random.Random(12)
    for percent in (80, 85, 100):
        base = [f"w{i}" for i in range(120)]
        texts = [" ".join(w if rng.random() > rng.choice([0.0, 0.01, 0.03, 0.2]) else f"x{rng.randrange(60)}" for w in base[rng.randrange(20) :]) for _ in range(180)]
        sets = [nd.shingle_set(t, 3) for t in texts]
        members = [(i, i % 2, t, len(s), nd.minwise(s).tolist(), [5]) for i, (t, s) in enumerate(zip(texts, sets))]
        links = {(i, j) for i in range(180) for j in range(i) if nd._linked(sets[i], sets[j], percent)}
        assert brute.components(range(180), nd._spanning_links(5, members, 3, percent, 0, 0)) == brute.components(range(180), links)
        across = [(i, j) for i, j in links if (i - j) % 2]
        assert brute.components(range(180), nd._spanning_links(5, members, 3, percent, 0, 1)) == brute.components(range(180), across)
        of = nd._partners(sets, percent)
        assert all(j in of(i) for i, j in links)


def test_near_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in nd.near_dedup(df).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("3", 2, "1", False), ("4", 0, "4", True), ("None", 2, "None", True)]
    assert nd.near_dedup(df.limit(0)).count() == 0


def test_near_repeated_ids(spark):
    """An id on rows of different texts is one vertex with the links of all of them; every input row comes back once."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = near_corpus(random.Random(4), groups=12)
    rows = [(1000 + i, t) for i, t in docs.items()] + [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, None), (4, b + " end"), (1003, docs[40]), (1003, docs[70]), (None, a), (2, a + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(df, shingle=3, percent=85).collect())
    known = [(i, brute.shingles(t, 3)) for i, t in rows if i is not None]
    links = [(i, j) for i, x in known for j, y in known if i < j and x and y and 100 * len(x & y) >= 85 * len(x | y)]
    root = brute.components({i for i, _ in known}, links)
    assert got == Counter((i, len(brute.shingles(t, 3)), root.get(i), i is None or root[i] == i) for i, t in rows)
    assert {root[i] for i in (1, 2, 3, 4)} == {1}


def test_near_recall_where_nodes_branch_to_the_last_level(spark, monkeypatch):
    """Isolated pairs just above the threshold, all nodes branching on as if they were large."""
    monkeypatch.setattr(nd, "SMALL", 1)
    rng = random.Random(8)
    docs = {}
    for g in range(400):
        base = [f"g{g}w{i}" for i in range(202)]
        near = base[:]
        for at in rng.sample(range(3, 199, 6), 5):  # five changes of three shingles each: 185 of 215 shared
            near[at] = "x"
        docs |= {2 * g: " ".join(base), 2 * g + 1: " ".join(near)}
    want = brute.near(docs, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), shingle=3, percent=85).collect()}
    linked = [i for i, (_, c) in want.items() if c != i]
    assert len(linked) == 400 and sum(got[i] == want[i] for i in linked) >= 398


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PER_PIVOT", 30)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        centre = rng.normal(size=8) if i % 3 == 0 else centre
        v = centre + rng.normal(size=8) * 0.12
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i // 3 % 2)))
    rows += [(300, rows[5][1], rows[5][2]), (301, rows[5][1], 1 - rows[5][2]), (302, [0.0] * 8, 0), (303, None, 0), (304, [1.0] * 7 + [float("nan")], 0), (305, [1.0] * 7 + [None], 0), (306, rows[5][1], None), (307, [], 0), (308, [x * 1e30 for x in rows[5][1]], rows[5][2]), (309, [3.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cell", "2 as rep", "3 as n")
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for a in range(len(good)):
        for b in range(a):
            x, y = (np.array(good[k][1], dtype=np.float32).astype(float) for k in (a, b))
            if good[a][2] == good[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links.append((good[a][0], good[b][0]))
    want = brute.components([r[0] for r in rows], links)
    counts = {r[0]: sum(r[0] in x for x in links) for r in rows}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(df).collect()}
    assert got == {i: (counts[i], want[i], want[i] == i) for i in want}
    assert len(links) > 50
    assert metric_join.near_vectors(df.limit(0)).count() == 0


def test_vectors_repeated_ids(spark):
    """One row for each input row; an id on rows of different vectors ties their components together."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [1.0, 1.0], 0), (4, [1.0, 1.0], 0), (5, [0.0, -1.0], 1), (1, None, 0), (None, [1.0, 0.0], 0), (6, [2.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(df).collect()), key=str)
    want = [(1, 2, 1), (1, 1, 1), (2, 2, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4), (5, 0, 5), (6, 2, 1)]
    assert got == sorted([(False, i, n, c, i == c) for i, n, c in want] + [(False, 1, 0, 1, True), (True, 0, 0, None, True)], key=str)


def plain_mix(rows, block):
    """taken of each row of (id, words, source), by walking the schedule slot by slot in exact numbers."""
    import math
    from fractions import Fraction

    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[1] for r in rows if r[2] == s) for s in names}
    weight, total, target, open_ = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(size.values()), {}, list(names)
    while True:  # sources above three times their size stop there, the rest is shared anew
        left = Fraction(total - sum(3 * size[s] for s in target))
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not full:
            break
        target |= {s: 3 * size[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    target |= {s: level * weight[s] for s in open_}
    blocks = {s: -(-size[s] // block) for s in names}
    edges, at = [], Fraction(0)
    for s in names:
        if size[s]:
            edges.append((at, at + target[s] * blocks[s] / size[s], s))
            at = edges[-1][1]
    rank, got, streams = Counter(), Counter(), {}
    for i, r in sorted(enumerate(rows), key=lambda x: (hashlib.md5(("" if x[1][0] is None else str(x[1][0])).encode()).hexdigest(), x[1][0] or 0, x[1][1])):
        streams.setdefault(r[2], []).extend([i] * r[1])
    for slot in range(math.ceil(round(at, 3))):
        point = Fraction((slot * 0x9E3779B97F4A7C15 % 2**64) >> 11, 2**53) * at
        for low, high, s in edges:
            if low <= point < high:
                k, rank[s] = rank[s], rank[s] + 1
                if k < 3 * blocks[s]:
                    got.update(streams[s][k % blocks[s] * block : (k % blocks[s] + 1) * block])
    return target, [got[i] for i in range(len(rows))]


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 90))), "big" if i % 3 else f"s{i % 7}") for i in range(400)] + [(900, "a b c", None), (901, None, "s0"), (None, "q r", "s1"), (5, "t u v", "s1"), (5, "t u v", "s1"), (903, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as slot", "2 as start", "3 as size")
    for block in (1, 4, 16):
        got = mix_sources(df, block=block).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
        target, taken = plain_mix([(i, len((t or "").split()), s) for i, t, s in rows], block)
        assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(i), len((t or "").split()), n) for (i, t, _), n in zip(rows, taken))
        assert sorted({round(r.target, 3) for r in got}) == sorted({round(float(t), 3) for t in target.values()})
        by = {}
        for r in got:
            by.setdefault((r.source_size, r.target), []).append(r.taken)
        assert all(abs(sum(ts) - t) <= 6 * block for (_, t), ts in by.items())
    again = mix_sources(df.repartition(7), block=16).collect()
    key = lambda r: (str(r.doc_id), r.size, r.source_size, r.target, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mix_sources(df.limit(0)).count() == 0
    assert [r.taken for r in mix_sources(df.where("source = 'empty'")).collect()] == [0]


def test_mix_with_many_sources(spark, monkeypatch):
    """The schedule is the same when slots are shuffled to the map of points, as they are beyond FEW_SOURCES."""
    targets = spark.createDataFrame([(f"s{i}", 40 + i, 1, 40.0 + i) for i in range(30)], "source string, source_size long, weight long, target double")
    few = sorted(schedule(targets, 3).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10)
    assert sorted(schedule(targets, 3).collect()) == few and len(few) > 500


def test_mix_schedule_is_even(spark):
    rows = [(i, "w " * 64, f"s{i % 3}") for i in range(300)]
    _, targets, mixed = mix_pieces(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=64)
    slots = [(r.slot, r.source) for r in mixed.collect()]
    share = {r.source: r.target for r in targets.collect()}
    whole = sum(share.values())
    for cut in (50, 100, 200):
        for source, target in share.items():
            seen = sum(1 for s, x in slots if s < cut and x == source)
            assert abs(seen - cut * target / whole) <= 6


def test_mix_far_slots(spark):
    """Slot numbers above 2^33 and 3.5e9 * GOLDEN neither overflow nor repeat earlier points, and stay even."""
    targets = spark.createDataFrame([("a", 1000, 1, 400.0), ("b", 1000, 2, 800.0), (None, 500, 3, 1200.0)], "source string, source_size long, weight long, target double")
    for first in (0, 3_500_000_000, (1 << 33) + 7, 10**15):
        counts = Counter(r.source for r in schedule(targets, 1, first_slot=first).collect())
        assert all(abs(counts[s] - n) <= 4 for s, n in (("a", 400), ("b", 800), (None, 1200)))
    points = [spark.range(1).select(golden_point(F.lit(s).cast("long")).alias("p")).first().p for s in (5, 5 + (1 << 32), 5 + (1 << 40))]
    assert len(set(points)) == 3 and points == [((s * 0x9E3779B97F4A7C15 % 2**64) >> 11) / 2**53 for s in (5, 5 + (1 << 32), 5 + (1 << 40))]
