import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm.chat_format import CONTROLS, Budget, digest_windows, escape, format_chats, read_back, unescape

pieces = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "|", "a", " ", "\n", "é", "<|", "[/"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_escape_is_reversible_and_breaks_controls(text):
    escaped = escape(text)
    assert unescape(escaped) == text
    assert not any(c in escaped for c in CONTROLS)


def brute(turns):
    want = {}
    for conv, turn, role, text in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, rows in want.items():
        spoken = "".join(t for r, t in rows if r == "assistant")
        out[conv] = (
            len(rows),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(),
            len(spoken),
            hashlib.sha256(spoken.encode()).hexdigest(),
        )
    return out


def test_windows_read_back(spark):
    turns = [(c, t, ("system" if t == 0 and c % 2 else "user" if t % 2 == 0 else "assistant"), f"word{t} " * (7 * t * (c + 1) % 23)) for c in range(9) for t in range(c * 3 + 1)]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, None, None), (50, None, "assistant", "x"), (50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (51, 0, "<|end|>", "<|text|>\\"), (52, 0, "assistant", "long " * 5000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as loss_spans")
    windows = format_chats(df, Budget(window=40, history=15))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest_windows(windows).collect()}
    assert got == brute(turns)
    for r in windows.collect():
        said = read_back(r.text)
        cost = sum(len(t.split()) + 3 for _, t, _, _ in said)
        assert cost <= 40 or (len(said) - r.repeated == 1 and r.repeated == (said[0][0] == "system" and r.window > 0))
    first = {r.conv_id: r.text for r in windows.where("window = 0").collect()}
    for r in windows.where("window > 0 and conv_id in (1, 3, 5, 7)").collect():
        assert read_back(r.text)[0][:2] == read_back(first[r.conv_id])[0][:2]
    assert digest_windows(format_chats(df.limit(0))).count() == 0


def test_late_system_turn_and_history(spark):
    """A system turn that is not first is retained from there on; history is the longest run of latest turns that fits."""
    words = lambda n: " ".join(["w"] * n)
    turns = [(1, 0, "user", words(10)), (1, 1, "system", "be brief"), (1, 2, "assistant", words(20))] + [(1, t, "user" if t % 2 else "assistant", f"{t} {words(t % 5)}") for t in range(3, 400)]
    windows = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), Budget(window=60, history=20)).orderBy("window").collect()
    assert len(windows) > 30
    told = [[t[:2] for t in read_back(w.text)] for w in windows]
    at = 0
    for w, said in zip(windows, told):
        new = said[w.repeated :]
        assert new == [(r, x) for _, _, r, x in turns[at : at + len(new)]]
        if at > 2:
            past = [(r, x) for _, _, r, x in turns[:at] if r != "system"]
            keep = next(k for k in range(len(past) + 1) if sum(len(x.split()) + 3 for _, x in past[k:]) <= 20)
            assert said[: w.repeated] == [("system", "be brief"), *past[keep:]]
        at += len(new)
    assert at == len(turns)


def test_history_leaves_room_for_the_first_new_turn(spark):
    """Without history the turn fits; history that fits its own allowance must go. A shorter run of it stays where there is room."""
    words = lambda n: " ".join(["w"] * (n - 3))
    turns = [(1, 0, "system", words(100)), (1, 1, "user", words(600)), (1, 2, "assistant", words(253)), (1, 3, "user", words(793)), (1, 4, "assistant", words(40))]
    turns += [(2, 0, "system", words(100)), (2, 1, "user", words(700)), (2, 2, "assistant", words(150)), (2, 3, "user", words(60)), (2, 4, "assistant", words(800)), (2, 5, "user", words(2000))]
    windows = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "window").collect()
    cost = lambda w: sum(len(t.split()) + 3 for _, t, _, _ in read_back(w.text))
    assert [(w.conv_id, w.repeated, cost(w)) for w in windows] == [(1, 0, 953), (1, 1, 933), (2, 0, 1010), (2, 2, 960), (2, 1, 2100)]
