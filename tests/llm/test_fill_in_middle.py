import hashlib
import re

from pyspark.sql import functions as F

from driftline.llm.fill_in_middle import MiddleSettings, fill_in_middle, restored

TEXTS = [None, "", "a", "one two\nthree", "has <S> inside", "<P", "ends with <P", "héé漢字 ABC\r\n\x00z", "<<S", "M>x<M", "it's", "word " * 5_000, "   ", "same", "same"]


def plain(doc_id, text):
    """The contract by plain loops."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    if h4 % 100 < 20:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def test_matches_plain_loops_and_restores(spark):
    rows = [(i, t) for i in range(40) for t in TEXTS] + [(None, "no id"), (-7, "negative id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as form", "1 as batch", "2 as id")
    made = fill_in_middle(docs)
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for (key, text), r in zip(rows, got):
        assert (r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == (key, *plain(key, text))
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.back == (text or "")
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_slices_and_marks(spark, monkeypatch):
    monkeypatch.setattr("driftline.llm.fill_in_middle.BATCH_BYTES", 10)
    own = MiddleSettings(seed="it's", transformed=100, suffix_first=50, prefix_mark="[pre]", suffix_mark="[suf]", middle_mark="[mid]")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string")
    got = fill_in_middle(docs, own).withColumn("back", restored(F.col("output"), F.col("form"), own)).collect()
    assert [r.back for r in got] == [t or "" for t in TEXTS * 3]
    assert {r.form for r in got if TEXTS[r.doc_id % len(TEXTS)]} == {"psm", "spm"}
