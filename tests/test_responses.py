"""The source of requests: retries, the cache, pushed filters, fallbacks, and a server that fails at first."""

import datetime
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from driftline.sources import responses as R

DAYS = [datetime.date(y, m, 15) for y in (2001, 2002, 2003) for m in range(1, 13)]
PANEL = [(k, d, float(i), 2.0 * i) for k in ("A", "B", "C") for i, d in enumerate(DAYS)]


@pytest.fixture
def recorded(spark, tmp_path):
    path = str(tmp_path / "recorded")
    R.record_responses(spark.createDataFrame(PANEL, "ticker string, date date, close double, adjusted_close double"), path, failures=2)
    return path


def rows(df):
    return sorted((r.ticker, r.date, r.close, r.adjusted_close) for r in df.collect())


def read(spark, path, **options):
    return R.read_responses(spark, path, ["A", "B", "C", "absent"], (2001, 2003), backoff=0, **options)


def test_retries_until_there_is_an_answer(spark, recorded):
    got = read(spark, recorded, source="vendor")
    assert rows(got) == sorted(PANEL)
    assert {(r.source, r.open, r.vwap) for r in got.collect()} == {("vendor", None, None)}
    assert rows(read(spark, recorded, retries=2)) == []


def test_second_read_asks_for_nothing(spark, recorded, tmp_path):
    cache = str(tmp_path / "cache")
    assert rows(read(spark, recorded, cache=cache)) == sorted(PANEL)
    gone = str(tmp_path / "gone")
    assert rows(read(spark, gone, cache=cache)) == sorted(PANEL)
    assert rows(read(spark, gone, cache=cache, use="cache_only")) == sorted(PANEL)
    assert rows(read(spark, gone, cache=cache, use="refresh")) == sorted(PANEL)
    assert rows(read(spark, gone)) == []
    assert not [p for p in Path(cache).rglob("*") if p.is_file() and p.suffix not in (".parquet", ".crc")]


def test_refresh_overwrites_the_cache(spark, recorded, tmp_path):
    cache, later = str(tmp_path / "cache"), str(tmp_path / "later")
    read(spark, recorded, cache=cache).count()
    R.record_responses(spark.createDataFrame([("A", DAYS[0], -1.0, -1.0)], "ticker string, date date, close double, adjusted_close double"), later)
    assert ("A", DAYS[0], -1.0, -1.0) not in rows(read(spark, later, cache=cache))
    want = [("A", DAYS[0], -1.0, -1.0), *[r for r in PANEL if not (r[0] == "A" and r[1].year == 2001)]]
    assert rows(read(spark, later, cache=cache, use="refresh")) == sorted(want)
    assert rows(read(spark, later, cache=cache, use="cache_only")) == sorted(want)


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        key, year = self.path.strip("/").split("/")
        self.server.asked[key, year] += 1
        fails = key == "B" and self.server.asked[key, year] == 1
        bars = [{"date": str(d), "close": c} for k, d, c, _ in PANEL if k == key and d.year == int(year)]
        self.send_response(503 if fails else 200)
        self.end_headers()
        if not fails:
            self.wfile.write(json.dumps({"historical": bars}).encode())

    def log_message(self, *_):
        pass


def test_pushed_filters_bound_the_requests_to_a_server(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.asked = Counter()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/{{key}}/{{start:%Y}}"
        cache = str(tmp_path / "cache")
        some = lambda: read(spark, url, cache=cache, fill_adjusted=True).where("ticker in ('A', 'B') and date >= date'2002-06-01' and date < date'2003-02-01'")
        want = sorted((k, d, c, c) for k, d, c, _ in PANEL if k in "AB" and datetime.date(2002, 6, 1) <= d < datetime.date(2003, 2, 1))
        assert rows(some()) == want
        assert server.asked == {("A", "2002"): 1, ("A", "2003"): 1, ("B", "2002"): 2, ("B", "2003"): 2}
        assert rows(some()) == want and sum(server.asked.values()) == 6
        assert rows(read(spark, url).where("ticker = 'A' and date = date'2001-01-15'")) == [("A", DAYS[0], 0.0, None)]
        assert read(spark, url).where("date < date'1990-01-01'").count() == 0 and sum(server.asked.values()) == 7
    finally:
        server.shutdown()
    assert rows(read(spark, url, retries=1).where("ticker = 'A'")) == []


def test_chain_of_fallbacks_and_bad_settings(spark, recorded, tmp_path):
    nothing, own = read(spark, str(tmp_path / "none")), read(spark, recorded)
    assert rows(R.first_with_rows([nothing, own, nothing])) == sorted(PANEL)
    assert rows(R.first_with_rows([nothing, nothing])) == []
    with pytest.raises(Exception, match="cache_only"):
        read(spark, recorded, use="cache_only").count()
