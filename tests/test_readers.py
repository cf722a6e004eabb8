"""Archives by member, files by chunk, and listings from a server on this machine."""

import datetime as dt
import hashlib
import http.server
import json
import threading
import urllib.parse
import zipfile

import pytest

from pitlark import __main__ as cli
from pitlark.sources import archives as R
from pitlark.sources import readers as D

HEADER = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n"


def test_an_archive_of_many_members_makes_many_tasks(spark, tmp_path):
    path = tmp_path / "deep/a.zip"
    path.parent.mkdir()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(1000):
            z.writestr(f"data/daily/us/s{k:04d}.us.txt", HEADER + f"S{k:04d}.US,D,2020{1 + k % 12:02d}02,000000,1,2,0.5,1.5,10,0\n")
    data = bytearray(path.read_bytes())
    at = data.index(b"S0500.US,D")
    data[at : at + 4] = b"XXXX"  # the member's checksum is wrong now
    path.write_bytes(bytes(data))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    D.register(spark)
    raw = spark.read.format("zip_members").option("members", "100").load(str(tmp_path))
    assert raw.rdd.getNumPartitions() == 11 and raw.count() == 1001
    found = R.inventory(R.read_members(spark, str(tmp_path))).cache()
    rows = {(r["archive"], r["member"]): r for r in found.collect()}
    assert len(rows) == 1001 and rows["b.zip", "b.zip"]["status"] == "FAIL"
    broken = rows["a.zip", "data/daily/us/s0500.us.txt"]
    assert broken["status"] == "FAIL" and "CRC" in broken["failure"] and sum(r["status"] == "FAIL" for r in rows.values()) == 2
    assert rows["a.zip", "data/daily/us/s0000.us.txt"]["archive_sha256"] == hashlib.sha256(bytes(data)).hexdigest()
    whole = R.archive_profile(found).first()
    assert whole["file_type_counts"] == {"daily_ascii": 1000, "unknown": 1} and whole["total_inner_files"] == 1001 and whole["unique_symbols_estimate"] == 1000
    assert whole["daily_schema"]["sample_file"] == "data/daily/us/s0000.us.txt" and whole["daily_schema"]["columns"][:3] == ["ticker", "per", "date"] and whole["hourly_schema"] is None
    assert (whole["earliest"], whole["latest"], whole["metastock_present"], whole["failures"]) == ("20200102", "20201202", False, 2)
    found.unpersist()
    cli.main(["archives", str(tmp_path / "deep"), str(tmp_path / "out")])
    assert json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "out/profile")).collect()))["total_inner_files"] == 1000


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_files_are_read_by_chunks(spark, tmp_path, chunk):
    bodies = {
        "a.txt": HEADER + "A.US,D,20200103,0,1,1,1,1,1,1\nA.US,D,20191231,0,1,1,1,1,1,1\n\nA.US,D,2020130,0,1\nA.US,D,20201399,0,1",
        "b.txt": "X,Y\n1,2\n", "c.txt": "", "d.txt": "<DATE>,<TICKER>\r\n20200105, b.us \r\n", "e.txt": HEADER + "Z" * 5000 + ",D,20200101\n" + "E.US,D,20200102,0\n",
    }
    for name, text in bodies.items():
        (tmp_path / name).write_text(text)
    D.register(spark)
    got = {r["source_file"]: r for r in spark.read.format("file_facts").options(suffix=".txt", chunk=str(chunk)).load(str(tmp_path)).collect()}
    assert {n: r["sha256"] for n, r in got.items()} == {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in bodies}
    assert {n: r["row_count"] for n, r in got.items()} == {"a.txt": 5, "b.txt": 1, "c.txt": 0, "d.txt": 1, "e.txt": 2}
    if chunk > 60:
        assert (got["a.txt"]["first_ticker"], got["a.txt"]["min_date"], got["a.txt"]["max_date"]) == ("A.US", dt.date(2019, 12, 31), dt.date(2020, 1, 3))
        assert got["d.txt"]["first_ticker"] == "B.US" and got["d.txt"]["min_date"] == dt.date(2020, 1, 5) and got["b.txt"]["missing"] == ["ticker", "date"]


def test_memory_does_not_grow_with_the_file():
    """300 MB through a buffer: what is kept besides is a few thousand dates."""
    import tracemalloc

    line = b"A.US,D,20200103,000000,1,2,0.5,1.5,10,0\n"
    chunks = (HEADER.encode() if k == 0 else line * 5_000 for k in range(1_500))
    tracemalloc.start()
    _, rows, ticker, least, most, missing = D.file_facts(chunks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_499 * 5_000 and ticker == "A.US" and least == most == dt.date(2020, 1, 3) and not missing and peak < 8 << 20


LIST = ",".join(D.LISTING_COLUMNS)
SECRET = "k3y-that-no-one-may-see"


@pytest.fixture
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query).items()}
            asked.append(q)
            mode = self.path.split("?")[0].strip("/")
            tries = sum(x["state"] == q["state"] for x in asked)
            code = 500 if (mode == "shaky" and tries < 3) or mode == "down" else 403 if mode == "shut" else 200
            body = '{"Information": "no more calls"}' if mode == "words" else f"﻿{LIST}\nA, Alpha ,NYSE,Stock,2000-01-01,,Active\n,,,,,,\nB,Beta,NYSE,ETF,null,2020-05-05,{'' if q['state'] == 'delisted' else 'Active'}\n"
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked
    made.shutdown()


def test_listings_over_http(spark, tmp_path, server):
    url, asked = server
    key = tmp_path / "key"
    key.write_text(SECRET + "\n")
    how = {"key_file": str(key), "pause": "0", "backoff": "0.05"}
    found = R.fetch_listing(spark, f"{url}/shaky", "2024-01-31", date="2024-01-30", **how)
    assert SECRET not in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert {(r["query_state"], r["symbol"], r["name"], r["source_asof_date"]) for r in rows} == {(s, x, n, "2024-01-31") for s in D.LISTING_STATES for x, n in (("A", "Alpha"), ("B", "Beta"))}
    assert all(q["apikey"] == SECRET and q["date"] == "2024-01-30" and q["function"] == "LISTING_STATUS" for q in asked) and len(asked) == 6
    years = {(r["symbol"], r["query_state"]): (r["ipoDate_year"], r["delistingDate_year"], r["source_asof_date_year"]) for r in R.listing_export(spark.createDataFrame(rows, found.schema)).collect()}
    assert years["A", "active"] == (2000, None, 2024) and years["B", "delisted"] == (None, 2020, 2024)
    counts = {(r["what"], r["value"]): r["rows"] for r in R.listing_counts(spark.createDataFrame([*rows, (*rows[0][:6], None, None, "s", "d")], found.schema)).collect()}
    assert counts == {("status", "Active"): 3, ("status", ""): 1, ("status", None): 1, ("query_state", "active"): 2, ("query_state", "delisted"): 2, ("query_state", None): 1}
    for mode, said, calls in (("down", "HTTP 500", 3), ("shut", "HTTP 403", 1), ("words", "no CSV", 1)):
        asked.clear()
        with pytest.raises(Exception, match=said) as error:
            R.fetch_listing(spark, f"{url}/{mode}", "2024-01-31", states="active", tries="3", **how).collect()
        assert SECRET not in str(error.value) and calls <= len(asked) <= 4 * calls  # a task may be tried again
    with pytest.raises(Exception, match="may not stand"):
        R.fetch_listing(spark, url, "2024-01-31").collect()
    with pytest.raises(Exception, match="state must be"):
        R.fetch_listing(spark, url, "2024-01-31", states="open", **how).collect()
    cli.main(["listing", f"{url}/good", str(tmp_path / "out"), "--asof", "2024-01-31", "--key-file", str(key), "--pause", "0"])
    assert spark.read.parquet(str(tmp_path / "out/listing")).count() == 4
