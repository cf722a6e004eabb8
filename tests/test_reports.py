"""Sources, sinks, imports, audits and reports on small inputs."""

import datetime as dt
import json
import zipfile

import numpy as np
import pandas as pd
import pytest

from pitlark import __main__ as cli
from pitlark.operators import audits as A
from pitlark.operators import discovery as D
from pitlark.operators import evaluation as E
from pitlark.operators import options as O
from pitlark.sources import archives as R
from pitlark.sources import bars as B
from pitlark.sources import store as S

HEADER = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n"


def bar(day, per="D", ticker="AAA.US", time="000000"):
    return f"{ticker},{per},{day},{time},1,2,0.5,1.5,10,0\n"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/daily/us/aaa.us.txt", HEADER + bar(20200102) + bar(20200103))
        z.writestr("data/hourly/us/aaa.us.txt", HEADER + bar(20200102, "60"))
        z.writestr("data/daily/us/empty.us.txt", "")
        z.writestr("data/daily/us/bin.us.txt", b"\xff\xfe\x00\x81" * 9)
        for name, content in (("m/MASTER", "x"), ("m/EMASTER", "x"), ("m/F1.DOP", '"DATE",i\n"CLOSE",f\n'), ("m/F1/DAT", "x"), ("m/readme", "x")):
            z.writestr(name, content)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = {(r["archive"], r["member"]): r for r in R.inventory(R.read_members(spark, str(tmp_path))).collect()}
    r = got["a.zip", "data/daily/us/aaa.us.txt"]
    assert (r["kind"], r["symbol"], r["delimiter"], r["rows"], r["first_date"], r["last_date"], r["period"], r["status"]) == ("daily_ascii", "AAA.US", ",", 2, "20200102", "20200103", "daily", "PASS")
    assert r["columns"] == ["ticker", "per", "date", "time", "open", "high", "low", "close", "vol", "openint"]
    assert got["a.zip", "data/hourly/us/aaa.us.txt"]["period"] == "hourly" and got["a.zip", "m/F1.DOP"]["columns"] == ["DATE", "CLOSE"]
    assert got["a.zip", "data/daily/us/empty.us.txt"]["warnings"] == ["empty_file"] and got["a.zip", "data/daily/us/bin.us.txt"]["warnings"] == ["binary_file_skipped"]
    assert [got["a.zip", f"m/{m}"]["kind"] for m in ("MASTER", "EMASTER", "F1/DAT", "readme")] == ["metastock_master", "metastock_emaster", "metastock_data", "unknown"]
    assert got["b.zip", "b.zip"]["status"] == "FAIL"
    profile = {(r["archive"], r["kind"]): r for r in R.schema_profile(R.inventory(R.read_members(spark, str(tmp_path)))).collect()}
    assert profile["a.zip", "daily_ascii"]["members"] == 3 and profile["a.zip", "daily_ascii"]["last_date"] == "20200103"


def test_manifest_export_and_commands(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "aaa.us.txt").write_text(HEADER + bar(20200102) + bar(20210104) + bar(20210105, "X"))
    (raw / "odd.txt").write_text("A,B\n1,2\n")
    got = {r["source_file"]: r for r in R.file_manifest(spark, str(raw)).collect()}
    r = got["aaa.us.txt"]
    assert (r["ticker"], r["raw_ticker"], r["row_count"], r["min_date"], r["max_date"], r["parse_status"]) == ("AAA", "AAA.US", 3, dt.date(2020, 1, 2), dt.date(2021, 1, 5), "ok")
    assert got["odd.txt"]["parse_status"] == "error" and got["odd.txt"]["error_message"] == "missing columns: ticker, date" and got["odd.txt"]["ticker"] == "ODD" and len(r["sha256"]) == 64
    (raw / "odd.txt").unlink()
    assert {r["market_year"] for r in R.strict_export(B.read_raw(spark, str(raw))).collect()} == {"US-2020", "US-2021"}
    out = tmp_path / "out"
    cli.main(["validate", str(raw), str(out)])
    assert spark.read.parquet(f"{out}/bars").count() == 2 and {p.name for p in (out / "bars").glob("year=*")} == {"year=2020", "year=2021"}
    cli.main(["export", str(raw), str(out)])
    assert {p.name for p in (out / "tickers").glob("ticker_path=*")} == {"ticker_path=AAA"}
    assert {r["size_bytes"]: r["sha256"] for r in S.provenance(spark, str(raw), 10).collect()} == {(raw / "aaa.us.txt").stat().st_size: None}


def test_guard_json_and_empty(spark, tmp_path):
    assert S.guard(f"{tmp_path}/a", str(tmp_path))
    for bad in (str(tmp_path), f"{tmp_path}/../x", f"{tmp_path}/raw_txt/a"):
        with pytest.raises(ValueError):
            S.guard(bad, str(tmp_path))
    S.write_json(spark, {"a": float("nan"), "d": dt.date(2020, 1, 2)}, str(tmp_path / "j"))
    assert json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "j"), wholetext=True).collect())) == {"a": None, "d": "2020-01-02"}
    assert S.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    assert "| 1 |" in S.markdown("t", {}, {"x": spark.createDataFrame([(1,)], "a int")})


def test_listing(spark, tmp_path):
    (tmp_path / "l.csv").write_text(",".join(R.LISTING_COLUMNS) + "\nA,Alpha,NYSE,Stock,2000-01-01,,Active\n,,,,,,\n")
    rows = R.read_listing(spark, str(tmp_path / "l.csv"), "active", "2020-01-01").collect()
    assert len(rows) == 1 and rows[0]["delistingDate"] == "" and rows[0]["query_state"] == "active"


def chain(file="f1", **changed):
    row = {"file_path": file, "snapshot_date": "2020-01-02", "underlying_ticker": "aaa", "option_symbol": "O1", "expiration": "2020-01-20", "strike": "10", "call_put": "put", "bid": "2", "ask": "4", "data_source": "s", "volume": "", "snapshot_timestamp": "2020-01-02 15:30:00"}
    return row | changed


def test_options(spark):
    rows = [chain(), chain("f2", bid="5"), chain("f3", underlying_ticker="BBB"), chain("f4", expiration="x"), chain("f5"), chain("f5"), chain("f6"), chain("f8", strike="-1")]
    raw = spark.createDataFrame(pd.DataFrame(rows))
    told = [(f"f{i}", "aaa", "2020-01-02", "15:30" if i == 1 else "09:00" if i == 6 else "", "s", "") for i in range(1, 9)]
    good, files = O.import_batch(raw, spark.createDataFrame(told, O.MANIFEST))
    got = {r["file_path"]: r["reasons"] for r in files.collect()}
    assert got == {"f1": [], "f2": ["crossed"], "f3": ["underlying_mismatch"], "f4": ["null_core"], "f5": ["duplicate"], "f6": ["time_mismatch"], "f7": ["no_rows"], "f8": ["negative"]}
    told = O.batch_summary(good, files).first()
    assert (told["files"], told["ok_files"], told["failed_files"], told["rows"], told["missing_volume"]) == (8, 1, 7, 1, 1)
    r = good.first()
    assert good.count() == 1 and (r["mid"], r["DTE"], r["call_put"], r["underlying_ticker"], r["volume"]) == (3.0, 18.0, "P", "AAA", None)
    template = spark.createDataFrame([("2020-01-02", "15:30:00", "AAA", "2020-01-20", "CALL", "10", "1", "2", "s")], ["snapshot_date", "snapshot_time", "underlying", "expiration", "option_type", "strike", "bid", "ask", "source"])
    t = O.checked(O.normalize(template)).first()
    assert t["snapshot_timestamp"] == dt.datetime(2020, 1, 2, 15, 30) and t["option_symbol"] == "AAA_2020-01-20_CALL_10"
    with pytest.raises(ValueError):
        O.checked(O.normalize(raw))


def test_audits(spark):
    row = ["P1", "A.US", "A", "stock", "2000-01-01", "", "2000-01-01", "", "X", "no", "yes", "0", "n", "false", "s", "2020-01-01"]
    put = lambda **v: tuple(v.get(c, x) for c, x in zip(A.MASTER_COLUMNS, row))
    r = A.audit_master(spark.createDataFrame([put(), put(permanent_id="P2", listing_date="x", is_otc="?"), put(permanent_id="P3", delisting_date="1999-01-01"), put(permanent_id="")], A.MASTER_COLUMNS)).first().asDict()
    assert A.audit_blockers(r) == ["empty_required_values", "invalid_boolean_values", "invalid_date_values", "reversed_date_intervals"] and r["delisted_rows"] == 1 and r["duplicate_identity"] == 0
    r = A.audit_master(spark.createDataFrame([put(), put()], A.MASTER_COLUMNS).drop("exchange")).first().asDict()
    assert A.audit_blockers(r) == ["duplicate_identity_rows", "missing_required_columns"]
    e = spark.createDataFrame([("A", "A", "", "rights", "s", "2020-01-01", "0", "-1")], [*A.EVENT_COLUMNS, "split_ratio", "cash_amount"])
    assert A.audit_blockers(A.audit_events(e).first().asDict()) == ["empty_required_values", "invalid_date_values", "invalid_numeric_values", "unsupported_action_types"]
    assert A.audit_policy({f: "x" for f in A.POLICY_FIELDS}) == ["invalid_date:source_asof_date"] and len(A.audit_policy({})) == len(A.POLICY_FIELDS)


def test_controls(spark):
    rng = np.random.default_rng(7)
    rows = [(1, dt.date(2020, 1, d), f"T{i:02d}", float(rng.normal()), float(i)) for d in (1, 2, 3, 6) for i in range(12)]
    got = {r["control"]: r for r in E.metrics(E.control_scores(spark.createDataFrame(rows, "fold_id int, date date, ticker string, fwd_ret_5d double, score double")), "control", top=5).collect()}
    assert set(got) == {"active", "random_101", "random_202", "constant", "lagged"} and got["lagged"]["missing_rows"] == 12
    assert got["constant"]["mean_ic"] is None and got["active"]["top_turnover"] == 0 and got["active"]["top_days"] == 4
