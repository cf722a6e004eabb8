"""The research engine on small panels: exact values, no look-ahead, and agreement with DuckDB."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest

from pitlark.operators import ablation as L
from pitlark.operators import evaluation as E
from pitlark.operators import features as X
from pitlark.operators import panel as P
from pitlark.operators import walkforward as W
from pitlark.plans import queries as K
from pitlark.sources import bars as B

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem"]


def panel(spark, n=40, tickers=("A", "B"), bump=0.0, at=10**9):
    day = dt.date(2000, 1, 3)
    rows = [(t, day + dt.timedelta(i), 100.0 + i + k + (bump if i >= at else 0), 101.0 + i + k, 99.0 + i + k, 100.5 + i + k + (bump if i >= at else 0), 1000 + i) for k, t in enumerate(tickers) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long")


def test_no_look_ahead(spark):
    a = X.add_levels(P.gate(panel(spark)), X.C.BASELINE).where("date < '2000-01-23'").orderBy("ticker", "date").toPandas()
    b = X.add_levels(P.gate(panel(spark, bump=50.0, at=20)), X.C.BASELINE).where("date < '2000-01-23'").orderBy("ticker", "date").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_labels(spark):
    cfg = P.PanelConfig(min_history_bars=0, median_dollar_volume_min=0, warmup_start="1990-01-01", research_start="1990-01-01")
    out = P.label(P.universe(P.gate(panel(spark), cfg), cfg), cfg=cfg).where("ticker = 'A'").orderBy("date").toPandas()
    assert out.loc[20, "next_open"] == 121.0 and out.loc[20, "exit_close_5d"] == 125.5 and out["fwd_ret_5d"].isna().sum() == 5
    r = P.label_reasons(P.label(P.universe(P.gate(panel(spark), cfg), cfg), cfg=cfg)).first().asDict()
    assert sum(v for k, v in r.items() if k.startswith("first_")) + r["valid_rows"] == r["total_rows"]


def test_validation(spark):
    row = ["A.US", "D", "20200102", "000000", "1", "2", "0.5", "1.5", "10", "0"]
    put = lambda i, v: [v if k == i else x for k, x in enumerate(row)]
    rows = [(*row, "a"), (*row, "a"), (*put(5, "0.1"), "b"), (*put(1, "X"), "c"), (*put(3, "123000"), "d"), (*put(8, "-1"), "e"), (*put(9, "abc"), "f"), (*put(3, "0"), "g"), (*put(2, "20201399"), "h"), (*put(4, "q"), "i")]
    got = B.validate(spark.createDataFrame(rows, [*B.RAW_COLUMNS, "source_file"]))
    by = {r["source_file"]: r["reasons"] for r in got.collect()}
    assert by == {"a": ["duplicate_ticker_date"], "b": ["bad_ohlc_consistency"], "c": ["bad_per"], "d": ["bad_time"], "e": ["bad_volume_negative"], "f": ["bad_numeric_openint"], "g": [], "h": ["bad_date"], "i": ["bad_numeric_ohlc", "bad_ohlc_consistency"]}
    assert B.valid_bars(got).count() == 1


def test_prune():
    feats = [{"feature": f, "reject_reason": "", "selection_score": s} for f, s in (("a", 3), ("b", 2), ("c", 1), ("d", 0))]
    assert K.D.prune(feats, {frozenset("ab"): 0.99}) == (["a", "c", "d"], {"b"}) and K.D.prune(feats, {frozenset("ac"): 0.99}, 2) == (["a", "b"], set())


def test_long_short_gross(spark):
    rows = [(dt.date(2020, 1, d), f"T{i:02d}", (i - 4.5) / 100, float(i)) for d in (1, 2, 3) for i in range(10)]
    p = E.bucketed(spark.createDataFrame(rows, "date date, ticker string, fwd_ret_5d double, score double"))
    r = E.long_short(p).first()
    assert abs(r["gross"] - 0.045) < 1e-12 and abs(r["net"] - 0.0425) < 1e-12
    assert abs(E.ic_summary(E.rank_ic(p)).first()["mean_ic"] - 1) < 1e-12


def test_fold_geometry(spark):
    days = spark.range(1400).selectExpr("date_add(date'2010-01-01', cast(id as int)) date")
    rows = W.plan(days, W.FoldConfig(1260, 63, 63, 20)).collect()
    assert len(rows) == 1 and (rows[0]["test_start_date"] - dt.date(2010, 1, 1)).days == 1280 and rows[0]["test_rows"] == 63
    assert W.plan(days.limit(1000), W.FoldConfig(1260, 63, 63, 20)).count() == 0


def test_every_sql_is_sql():
    """DuckDB binds each entry to the given tables: names, types and functions are right, whatever the rows."""
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = K.oracle_sql()
    assert set(found) <= set(K.queries()) and len(found) >= 62
    for name, text in found.items():
        try:
            db.execute(f"EXPLAIN {text}")
        except duckdb.Error as error:
            pytest.fail(f"{name}: {error}")


@pytest.mark.parametrize("name", ["bars", "labels", "features_returns", "features_rsi", "fold_plan", "expanded_days_since", "features_long_only", "research_gate", "selection", "discovery_fold_ic"])
def test_agrees_with_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = K.queries()[name](spark, SF).toPandas(), db.sql(K.oracle_sql()[name]).df()
    keys = [k for k in ("fold_id", "ticker", "date", "feature", "control") if k in a]
    for f in (a, b):
        for c in f:
            if "date" in c:
                f[c] = pd.to_datetime(f[c]).astype("datetime64[us]")
    a, b = (f[sorted(a.columns)].sort_values(keys).reset_index(drop=True) for f in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1.1e-6, rtol=0)


def test_ablation_verdicts(spark):
    cols = "model string, net double, avg_candidates double, positive_years int, positive_folds int"
    verdict = lambda *v: L.compared(spark.createDataFrame([("b", 0.1, 20.0, 3, 5), ("v", *v)], cols), "v", "b").where("model = 'v'").first()
    assert verdict(0.1, 10.0, 3, 6)["verdict"] == "continue_review" and verdict(0.05, 20.0, 3, 5)["verdict"] == "reject_variant"
    assert verdict(0.05, 20.0, 3, 6)["verdict"] == "needs_review" and abs(verdict(0.3, 1.0, 3, 6)["net_lead"] - 0.2) < 1e-12
