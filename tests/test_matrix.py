"""The matrix on arrays against the one of Spark's windows, and its kernel on odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitlark.functions.windows import ArrayOps, places, whole_tickers
from pitlark.operators import catalog as C
from pitlark.operators import features as X
from pitlark.operators import matrix as M
from pitlark.plans import queries as Q

SF = "/root/testdata/sf0.01"


def same(a, b, places_=10):
    a, b = (x.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) > 0 and (a[["ticker", "date"]] == b[["ticker", "date"]]).all(axis=None)
    for c in a.columns.drop(["ticker", "date"]):
        np.testing.assert_allclose(b[c].astype(float), a[c].astype(float), rtol=0, atol=10.0**-places_ * max(1.0, np.nanmax(np.abs(a[c].astype(float)))), err_msg=c)


def test_matrix_is_that_of_windows(spark):
    columns = ["ticker", "date", "fwd_ret_5d", "target_class_5d", "label_valid_5d", *M.MORE, *X.BASELINE_NAMES]
    some = F.col("ticker").isin("S00003", "S00042", "S00077")
    windows = X.baseline(Q._labelled(spark, SF), keep_invalid=True).where(some).select(columns)
    rows = M.by_dates(M.panel(M.lines_by_ticker(spark, SF), more=True))
    same(windows, M.features(rows, X.BASELINE_NAMES, keep_invalid=True, also=("label_valid_5d", *M.MORE)).where(some).select(columns))
    day = rows.where("label_valid_5d").agg(F.max("date").alias("date"))
    few = M.features(rows, ["rank_rsi_14", "rsi_14"], only=day).collect()
    assert len({r["date"] for r in few}) == 1 and len(few) == rows.where("label_valid_5d").join(day, "date").count()


def test_no_null_count_computes_windows_in_spark(spark):
    """The sums of 252 rows for every row took 62 s on sf0.1 (now 25 s)."""
    plan = Q.feature_null_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan


def test_kernel_against_plain_windows():
    rng = np.random.default_rng(5)
    x, size = rng.normal(size=90) + 1e6, [1, 40, 3, 46]
    x[7:30] = 5.0  # does not vary
    x[60] = np.nan
    first = np.zeros(90, bool)
    first[np.cumsum([0, *size[:-1]])] = True
    place = places(first)
    left = np.repeat(size, size) - 1 - place
    ops = ArrayOps({"x": x}, place, left)
    for w in (1, 2, 5, 14, 20, 30):
        for f, plain in (("rmean", np.mean), ("rstd", np.std), ("rmax", np.max), ("rmin", np.min), ("rmedian", np.median), ("rsum", np.sum)):
            want = [plain(x[i + 1 - w : i + 1]) if place[i] >= w - 1 else np.nan for i in range(90)]
            np.testing.assert_allclose(getattr(ops, f)("x", w), want, rtol=1e-12, atol=1e-9, err_msg=f"{f} {w}")
    assert np.isnan(ops.zscore("x", 5)[12:30]).all() and ops.lead("x", 2)[38] == x[40] and np.isnan(ops.lead("x", 2)[39])
    assert [v for v in ops.lag("x", 1)[[0, 1, 41, 42]] if v == v] == [x[41]]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 20])
def test_tickers_stay_whole(width):
    names = ["a"] * 1 + ["b"] * 9 + ["c"] * 3 + ["d"] + ["e"] * 6
    batches = [pa.record_batch([pa.array(names[i : i + width]), pa.array(range(i, min(20, i + width)))], ["ticker", "n"]) for i in range(0, 20, width)]
    tables = list(whole_tickers(iter(batches)))
    assert [n for t in tables for n in t.column("n").to_pylist()] == list(range(20))
    own = [set(t.column("ticker").to_pylist()) for t in tables]
    assert sum(map(len, own)) == len(set().union(*own)) == 5
    assert C.BASELINE_RANKS and list(whole_tickers(iter([]))) == []


def test_pooled_ranks_with_heavy_values_and_many_cells(spark, monkeypatch):
    """Cells of one value, rows without a target, infinite values and packing against pandas."""
    import pandas as pd

    from pitlark.functions.arrays import packed, unpacked
    from pitlark.operators import ranks as N

    monkeypatch.setattr(N, "TARGET_ROWS", 40)
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    monkeypatch.setattr(N, "TOGETHER", 2)
    rng = np.random.default_rng(3)
    n = 2000
    y = np.where(rng.random(n) < 0.4, 0.25, rng.normal(size=n).round(2))
    y[rng.random(n) < 0.1] = np.nan
    data = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=50).repeat(40).date, "fwd_ret_5d": y, "a": rng.normal(size=n) + np.nan_to_num(y), "b": np.where(rng.random(n) < 0.5, 1.0, rng.normal(size=n)), "c": rng.integers(0, 3, n) * 1e11})
    data.loc[rng.random(n) < 0.2, "a"] = np.nan
    days = sorted(set(data["date"]))
    folds = spark.createDataFrame([(1, days[0], days[29]), (2, days[10], days[44])], "fold_id int, train_start_date date, train_end_date date")
    cell = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in data.itertuples(index=False)], "date date, fwd_ret_5d double, a double, b double, c double")
    got = {(r["fold_id"], r["feature"]): r["fold_rank_ic"] for r in N.fold_correlations(cell.repartition(4), folds, ["a", "b", "c"]).collect()}
    for fold, lo, hi in ((1, 0, 29), (2, 10, 44)):
        mine = data[(data["date"] >= days[lo]) & (data["date"] <= days[hi])]
        for f in "abc":
            want = mine[f].round(9).rank().corr(mine["fwd_ret_5d"].round(9).rank())
            assert abs(got[fold, f] - want) < 1e-10, (fold, f)
    cuts = N.apart(np.repeat([1.0, 2.0, 3.0], [2, 60, 2]), 20)
    assert N.alone(cuts)[np.searchsorted(cuts, 2.0)] and not N.alone(cuts)[np.searchsorted(cuts, 3.0)]
    for x in (np.array([0.1, np.nan, -2.5, 1e-9]), np.array([np.inf, 1e12 / 3, np.nan])):
        np.testing.assert_array_equal(unpacked(packed(x), len(x)), np.round(x, 9))
