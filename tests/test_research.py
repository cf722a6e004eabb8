"""Ridge against numpy, discovery and selection against brute force, signals, raw files, gate and plan checks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitlark.operators import discovery as D
from pitlark.operators import evaluation as E
from pitlark.operators import moments as M
from pitlark.operators import ranks as N
from pitlark.operators import rules as R
from pitlark.operators import walkforward as W
from pitlark.sources import bars as B
from pitlark.sources import store as S


@pytest.fixture(scope="module")
def frame():
    """60 dates of 12 names; f1 with gaps, f2 with ties, f3 constant, f4 all gaps."""
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2020-01-01", periods=60)
    rows = [(d.date(), f"T{t:02d}", rng.normal(), int(rng.integers(-1, 2)), None if rng.random() < 0.2 else rng.normal(), float(rng.integers(0, 4)), 1.5, None, True, True) for d in days for t in range(12)]
    return pd.DataFrame(rows, columns=["date", "ticker", "fwd_ret_5d", "target_class_5d", "f1", "f2", "f3", "f4", "label_valid_5d", "model_eligible"])


SCHEMA = "date date, ticker string, fwd_ret_5d double, target_class_5d int, f1 double, f2 double, f3 double, f4 double, label_valid_5d boolean, model_eligible boolean"
FEATURES = ["f1", "f2", "f3", "f4"]


def _table(spark, frame):
    return spark.createDataFrame([tuple(None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else v for v in r) for r in frame.itertuples(index=False)], SCHEMA)


def _ridge(train, test, alpha=1.0):
    x, z = (f[FEATURES].astype(float).copy() for f in (train, test))
    med = x.median().fillna(0)
    x, z = x.fillna(med), z.fillna(med)
    mean, sd = x.mean(), x.std(ddof=0)
    sd = sd.where(sd > 1e-12, 1.0)
    a, y = ((x - mean) / sd).to_numpy(), train["target_class_5d"].to_numpy(float)
    w = np.linalg.solve(a.T @ a + alpha * np.eye(len(FEATURES)), a.T @ (y - y.mean()))
    return y.mean() + ((z - mean) / sd).to_numpy() @ w


def test_ridge_against_numpy(spark, frame):
    matrix = _table(spark, frame)
    folds = W.plan(matrix, W.FoldConfig(20, 8, 8, 2))
    out = W.ridge_predictions(matrix, folds, FEATURES).toPandas()
    plan = folds.toPandas()
    assert len(plan) == 4 and out["fold_id"].nunique() == 4
    for r in plan.itertuples():
        train = frame[(frame["date"] >= r.train_start_date) & (frame["date"] <= r.train_end_date)]
        test = frame[(frame["date"] >= r.test_start_date) & (frame["date"] <= r.test_end_date)].copy()
        test["want"] = _ridge(train, test)
        got = out[out["fold_id"] == r.fold_id].merge(test, on=["date", "ticker"])
        assert len(got) == len(test) == 96 and np.allclose(got["score"], got["want"], atol=1e-9)
        assert (got.groupby("date")["long_rank"].min() == 1).all() and (got.groupby("date")["short_rank"].max() == 12).all()


def test_ridge_survives_large_means_and_dependent_features(spark):
    """A feature of mean 1e9 and deviation 1, with gaps, against QR on the centred values; and columns that differ in the sixth digit without
    a penalty, where the normal equations have few digits left."""
    rng = np.random.default_rng(8)
    days = pd.bdate_range("2020-01-01", periods=50)
    rows = []
    for k, d in enumerate(days):
        for t in range(10):
            z = rng.normal()
            rows.append((d.date(), f"T{t}", 0.0, int(rng.integers(-1, 2)), None if rng.random() < 0.1 else 1e9 + z + k / 10, rng.normal() * 1e-3, -5e6 + rng.normal(), z + 1e-7 * rng.normal()))
    data = pd.DataFrame(rows, columns=["date", "ticker", "fwd_ret_5d", "target_class_5d", "f1", "f2", "f3", "f4"])
    matrix = spark.createDataFrame(rows, "date date, ticker string, fwd_ret_5d double, target_class_5d int, f1 double, f2 double, f3 double, f4 double")
    matrix = matrix.withColumn("f5", F.col("f4") + F.col("f2") * 1e-3)
    data["f5"] = data["f4"] + data["f2"] * 1e-3
    folds = W.plan(matrix, W.FoldConfig(20, 8, 8, 2))
    for features, alpha, most in ((["f1", "f2", "f3", "f4"], 1.0, 1e-8), (["f3", "f4", "f5"], 0.0, 1e-7)):
        models = W.RidgeWalk(matrix, folds, features, alpha=alpha).models
        for r in folds.collect():
            train = data[(data["date"] >= r.train_start_date) & (data["date"] <= r.train_end_date)]
            x = train[features].astype(float)
            med = x.median()
            centre = x.fillna(med).iloc[0]
            x = x.fillna(med) - centre
            mean, sd = x.mean(), x.std(ddof=0)
            a, y = ((x - mean) / sd).to_numpy(), train["target_class_5d"].to_numpy(float)
            k = len(features)
            w = np.linalg.lstsq(np.vstack([a, np.sqrt(alpha) * np.eye(k)]), np.append(y - y.mean(), np.zeros(k)), rcond=None)[0]
            got = models[r.fold_id]
            assert np.allclose(got.median, med, rtol=0, atol=0) and np.allclose(got.weight * sd, w, rtol=most, atol=most)
            assert np.allclose(got.mean - centre, mean, atol=1e-6) and got.level == pytest.approx(y.mean())


def test_medians_are_exact_by_refinement(spark, monkeypatch):
    """Few cells and few values at a time, so that intervals are cut again and again: ties, negative and tiny values, infinity."""
    monkeypatch.setattr(M, "CELLS", 4)
    monkeypatch.setattr(M, "FEW", 1)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=600) * 10.0 ** rng.integers(-300, 300, 600), np.zeros(90), [-0.0, np.inf, -np.inf], np.full(100, -3.5)])
    rng.shuffle(values)
    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(i % 30), 1.0 * (i % 3), float(v), None if i % 2 else float(-v), None) for i, v in enumerate(values)]
    train = M.Training(spark.createDataFrame(rows, "date date, y double, a double, b double, c double"), spark.createDataFrame([(1, start, start + dt.timedelta(9)), (2, start + dt.timedelta(5), start + dt.timedelta(29))], "fold_id int, train_start_date date, train_end_date date"), ["a", "b", "c"])
    train._count()
    got = train._medians()
    for f, (lo, hi) in enumerate(((0, 9), (5, 29))):
        some = [r for r in rows if lo <= (r[0] - start).days <= hi]
        for j in (0, 1):
            assert got[f, j] == np.median([r[2 + j] for r in some if r[2 + j] is not None])
        assert got[f, 2] == 0
    keys = M.ordered(np.sort(values))
    assert (np.diff(keys) >= 0).all() and np.array_equal(M.unordered(keys), np.sort(values) + 0.0)


def test_pooled_ranks_in_cells(spark, monkeypatch):
    """Cells of a few values, ties across blocks, null targets and features, dates of no fold; against pandas."""
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    rng = np.random.default_rng(4)
    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(int(i) % 40), f"T{i:04d}", None if rng.random() < 0.1 else float(np.round(rng.normal(), 1)), None if rng.random() < 0.2 else float(rng.integers(-2, 3)), float(rng.normal())) for i in range(1500)]
    matrix = spark.createDataFrame(rows, "date date, ticker string, fwd_ret_5d double, a double, b double")
    folds = spark.createDataFrame([(7, start, start + dt.timedelta(19)), (8, start + dt.timedelta(10), start + dt.timedelta(29)), (9, start + dt.timedelta(25), start + dt.timedelta(35)), (10, start + dt.timedelta(90), start + dt.timedelta(99))], "fold_id int, train_start_date date, train_end_date date")
    got = {(r["fold_id"], r["feature"]): r["fold_rank_ic"] for r in N.fold_correlations(matrix, folds, ["a", "b"]).collect()}
    data = pd.DataFrame(rows, columns=["date", "ticker", "y", "a", "b"])
    for r in folds.collect():
        some = data[(data["date"] >= r.train_start_date) & (data["date"] <= r.train_end_date)]
        for f in ("a", "b"):
            both = some[f].notna() & some["y"].notna()
            want = np.corrcoef(some[f].rank()[both], some["y"].rank()[both])[0, 1] if len(some) else None
            assert got[r.fold_id, f] == (None if want is None else pytest.approx(want, abs=1e-12))
    assert len(got) == 8


def test_samples_are_bounded_and_correlations_blocked(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK_ROWS", 16)
    monkeypatch.setattr(N, "BLOCK_COLUMNS", 2)
    rng = np.random.default_rng(6)
    start = dt.date(2020, 1, 1)
    names = [f"f{k}" for k in range(5)]
    rows = [(start + dt.timedelta(i % 30), f"T{i:04d}", *(None if rng.random() < 0.1 else float(np.round(rng.normal() + (k > 2) * i / 300, 1)) for k in range(5))) for i in range(900)]
    matrix = spark.createDataFrame(rows, "date date, ticker string, " + ", ".join(f"{n} double" for n in names))
    folds = spark.createDataFrame([(1, start, start + dt.timedelta(14)), (2, start + dt.timedelta(9), start + dt.timedelta(29))], "fold_id int, train_start_date date, train_end_date date")
    every = N.sampled(matrix, folds, 4, 10**6).toPandas()
    assert {f: sorted((d - start).days for d in g["date"].unique()) for f, g in every.groupby("fold_id")} == {1: [0, 4, 8, 12], 2: [9, 13, 17, 21, 25, 29]}
    some = N.sampled(matrix.repartition(5), folds, 4, 50).toPandas()
    again = N.sampled(matrix.coalesce(1), folds, 4, 50).toPandas()
    assert list(some.groupby("fold_id").size()) == [50, 50] and sorted(zip(some["fold_id"], some["idx"], some["ticker"])) == sorted(zip(again["fold_id"], again["idx"], again["ticker"]))
    assert set(zip(some["fold_id"], some["ticker"])) <= set(zip(every["fold_id"], every["ticker"]))
    got = {(r["fold_id"], r["feature_a"], r["feature_b"]): r["c"] for r in N.sample_correlations(spark.createDataFrame(some.astype(object).where(some.notna(), None)[["fold_id", "idx", *names]].values.tolist(), "fold_id int, idx int, " + ", ".join(f"{n} double" for n in names)), names).collect()}
    assert len(got) == 20
    for f, g in some.groupby("fold_id"):
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                both = g[a].notna() & g[b].notna()
                assert got[f, a, b] == pytest.approx(np.corrcoef(g[a].rank()[both], g[b].rank()[both])[0, 1], abs=1e-12)


def test_plan_is_checked(spark, frame):
    matrix = _table(spark, frame)
    row = W.plan_summary(W.plan(matrix, W.FoldConfig(20, 8, 8, 2)), matrix, W.FoldConfig(20, 8, 8, 2)).first()
    assert row["folds"] == 4 and row["warning"] == ""
    assert W.plan_summary(W.plan(matrix), matrix).first()["warning"].startswith("insufficient_history")
    d = [dt.date(2020, 1, k) for k in range(1, 20)]
    fold = lambda i, a, b, c, e: dict(fold_id=i, train_start_date=d[a], train_end_date=d[b], test_start_date=d[c], test_end_date=d[e])
    W.check_folds([fold(1, 0, 3, 5, 6), fold(2, 2, 5, 7, 8)])
    for bad in ([fold(1, 0, 5, 5, 6)], [fold(1, 3, 0, 5, 6)], [fold(1, 0, 3, 5, 7), fold(2, 2, 5, 7, 8)]):
        with pytest.raises(ValueError):
            W.check_folds(bad)


def test_signals_train_before_the_date(spark, frame):
    panel = frame.copy()
    last = panel["date"].max()
    panel.loc[panel["date"] == last, "label_valid_5d"] = False
    panel.loc[(panel["date"] == last) & (panel["ticker"] == "T00"), "model_eligible"] = False
    got = W.daily_scores(_table(spark, panel), FEATURES).toPandas().sort_values("ticker")
    test = panel[(panel["date"] == last) & panel["model_eligible"]].sort_values("ticker")
    assert set(got["date"]) == {last} and len(got) == 11 and np.allclose(got["score"], _ridge(panel[panel["date"] < last], test), atol=1e-9)
    with pytest.raises(ValueError, match="nothing|no training"):
        W.daily_scores(_table(spark, panel[panel["date"] == last]), FEATURES)


def test_discovery_against_pandas(spark, frame):
    matrix = _table(spark, frame)
    folds = W.plan(matrix, W.FoldConfig(20, 8, 8, 2))
    days = D.by_date(matrix, FEATURES)
    ics = {(r["fold_id"], r["feature"]): r for r in D.daily_ic(days, folds).collect()}
    pooled = {(r["fold_id"], r["feature"]): r["fold_rank_ic"] for r in N.fold_correlations(matrix, folds, FEATURES).collect()}
    stats = {(r["fold_id"], r["feature"]): r for r in D.feature_stats(days, folds).collect()}
    pairs = {(r["feature_a"], r["feature_b"]): r for r in D.correlations(matrix, folds, FEATURES, 5).collect()}
    strongest = []
    for r in folds.toPandas().itertuples():
        train = frame[(frame["date"] >= r.train_start_date) & (frame["date"] <= r.train_end_date)]
        for f in FEATURES:
            x = train[f].astype(float)
            s = stats[r.fold_id, f]
            assert s["rows"] == len(x) and s["non_null_pct"] == pytest.approx(x.notna().mean()) and (s["std"] is None) == x.isna().all()
            assert s["std"] is None or s["std"] == pytest.approx(x.std(ddof=0), abs=1e-7)
            each = [np.corrcoef(g[f].astype(float).rank().dropna(), g["fwd_ret_5d"].rank()[g[f].notna()])[0, 1] for _, g in train.groupby("date") if g[f].astype(float).nunique() > 1]
            want = np.mean(each) if each else None
            both = x.notna()
            whole = np.corrcoef(x.rank()[both], train["fwd_ret_5d"].rank()[both])[0, 1] if x.nunique() > 1 else None
            assert pooled[r.fold_id, f] == (None if whole is None else pytest.approx(whole, abs=1e-12))
            assert ics[r.fold_id, f]["dates"] == len(each) and (want is None or ics[r.fold_id, f]["mean_daily_rank_ic"] == pytest.approx(want))
        days_ = sorted(train["date"].unique())[::5]
        some = train[train["date"].isin(days_)]
        both = some["f1"].notna()
        strongest.append(abs(np.corrcoef(some["f1"].astype(float).rank()[both], some["f2"].rank()[both])[0, 1]))
    assert pairs["f1", "f2"]["folds"] == 4 and pairs["f1", "f2"]["max_abs_corr"] == pytest.approx(max(strongest)) and pairs["f1", "f3"]["folds"] == 0


CHOICES = "feature string, non_null_pct double, finite_pct double, std double, abs_mean_rank_ic double, sign_stability double"


def test_selection_prunes_and_freezes(spark):
    rows = [("a", 1.0, 1.0, 1.0, 0.05, 0.9), ("b", 1.0, 1.0, 1.0, 0.04, 0.9), ("c", 1.0, 1.0, 1.0, 0.03, 0.9), ("d", 0.4, 0.4, 1.0, 0.09, 0.9), ("e", 1.0, 0.9, 1.0, 0.09, 0.9), ("f", 1.0, 1.0, 1e-12, 0.09, 0.9), ("g", 1.0, 1.0, 1.0, 0.0009, 0.9), ("h", 1.0, 1.0, 1.0, 0.09, 0.4), ("exit_Close_x", 1.0, 1.0, 1.0, 0.5, 1.0), ("n", 1.0, 1.0, None, 0.5, 1.0), ("m", 1.0, 1.0, 1.0, None, 0.0)]
    found = D.reject_reasons(spark.createDataFrame(rows, CHOICES))
    pairs = spark.createDataFrame([("a", "b", 0.97), ("a", "c", 0.5), ("b", "c", None)], "feature_a string, feature_b string, max_abs_corr double")
    out = {r["feature"]: (r["reject_reason"], r["rank"]) for r in D.selected(found, pairs).collect()}
    assert out == {"a": ("", 1), "c": ("", 2), "b": ("correlation_pruned", None), "d": ("excessive_nulls", None), "e": ("non_finite", None), "f": ("near_zero_variance", None), "g": ("weak_rank_ic", None), "h": ("unstable_sign", None), "exit_Close_x": ("leakage_name", None), "n": ("near_zero_variance", None), "m": ("weak_rank_ic", None)}
    one = {r["feature"]: (r["reject_reason"], r["selected"]) for r in D.selected(found, pairs, R.SELECTION | {"max_selected_features": 1}).collect()}
    assert one["a"] == ("", True) and one["b"] == one["c"] == ("", False)  # what is beyond the limit has no reason
    one, two = D.freeze(["a", "c"], {"limit": 64}), D.freeze(["c", "a"], {"limit": 64})
    assert one["feature_count"] == 2 and one["sha256"] != two["sha256"] and one == D.freeze(["a", "c"], {"limit": 64})


def test_settings_and_rules_come_from_files(spark, tmp_path):
    path = tmp_path / "selection.yaml"
    path.write_text("feature_set: x\nmin_std: 2.0\nmax_selected_features: 5\nrules:\n  rejects:\n  - {metric: std, op: '<=', limit: min_std, verdict: too_flat}\n  - {metric: finite_pct, op: '<', limit: 0.95, verdict: holes}\n")
    settings, rules = R.configured(str(path), R.SELECTION, R.SELECTION_RULES)
    assert settings["max_selected_features"] == 5 and settings["min_non_null_pct"] == 0.5
    rows = [("a", 0.1, 1.0, 2.0, 0.0, 0.0), ("b", 0.1, 0.94, 3.0, 0.0, 0.0), ("c", 0.1, 0.95, 3.0, 0.0, 0.0)]
    out = {r["feature"]: r["reject_reason"] for r in D.reject_reasons(spark.createDataFrame(rows, CHOICES), settings, rules["rejects"]).collect()}
    assert out == {"a": "too_flat", "b": "holes", "c": ""}
    nested = tmp_path / "gate.json"
    nested.write_text('{"baseline_h5": {"min_fold_count": 3}}')
    assert R.configured(str(nested), R.GATE, R.GATE_RULES, "baseline_h5")[0]["min_fold_count"] == 3
    for text in ('{"min_std": "x"}', '{"rules": {"other": []}}', '{"rules": {"rejects": [{"metric": "a", "op": "~", "verdict": "v"}]}}', "[1]"):
        nested.write_text(text)
        with pytest.raises(ValueError):
            R.configured(str(nested), R.SELECTION, R.SELECTION_RULES)
    with pytest.raises(ValueError, match="lack"):
        R.Rule("a", "<", "no_such", "v").column({})


GATED = "model string, total_oos_rows long, fold_count long, mean_daily_rank_ic double, rank_ic_t_stat double, long_short_net_return double, top_decile_net_return double, bottom_decile_net_short_return double, score_min double, score_max double, metric_warnings array<string>, metric_blockers array<string>"


def test_gate_over_metrics(spark):
    good = ["good", 2_000_000, 30, 0.06, 3.0, 0.01, 0.02, 0.01, -1.0, 1.0, [], []]
    put = lambda name, **at: [name, *(at.get(c.split()[0], v) for c, v in zip(GATED.split(", ")[1:], good[1:]))]
    rows = [
        good, put("warned", bottom_decile_net_short_return=-0.01, metric_warnings=["fold_1_score_outlier"], score_min=-6.0, mean_daily_rank_ic=0.03, long_short_net_return=0.004),
        put("zero", mean_daily_rank_ic=0.0, long_short_net_return=0.0, top_decile_net_return=-0.1), put("short", total_oos_rows=999_999, fold_count=19, rank_ic_t_stat=1.9),
        put("none", total_oos_rows=None, rank_ic_t_stat=None, score_min=None, score_max=None, bottom_decile_net_short_return=None, metric_blockers=["missing_oos_predictions"]),
    ]
    out = {r["model"]: r for r in E.gate(spark.createDataFrame(rows, GATED)).collect()}
    assert (out["good"]["status"], out["good"]["passed"], out["good"]["warnings"], out["good"]["next_stage"]) == ("PASS", True, [], "feature_expansion")
    assert out["warned"]["status"] == "PASS_WITH_WARNINGS" and out["warned"]["warnings"] == ["extreme_prediction_score", "long_short_net_return_positive_but_small", "mean_daily_rank_ic_below_0_05", "metrics_warning:fold_1_score_outlier", "short_leg_net_return_non_positive"]
    assert out["zero"]["failures"] == ["mean_daily_rank_ic_failed_positive_threshold", "long_short_net_return_failed_positive_threshold", "top_decile_net_return_failed_positive_threshold"] and out["zero"]["recommendation"] == "stop_and_inspect_pipeline_model_data" and out["zero"]["next_stage"] is None
    assert out["short"]["failures"] == ["total_oos_rows_below_threshold", "fold_count_below_threshold", "rank_ic_t_stat_below_threshold"]
    assert out["none"]["failures"] == ["metrics_blockers_present", "total_oos_rows_missing", "rank_ic_t_stat_missing"] and out["none"]["status"] == "FAIL"
    given = E.gate(spark.createDataFrame([good], GATED), failures=("metrics_file_missing",)).first()
    assert given["failures"] == ["metrics_file_missing"] and not given["passed"]


def test_gate_inputs_say_what_is_odd(spark, frame):
    preds = spark.createDataFrame([("m", 1 + i % 2, r.date, r.ticker, r.fwd_ret_5d, 9.0 if i == 3 else (None if i == 5 else float(i % 7))) for i, r in enumerate(frame.itertuples())], "model string, fold_id int, date date, ticker string, fwd_ret_5d double, score double")
    row = E.gate_inputs(preds.where("date <= '2020-01-10' or ticker < 'T03'")).first()
    assert set(row["metric_warnings"]) == {"missing_or_null_prediction_rows", "dates_with_too_few_names_for_deciles", "dates_with_too_few_names_for_quintiles", "fold_1_score_outlier", "fold_2_score_outlier"}
    assert row["score_max"] == 9.0 and row["fold_count"] == 2 and row["metric_blockers"] == []


def test_score_stats_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=900), np.zeros(300), [7.0]])
    preds = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)] + [(0, None)], "g int, score double")
    row = E.score_stats(preds, cells=16).first()
    assert row["rows"] == len(x) and all(row[n] == pytest.approx(np.quantile(x, q)) for n, q in E.QUANTILES.items())
    by = {r["g"]: r for r in E.score_stats(preds, "g", cells=16).collect()}
    assert all(by[g][n] == pytest.approx(np.quantile(x[g::2], q)) for g in (0, 1) for n, q in E.QUANTILES.items())


def test_raw_files_are_read_by_their_headers(spark, tmp_path):
    head = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>"
    (tmp_path / "a.us.txt").write_text(head + "\nA.US,D,20200102,000000,1,2,0.5,1.5,10,0\n")
    (tmp_path / "b.us.txt").write_text("<DATE>,<TICKER>,<PER>,<TIME>,<CLOSE>,<OPEN>,<HIGH>,<LOW>,<OPENINT>,<VOL>\n20200103,B.US,D,0,1.5,1,2,0.5,3,0\n")
    (tmp_path / "c.us.txt").write_text("<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<OPENINT>\nC.US,D,20200102,000000,1,2,0.5,1.5,0\n")
    (tmp_path / "d.us.txt").write_text("")
    raw = {r["source_file"]: r for r in B.read_raw(spark, str(tmp_path)).collect()}
    assert set(raw) == {"a.us.txt", "b.us.txt"} and raw["b.us.txt"]["ticker"] == "B.US" and raw["b.us.txt"]["date"] == "20200103" and raw["b.us.txt"]["vol"] == "0" and raw["b.us.txt"]["openint"] == "3"
    assert {r["source_file"]: r["reason"] for r in B.rejected_files(spark, str(tmp_path)).collect()} == {"c.us.txt": "missing_columns:vol"}
    checked = B.validate(B.read_raw(spark, str(tmp_path)))
    assert [r["source_file"] for r in B.zero_volume_warnings(checked).collect()] == ["b.us.txt"]
    assert {(r["source_file"], r["valid_rows"], r["zero_volume_rows"]) for r in B.validation_summary(checked).collect()} == {("a.us.txt", 1, 0), ("b.us.txt", 1, 1)}


def test_outputs_are_guarded(tmp_path):
    ok = str(tmp_path / "out")
    assert S.guard(ok, str(tmp_path)) == ok and S.guard("s3://b/out/x", "s3://b/out") == "s3://b/out/x"
    for path, root, source in ((str(tmp_path), str(tmp_path), None), ("/elsewhere", str(tmp_path), None), (str(tmp_path / "raw_txt/x"), str(tmp_path), None), (ok, str(tmp_path), ok + "/in"), ("s3://c/x", "s3://b/out", None)):
        with pytest.raises(ValueError):
            S.guard(path, root, source=source)
