"""The registered queries of the research engine and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import ablation as L
from ..operators import audits as A
from ..operators import catalog as C
from ..operators import discovery as D
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import matrix as M
from ..operators import options as O
from ..operators import panel as P
from ..operators import ranks as N
from ..operators import rules as R
from ..operators import walkforward as W
from ..sources import bars as B
from ..sources.store import settled
from . import oracle as Q

KEYS = ["ticker", "date"]
Query = Callable[[SparkSession, str], DataFrame]


def _labelled(spark, sf):
    return P.label(P.universe(P.gate(B.bars_from_lines(spark, sf))))


def _gated(spark, sf):
    return P.gate(B.bars_from_lines(spark, sf))


def _preds(spark, sf):
    m = X.baseline(_labelled(spark, sf))
    return m.where("ret_20d IS NOT NULL").select("date", "ticker", "fwd_ret_5d", F.round("ret_20d", 9).alias("score"))


def _ranked(spark, sf, more=False):
    """The panel with classes and ranks: narrow, written once, read by whatever makes the matrix of it."""
    return settled(M.by_dates(M.panel(M.lines_by_ticker(spark, sf), more=more)))


def _plan(rows):
    return W.plan(rows.where("label_valid_5d").select("date"))


#: Feature families: the columns of one query each.
_B = set(C.names(C.BASELINE))
FAMILIES = {
    "returns": [n for n in X.BASELINE_NAMES if n.startswith("ret_") or n in ("gap_return", "intraday_return")],
    "candles": ["true_range_pct", "atr_14_pct", "range_pct", "body_pct", "range_z_20d", "upper_wick_pct", "lower_wick_pct", "close_position_in_day_range"],
    "volatility": [n for n in X.BASELINE_NAMES if n.startswith("realized_vol")],
    "trend": [n for n in X.BASELINE_NAMES if "sma" in n],
    "extremes": [n for n in X.BASELINE_NAMES if not n.startswith("rank_") and (n.startswith(("dist_to", "drawdown", "bounce")) or n.endswith("d_range"))],
    "rsi": ["rsi_14", "rsi_30"],
    "volume": [n for n in X.BASELINE_NAMES if "volume" in n and not n.startswith("rank_")],
    "calendar": ["day_of_week", "month"],
    "ranks": [f"rank_{c}" for c in C.BASELINE_RANKS],
}
EXPANDED_FAMILIES = {
    "momentum": [n for n in X.EXPANDED_NAMES if n.startswith(("ret_", "log_ret", "reversal", "momentum"))],
    "extremes": [n for n in X.EXPANDED_NAMES if n.startswith(("drawdown", "bounce", "close_position"))],
    "days_since": [n for n in X.EXPANDED_NAMES if n.startswith("days_since")],
    "trend": [n for n in X.EXPANDED_NAMES if n.startswith("trend_") or "sma" in n],
    "volatility": [n for n in X.EXPANDED_NAMES if n.startswith(("realized_vol", "vol_ratio", "downside", "upside", "atr_14_z"))],
    "volume": [n for n in X.EXPANDED_NAMES if n.startswith(("volume_", "dollar_volume_", "price_volume"))],
    "shape": [n for n in X.EXPANDED_NAMES if n.startswith(("lower_wick", "upper_wick", "body_z", "gap_z", "large_"))],
    "ranks": [f"rank_{c}" for c in C.EXPANDED_RANKS],
}


def _pick(df: DataFrame, columns: list[str]) -> DataFrame:
    return rounded(df.select(*KEYS, *columns), KEYS)


def _sql_pick(ctes: str, source: str, columns: list[str], keys: tuple[str, ...] = ("ticker", "date"), whole: tuple[str, ...] = ("day_of_week", "month")) -> str:
    cols = ", ".join(f'"{c}"' if c in whole or c.startswith("days_since") else f'round(CAST("{c}" AS DOUBLE), 6) + 0.0 AS "{c}"' for c in columns)
    return f"WITH {ctes}\nSELECT {', '.join(keys)}, {cols} FROM {source}"


def features_query(kind: str, columns: list[str], spark: SparkSession, sf: str) -> DataFrame:
    labelled = _labelled(spark, sf)
    if kind == "baseline":
        return _pick(X.baseline(labelled), columns)
    if kind == "expanded":
        return _pick(X.expanded(X.baseline(labelled)), columns)
    return _pick(X.long_only(labelled), columns)


def bars(spark, sf):
    return rounded(B.bars_from_lines(spark, sf), KEYS)


def gating(spark, sf):
    df = P.universe(_gated(spark, sf))
    return rounded(df.select(*KEYS, "history_bars", "median_dollar_volume_20", "median_dollar_volume_60", "zero_volume_count_20", "zero_volume_count_60", "tradable", "model_eligible"), KEYS)


def labels(spark, sf):
    return rounded(_labelled(spark, sf).select(*KEYS, "next_open", "exit_close_5d", "exit_date_5d", "fwd_ret_5d", "split_gap_in_window", "label_valid_5d", "target_class_5d"), KEYS)


def label_reasons(spark, sf):
    return P.label_reasons(_labelled(spark, sf))


def label_counts_by_year(spark, sf):
    return P.label_counts(_labelled(spark, sf).withColumn("year", F.year("date")), "year")


def volatility_target(spark, sf):
    df = P.volatility_target(_labelled(spark, sf))
    return rounded(df.select(*KEYS, "trailing_vol_60d", "fwd_ret_5d_vol_norm60", "label_valid_5d_vol_norm60", "target_class_5d_vol_norm60"), KEYS)


def split_gaps(spark, sf):
    return rounded(P.split_gaps(B.bars_from_lines(spark, sf)), KEYS)


def flagship_decile_returns(spark, sf):
    return rounded(E.bucket_profile(E.bucketed(_preds(spark, sf))), [])


def bucket_returns(spark, sf):
    return rounded(E.bucket_returns(E.bucketed(_preds(spark, sf))), [])


def long_short(spark, sf):
    return rounded(E.long_short(E.bucketed(_preds(spark, sf))), [])


def rank_ic(spark, sf):
    return rounded(E.rank_ic(_preds(spark, sf)), [])


def ic_summary(spark, sf):
    return rounded(E.ic_summary(E.rank_ic(_preds(spark, sf))), [])


def score_stats(spark, sf):
    return rounded(E.score_stats(_preds(spark, sf)), [])


def turnover_top20(spark, sf):
    return rounded(E.turnover(E.top_names(_preds(spark, sf), 20)), [])


def lagged_control_ic(spark, sf):
    return rounded(E.rank_ic(E.lagged_scores(_preds(spark, sf))), [])


def random_control_ic(spark, sf):
    return rounded(E.ic_summary(E.rank_ic(E.random_scores(_preds(spark, sf), 101))), [])


def fold_plan(spark, sf):
    return W.plan(_labelled(spark, sf).where("label_valid_5d"))


RIDGE_FEATURES = X.BASELINE_NAMES


def ridge_walk_forward(spark, sf):
    rows = _ranked(spark, sf)
    return rounded(W.ridge_predictions(M.features(rows, RIDGE_FEATURES), _plan(rows), RIDGE_FEATURES), [*KEYS, "fold_id"])


def ridge_fold_metrics(spark, sf):
    rows = _ranked(spark, sf)
    p = settled(W.ridge_predictions(M.features(rows, RIDGE_FEATURES), _plan(rows), RIDGE_FEATURES))
    ics = E.rank_ic(p, "fold_id", "date").groupBy("fold_id").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("dates"))
    ls = E.long_short(E.bucketed(p, 10, "fold_id", "date"), 10, 1, 25.0, "fold_id", "date").groupBy("fold_id").agg(F.avg("gross").alias("gross"), F.avg("net").alias("net"))
    return rounded(ics.join(ls, "fold_id", "left"), ["fold_id"])


def plan_summary(spark, sf):
    m = settled(_labelled(spark, sf).where("label_valid_5d").select("date"))
    return W.plan_summary(W.plan(m), m)


#: The models that the ablation queries compare, and a liquidity floor that the derived bars can meet.
MODELS = {"momentum": "ret_20d", "reversal": "-ret_5d", "calm": "-realized_vol_20d"}
FLOOR = 30_000.0


def _focus(spark, sf):
    panel = _labelled(spark, sf)
    m = X.baseline(panel)
    folds = F.broadcast(W.plan(m).select("fold_id", "test_start_date", "test_end_date"))  # one row per fold
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.round(F.expr(x), 9).alias("score")) for n, x in MODELS.items())))
    rows = m.join(folds, m["date"].between(F.col("test_start_date"), F.col("test_end_date"))).select("fold_id", m["date"], "ticker", "fwd_ret_5d", each.alias("e"))
    preds = rows.select("e.*", "fold_id", "date", "ticker", "fwd_ret_5d").where("score IS NOT NULL")
    return L.focus_daily(L.with_liquidity(preds, panel), 25, FLOOR)


def ablation_by_year(spark, sf):
    return rounded(L.by_period(_focus(spark, sf), "year"), ["model", "year"])


def ablation_by_fold(spark, sf):
    return rounded(L.by_period(_focus(spark, sf), "fold_id"), ["model", "fold_id"])


def ablation_comparison(spark, sf):
    return rounded(L.compared(L.profiles(_focus(spark, sf)), "reversal", "momentum"), ["model"])


def _fold_preds(spark, sf):
    """The momentum score over every fold's test dates."""
    m = X.baseline(_labelled(spark, sf))
    folds = F.broadcast(W.plan(m).select("fold_id", "test_start_date", "test_end_date"))  # one row per fold
    return m.join(folds, m["date"].between(F.col("test_start_date"), F.col("test_end_date"))).select("fold_id", m["date"], "ticker", "fwd_ret_5d", F.round("ret_20d", 9).alias("score"))


def _settled_preds(spark, sf):
    """Predictions are written once: every metric reads them, none computes the panel again."""
    return settled(_fold_preds(spark, sf))


def fold_metrics(spark, sf):
    return rounded(E.fold_metrics(_settled_preds(spark, sf)), ["fold_id"])


def model_metrics(spark, sf):
    return rounded(E.metrics(_settled_preds(spark, sf).withColumn("model", F.lit("momentum")), "model"), ["model"])


def negative_controls(spark, sf):
    return rounded(E.metrics(E.control_scores(_settled_preds(spark, sf)), "control"), ["control"])


def fixed_controls(spark, sf):
    """The controls without random scores, which SQL can compute too."""
    return rounded(E.metrics(E.control_scores(_settled_preds(spark, sf), ()), "control"), ["control"])


def rows_by_year(spark, sf):
    return P.rows_by_year(P.universe(_gated(spark, sf)))


def class_agreement(spark, sf):
    return rounded(P.class_agreement(P.volatility_target(_labelled(spark, sf))), [])


def feature_null_counts(spark, sf):
    return X.null_counts(M.features(M.by_dates(M.panel(M.lines_by_ticker(spark, sf))), X.BASELINE_NAMES), X.BASELINE_NAMES)


def master_audit(spark, sf):
    """A security master of the bars' tickers, as text, with defects planted by the ticker's number."""
    k = F.substring("ticker", 2, 5).cast("int")
    bars = B.bars_from_lines(spark, sf).groupBy("ticker").agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b"))
    flag = F.when(k % 7 == 0, "maybe").otherwise("No")
    text = bars.select(
        F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("P"), "ticker")).alias("permanent_id"), F.concat("ticker", F.lit(".US")).alias("raw_ticker"), "ticker", F.lit("stock").alias("security_type"),
        F.when(k % 3 == 0, "n/a").otherwise(F.col("a")).alias("listing_date"), F.when(k % 2 == 0, F.col("b")).otherwise("").alias("delisting_date"),
        F.when(k % 4 == 0, F.col("b")).otherwise(F.col("a")).alias("ticker_start_date"), F.when(k % 4 == 0, F.col("a")).otherwise(F.col("b")).alias("ticker_end_date"),
        F.lit("X").alias("exchange"), *(flag.alias(c) for c in A.MASTER_FLAGS), F.lit("s").alias("source"), F.lit("2020-01-01").alias("source_asof_date"),
    )
    return A.audit_master(text.unionByName(text.where(k % 11 == 0)))


def corporate_actions_audit(spark, sf):
    """Corporate actions made of the bars, as text, with defects planted by the day of the month."""
    k = F.dayofmonth("date")
    day = F.col("date").cast("string")
    return A.audit_events(B.bars_from_lines(spark, sf).select(
        F.concat("ticker", F.lit(".US")).alias("raw_ticker"), "ticker", F.when(k == 3, "2020-13-01").when(k == 4, "").otherwise(day).alias("event_date"),
        F.when(k == 5, "rights").otherwise("Split").alias("action_type"), F.when(k == 6, "").otherwise("s").alias("source"), day.alias("source_asof_date"),
        F.when(k == 7, "0").otherwise("2").alias("split_ratio"), F.when(k == 8, "-1").when(k == 9, "n/a").when(k == 10, "").otherwise("1.5").alias("cash_amount"),
    ))


def _chains(spark, sf):
    """One option a bar, as import text; some are crossed, expired or of an unknown kind."""
    k = F.dayofmonth("date")
    s = lambda c: F.col(c).cast("string")
    return O.normalize(B.bars_from_lines(spark, sf).select(
        F.lower("ticker").alias("underlying_ticker"), F.concat_ws("_", "ticker", "date").alias("option_symbol"), F.lit("bars").alias("data_source"), s("date").alias("snapshot_date"), F.when(k == 3, s("date")).otherwise(F.date_add("date", 30).cast("string")).alias("expiration"),
        s("open").alias("strike"), F.when(k == 4, "X").when(k % 2 == 0, "call").otherwise("P").alias("call_put"), F.when(k == 5, "-1").otherwise(s("low")).alias("bid"), F.when(k == 6, "0").when(k == 7, "n/a").otherwise(s("high")).alias("ask"),
    ))


def option_faults(spark, sf):
    """The chains' faults, some options being there twice."""
    chains = _chains(spark, sf)
    return O.faults(chains.unionByName(chains.where(F.dayofmonth("snapshot_date") == 8)))


def option_coverage(spark, sf):
    candidates = B.bars_from_lines(spark, sf).groupBy("ticker").agg(F.max("date").alias("score_date")).withColumn("side", F.lit("long"))
    return O.coverage(O.link(_chains(spark, sf), candidates), candidates)


def _days(spark, sf):
    """The panel, the folds, and what each date says of each feature."""
    rows = _ranked(spark, sf)
    return rows, settled(_plan(rows)), settled(D.by_date(M.features(rows, X.BASELINE_NAMES), X.BASELINE_NAMES))


def discovery_stats(spark, sf):
    _, folds, days = _days(spark, sf)
    return rounded(D.feature_stats(days, folds), ["fold_id"])


def discovery_daily_ic(spark, sf):
    rows = _ranked(spark, sf)
    return rounded(D.daily_ic(D.by_date(M.features(rows, X.BASELINE_NAMES), X.BASELINE_NAMES), _plan(rows)), ["fold_id"])


def discovery_fold_ic(spark, sf):
    rows = _ranked(spark, sf)
    return rounded(N.fold_correlations(settled(M.features(rows, X.BASELINE_NAMES)), _plan(rows), X.BASELINE_NAMES), ["fold_id"])


def _correlations(rows, folds):
    """Only the sample's dates get features."""
    chosen = settled(N.sample_dates(rows.where("label_valid_5d"), folds, 20))
    m = settled(M.features(rows, X.BASELINE_NAMES, only=chosen))
    return D.correlations(m, folds, X.BASELINE_NAMES, chosen=chosen)


def discovery_correlations(spark, sf):
    rows = _ranked(spark, sf)
    return rounded(_correlations(rows, _plan(rows)), [])


def judged(matrix, folds, days, features, settings=R.SELECTION, rules=R.REJECTS):
    """Every feature with its statistics, the first rule that it breaks and its score."""
    stats = D.feature_stats(days, folds).groupBy("feature").agg(F.avg("non_null_pct").alias("non_null_pct"), F.avg("finite_pct").alias("finite_pct"), F.avg("std").alias("std"))
    found = D.summary(D.daily_ic(days, folds), N.fold_correlations(matrix, folds, features))
    return D.reject_reasons(found.join(stats, "feature"), settings, rules)


def selection(spark, sf):
    rows, folds, days = _days(spark, sf)
    return rounded(judged(settled(M.features(rows, X.BASELINE_NAMES)), folds, days, X.BASELINE_NAMES).drop("fold_ics"), [])


def selected_features(spark, sf):
    """The selection after pruning by correlation, with the maps of fold correlations."""
    rows, folds, days = _days(spark, sf)
    found = settled(judged(settled(M.features(rows, X.BASELINE_NAMES)), folds, days, X.BASELINE_NAMES))
    return rounded(D.selected(found, _correlations(rows, folds)), [])


def research_gate(spark, sf):
    """The gate over the controls' scores: the momentum score, random ones, a constant one and the lagged one."""
    preds = E.control_scores(_settled_preds(spark, sf), (101,))
    found = E.gate(E.gate_inputs(settled(preds), "control"))
    joined = {c: F.concat_ws(";", c) for c in ("failures", "warnings")}
    return rounded(found.drop("metric_warnings", "metric_blockers").withColumns(joined), ["control"])


def zero_volume(spark, sf):
    """Tickers by the share of their bars without volume: the bars of one day of the month are taken to have none."""
    bars = B.bars_from_lines(spark, sf)
    return rounded(A.zero_volume(bars.withColumn("volume", F.when(F.dayofmonth("date") == 13, 0).otherwise(F.col("volume")))), [])


def coverage_by_year(spark, sf):
    return rounded(A.tradable_coverage(_gated(spark, sf).withColumn("year", F.year("date")), "year"), [])


def coverage_by_ticker(spark, sf):
    return rounded(A.tradable_coverage(_gated(spark, sf), "ticker"), [])


def gap_impact(spark, sf):
    return A.gap_impact(P.split_gaps(B.bars_from_lines(spark, sf)), P.universe(_gated(spark, sf)))


def symbol_coverage(spark, sf):
    gated = _gated(spark, sf)
    return A.symbol_coverage(gated.select("ticker"), P.universe(gated).where("model_eligible").select("ticker"))


def _raw_judged(spark, sf):
    """Bars as raw text with planted defects (by the bar's own values), validated."""
    raw = B.raw_text_of(B.bars_from_lines(spark, sf))
    k = F.dayofmonth(F.to_date("date", "yyyyMMdd"))
    raw = raw.withColumns({
        "_k": k, "per": F.when(k == 3, "X").otherwise(F.col("per")), "time": F.when(k == 4, "123000").when(k == 5, "0").otherwise(F.col("time")),
        "date": F.when(k == 11, "20201399").otherwise(F.col("date")), "open": F.when(k == 12, "q").otherwise(F.col("open")), "low": F.when(k == 14, "-1").otherwise(F.col("low")),
        "vol": F.when(k == 6, "-1").when(k == 7, "n/a").otherwise(F.col("vol")), "high": F.when(k == 8, "0.5").otherwise(F.col("high")), "openint": F.when(k == 9, "abc").otherwise(F.col("openint")),
    })
    return B.validate(raw.unionByName(raw.where("_k = 10")).drop("_k"))


def raw_validation(spark, sf):
    """Rows per broken rule."""
    return B.reject_counts(_raw_judged(spark, sf))


def raw_gaps(spark, sf):
    """Split-like gaps between the valid rows of a file."""
    return rounded(B.file_gaps(_raw_judged(spark, sf)), ["source_file", "ticker", "date"])


def momentum_signals(spark, sf):
    labelled = _labelled(spark, sf)
    return rounded(W.signals(_preds(spark, sf), labelled), KEYS)


def signals(spark, sf):
    """Candidates of the last date, scored by a ridge on all label-valid rows before it."""
    rows = _ranked(spark, sf, more=True)
    panel = settled(M.features(rows, RIDGE_FEATURES, also=("close", "label_valid_5d", *M.MORE), every=rows.agg(F.max("date").alias("date"))))
    return rounded(W.signals(W.daily_scores(panel, RIDGE_FEATURES, is_settled=True), panel), KEYS)


_PLAIN: dict[str, Query] = {f.__name__: f for f in (flagship_decile_returns, bars, gating, labels, label_reasons, label_counts_by_year, volatility_target, split_gaps, bucket_returns, long_short, rank_ic, ic_summary, score_stats, turnover_top20, lagged_control_ic, random_control_ic, fold_plan, ridge_walk_forward, ridge_fold_metrics, discovery_stats, discovery_daily_ic, discovery_fold_ic, discovery_correlations, selection, zero_volume, coverage_by_year, coverage_by_ticker, gap_impact, symbol_coverage, raw_validation, raw_gaps, signals, momentum_signals, plan_summary, selected_features, research_gate, ablation_by_year, ablation_by_fold, ablation_comparison, fold_metrics, model_metrics, negative_controls, fixed_controls, rows_by_year, class_agreement, feature_null_counts, master_audit, corporate_actions_audit, option_faults, option_coverage)}


def queries() -> dict[str, Query]:
    out = dict(_PLAIN)
    out |= {f"features_{n}": partial(features_query, "baseline", c) for n, c in FAMILIES.items()}
    out |= {f"expanded_{n}": partial(features_query, "expanded", c) for n, c in EXPANDED_FAMILIES.items()}
    out["features_long_only"] = partial(features_query, "long_only", X.LONG_ONLY_NAMES)
    return out


def _round(ctes: str, source: str, plain: str, doubles: str) -> str:
    cols = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
    return f"WITH {ctes}\nSELECT {plain}{', ' if plain and cols else ''}{cols} FROM {source}"


def oracle_sql() -> dict[str, str]:
    r = _round
    q = Q.PREDS
    every = f"""{Q.BASELINE.replace('matrix AS (', 'matrix AS MATERIALIZED (')}, {Q.PLAN[len(Q.LABELLED) + 2:]},
long AS MATERIALIZED (SELECT p.fold_id, m.date, m.ticker, round(m.fwd_ret_5d, 9) AS target, u.feature, round(u.value, 9) AS value FROM matrix m JOIN plan p ON m.date BETWEEN p.train_start_date AND p.train_end_date,
  LATERAL (VALUES {', '.join(f"('{f}', m.{f})" for f in X.BASELINE_NAMES)}) AS u(feature, value))"""
    pooled = f"pooled AS MATERIALIZED (SELECT fold_id, feature, {Q.pearson('v', 't')} AS fold_rank_ic FROM (SELECT fold_id, feature, {Q.average_rank('value', 'fold_id, feature')} AS v, {Q.average_rank('target', 'fold_id, feature')} AS t FROM long) GROUP BY 1, 2)"
    # a date's correlation is that of every fold that trains on it
    daily = f"""{Q.BASELINE.replace('matrix AS (', 'matrix AS MATERIALIZED (')}, {Q.PLAN[len(Q.LABELLED) + 2:]},
every AS (SELECT m.date, round(m.fwd_ret_5d, 9) AS target, u.feature, round(u.value, 9) AS value FROM matrix m, LATERAL (VALUES {', '.join(f"('{f}', m.{f})" for f in X.BASELINE_NAMES)}) AS u(feature, value)),
feature_days AS MATERIALIZED (SELECT feature, date, {Q.pearson('v', 't')} AS ic FROM (SELECT feature, date, {Q.average_rank('value', 'feature, date')} AS v, {Q.average_rank('target', 'feature, date')} AS t FROM every) GROUP BY 1, 2),
daily AS (SELECT fold_id, feature, avg(ic) AS mean_daily_rank_ic, count(ic) AS dates FROM feature_days JOIN plan ON date BETWEEN train_start_date AND train_end_date GROUP BY 1, 2)"""
    stats = "s AS (SELECT fold_id, feature, count(*) AS rows, avg(CAST(value IS NOT NULL AS DOUBLE)) AS non_null_pct, avg(CAST(value IS NOT NULL AND isfinite(value) AS DOUBLE)) AS finite_pct, stddev_pop(value) AS std FROM long GROUP BY 1, 2)"
    out = {
        "bars": r(Q.BARS, "bars", "ticker, date, volume", "open high low close"),
        "gating": r(Q.GATED, "universe", "ticker, date, CAST(history_bars AS INTEGER) AS history_bars, tradable, model_eligible", "median_dollar_volume_20 median_dollar_volume_60 zero_volume_count_20 zero_volume_count_60"),
        "labels": r(Q.LABELLED, "labelled", "ticker, date, exit_date_5d, split_gap_in_window, label_valid_5d, target_class_5d", "next_open exit_close_5d fwd_ret_5d"),
        "label_reasons": f"WITH {Q.LABELLED}, f AS (SELECT *, CASE WHEN pre_research THEN 'pre_research' WHEN not_eligible THEN 'not_eligible' WHEN missing_future THEN 'missing_future' WHEN split_gap_in_window THEN 'split_gap_in_window' ELSE 'valid' END AS fr FROM labelled) SELECT count(*) AS total_rows, count(*) FILTER (label_valid_5d) AS valid_rows, "
        + ", ".join(f"count(*) FILTER ({x}) AS any_{x}, count(*) FILTER (fr = '{x}') AS first_{x}" for x in P.REASONS)
        + " FROM f",
        "label_counts_by_year": f"WITH {Q.LABELLED} SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS total_rows, count(*) FILTER (label_valid_5d) AS valid_rows, "
        + ", ".join(f"count(*) FILTER (label_valid_5d AND target_class_5d = {k}) AS {n}" for k, n in ((-1, "class_neg"), (0, "class_zero"), (1, "class_pos")))
        + " FROM labelled GROUP BY 1",
        "volatility_target": r(
            f"""{Q.LABELLED}, v1 AS (SELECT *, close / nullif(lag(close) OVER ({Q.T}), 0) - 1 AS r FROM labelled), v2 AS (SELECT *, {Q.rolling('stddev_pop', 'r', 60)} AS trailing_vol_60d FROM v1),
v3 AS (SELECT *, CASE WHEN trailing_vol_60d > 1e-6 THEN fwd_ret_5d / trailing_vol_60d END AS fwd_ret_5d_vol_norm60, label_valid_5d AND coalesce(trailing_vol_60d > 1e-6, false) AS label_valid_5d_vol_norm60 FROM v2),
v4 AS {Q._classes('v3', 'fwd_ret_5d_vol_norm60', 'label_valid_5d_vol_norm60', 'target_class_5d_vol_norm60')}""",
            "v4", "ticker, date, label_valid_5d_vol_norm60, target_class_5d_vol_norm60", "trailing_vol_60d fwd_ret_5d_vol_norm60",
        ),
        "split_gaps": r(f"{Q.BARS}, g AS (SELECT *, lag(close) OVER ({Q.T}) AS prev_close FROM bars), h AS (SELECT *, (open / nullif(prev_close, 0) - 1) * 100 AS gap_pct FROM g WHERE open / nullif(prev_close, 0) <= 0.55 OR open / nullif(prev_close, 0) >= 1.8)", "h", "ticker, date", "prev_close open gap_pct"),
        "flagship_decile_returns": r(f"{q}, {Q.bucketed('preds')}, d AS (SELECT date, bucket, avg(fwd_ret_5d) AS m FROM bucketed GROUP BY 1, 2), e AS (SELECT bucket, count(*) AS dates, avg(m) AS mean_return FROM d GROUP BY 1)", "e", "bucket, dates", "mean_return"),
        "bucket_returns": r(f"{q}, {Q.bucketed('preds')}, d AS (SELECT date, bucket, count(*) AS names, avg(fwd_ret_5d) AS mean_return FROM bucketed GROUP BY 1, 2)", "d", "date, bucket, names", "mean_return"),
        "long_short": r(Q.LONG_SHORT, "long_short", "date, long_count, short_count", "long_gross short_gross long_hit_rate short_hit_rate long_net short_net gross net"),
        "rank_ic": r(Q.IC, "ic", "date, names", "ic"),
        "ic_summary": r(f"{Q.IC}, s AS (SELECT count(ic) AS dates, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t_stat FROM ic)", "s", "dates", "mean_ic std_ic t_stat"),
        "score_stats": r(f"{q}, s AS (SELECT count(score) AS rows, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max, " + ", ".join(f"quantile_cont(score, {x}) AS {n}" for x, n in ((0.01, "p01"), (0.05, "p05"), (0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + " FROM preds)", "s", "rows", "mean std min max p01 p05 p50 p95 p99"),
        "turnover_top20": r(f"{q}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rn FROM preds) WHERE rn <= 20), n AS (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM t), u AS (SELECT a.date, count(*) AS names, count(*) FILTER (b.ticker IS NULL) AS new_names, avg(CAST(b.ticker IS NULL AS DOUBLE)) AS turnover FROM n a LEFT JOIN n b ON b.k = a.k - 1 AND b.ticker = a.ticker WHERE a.k > 1 GROUP BY a.date)", "u", "date, names, new_names", "turnover"),
        "fold_plan": f"WITH {Q.PLAN} SELECT * FROM plan",
        "discovery_stats": r(f"{every}, {stats}", "s", "fold_id, feature, rows", "non_null_pct finite_pct std"),
        "discovery_daily_ic": r(daily, "daily", "fold_id, feature, dates", "mean_daily_rank_ic"),
        "discovery_fold_ic": r(f"{every}, {pooled}", "pooled", "fold_id, feature", "fold_rank_ic"),
        "zero_volume": r(f"{Q.BARS}, thinned AS (SELECT * REPLACE (CASE WHEN day(date) = 13 THEN 0 ELSE volume END AS volume) FROM bars), z AS (SELECT ticker, count(*) FILTER (volume = 0) AS zero_rows, count(*) AS rows, count(*) FILTER (volume = 0) / count(*) AS zero_pct FROM thinned GROUP BY 1)", "z WHERE zero_rows > 0", "ticker, zero_rows, rows", "zero_pct"),
        "gap_impact": f"WITH {Q.GATED}, g AS (SELECT ticker, date FROM (SELECT *, open / nullif(lag(close) OVER ({Q.T}), 0) AS x FROM bars) WHERE x <= 0.55 OR x >= 1.8) SELECT CAST(year(g.date) AS INTEGER) AS gap_year, count(*) AS gaps, count(u.ticker) AS in_research, count(*) FILTER (u.model_eligible) AS eligible, count(*) FILTER (NOT u.model_eligible) AS not_eligible FROM g LEFT JOIN universe u USING (ticker, date) GROUP BY 1",
        "symbol_coverage": f"WITH {Q.GATED}, a AS (SELECT DISTINCT ticker FROM gated), b AS (SELECT DISTINCT ticker FROM universe WHERE model_eligible) SELECT count(*) FILTER (b.ticker IS NOT NULL) AS both, count(*) FILTER (b.ticker IS NULL) AS only_left, CAST(0 AS BIGINT) AS only_right FROM a LEFT JOIN b USING (ticker)",
    }
    for name, key in (("coverage_by_year", "CAST(year(date) AS INTEGER) AS year"), ("coverage_by_ticker", "ticker")):
        out[name] = r(f"{Q.GATED}, c AS (SELECT {key}, count(*) AS rows, count(*) FILTER (tradable) AS tradable_rows, avg(CAST(tradable AS DOUBLE)) AS coverage FROM gated GROUP BY 1)", "c", f"{key.split()[-1]}, rows, tradable_rows", "coverage")
    focus = f"""{Q.BASELINE}, {Q.PLAN[len(Q.LABELLED) + 2:]},
scored AS (SELECT u.model, p.fold_id, m.date, m.ticker, m.fwd_ret_5d, m.median_dollar_volume_60, round(u.score, 9) AS score FROM matrix m JOIN plan p ON m.date BETWEEN p.test_start_date AND p.test_end_date,
  LATERAL (VALUES {', '.join(f"('{n}', {x})" for n, x in MODELS.items())}) AS u(model, score) WHERE u.score IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY model, fold_id, date ORDER BY score DESC, ticker) AS rn FROM scored),
focus AS (SELECT model, fold_id, date, CAST(year(date) AS INTEGER) AS year, avg(fwd_ret_5d) AS gross, avg(fwd_ret_5d) - 0.0025 AS net, count(*) AS candidates FROM best WHERE rn <= 25 AND median_dollar_volume_60 >= {FLOOR} GROUP BY 1, 2, 3),
by_year AS (SELECT model, year, avg(net) AS net, avg(gross) AS gross, avg(candidates) AS avg_candidates, count(*) AS active_days FROM focus GROUP BY 1, 2),
by_fold AS (SELECT model, fold_id, avg(net) AS net, avg(gross) AS gross, avg(candidates) AS avg_candidates, count(*) AS active_days FROM focus GROUP BY 1, 2)"""
    out["ablation_by_year"] = r(focus, "by_year", "model, year, active_days", "net gross avg_candidates")
    out["ablation_by_fold"] = r(focus, "by_fold", "model, fold_id, active_days", "net gross avg_candidates")
    out["ablation_comparison"] = r(
        f"""{focus},
whole AS (SELECT model, avg(gross) AS gross, avg(net) AS net, avg(gross) * 10000 AS break_even_bps, avg(candidates) AS avg_candidates FROM focus GROUP BY 1),
year_profile AS (SELECT model, count(*) FILTER (net > 0) AS positive_years, count(*) AS total_years, arg_min(year, (net, year)) AS worst_year, min(net) AS worst_year_net FROM by_year GROUP BY 1),
fold_profile AS (SELECT model, count(*) FILTER (net > 0) AS positive_folds, count(*) AS total_folds, arg_min(fold_id, (net, fold_id)) AS worst_fold, min(net) AS worst_fold_net FROM by_fold GROUP BY 1),
profiles AS (SELECT * FROM whole JOIN year_profile USING (model) JOIN fold_profile USING (model)),
benchmark_row AS (SELECT net AS b_net, positive_folds AS b_folds, positive_years AS b_years FROM profiles WHERE model = 'momentum'),
compared AS (SELECT profiles.*, net - b_net AS net_lead, CASE WHEN model <> 'reversal' THEN NULL WHEN positive_folds > b_folds AND positive_years >= b_years AND avg_candidates >= 10 AND net >= b_net THEN 'continue_review'
  WHEN net < b_net AND positive_folds <= b_folds THEN 'reject_variant' ELSE 'needs_review' END AS verdict FROM profiles LEFT JOIN benchmark_row ON true)""",
        "compared", "model, positive_years, total_years, worst_year, positive_folds, total_folds, worst_fold, verdict", "gross net break_even_bps avg_candidates worst_year_net worst_fold_net net_lead",
    )
    vol = out["volatility_target"]
    agreement = vol[vol.index("WITH ") + 5:vol.rindex("\nSELECT")]
    both = "label_valid_5d AND label_valid_5d_vol_norm60"
    out["class_agreement"] = r(
        f"""{agreement}, ag AS (SELECT count(*) AS rows, count(*) FILTER (label_valid_5d) AS base_valid_rows, count(*) FILTER (label_valid_5d_vol_norm60) AS valid_rows, count(*) FILTER (NOT coalesce(trailing_vol_60d > 1e-6, false)) AS bad_denominator_rows,
avg(CAST(target_class_5d <> target_class_5d_vol_norm60 AS DOUBLE)) FILTER ({both}) AS class_churn, avg(CAST(target_class_5d_vol_norm60 = 1 AS DOUBLE)) FILTER ({both} AND target_class_5d = 1) AS long_agreement,
avg(CAST(target_class_5d_vol_norm60 = -1 AS DOUBLE)) FILTER ({both} AND target_class_5d = -1) AS short_agreement FROM v4)""",
        "ag", "rows, base_valid_rows, valid_rows, bad_denominator_rows", "class_churn long_agreement short_agreement",
    )
    out["rows_by_year"] = f"WITH {Q.GATED} SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, count(*) FILTER (model_eligible) AS eligible_rows, count(DISTINCT ticker) AS tickers FROM universe GROUP BY 1"
    out["feature_null_counts"] = f"WITH {Q.BASELINE}, n AS (SELECT " + ", ".join(f'count(*) FILTER ("{c}" IS NULL) AS "{c}"' for c in X.BASELINE_NAMES) + " FROM matrix) UNPIVOT n ON COLUMNS(*) INTO NAME feature VALUE nulls"
    scored = f"""{Q.BASELINE}, {Q.PLAN[len(Q.LABELLED) + 2:]},
fold_preds AS (SELECT p.fold_id, m.date, m.ticker, m.fwd_ret_5d, round(m.ret_20d, 9) AS score FROM matrix m JOIN plan p ON m.date BETWEEN p.test_start_date AND p.test_end_date)"""
    out["fold_metrics"] = r(f"{scored}, used AS (SELECT * FROM fold_preds WHERE score IS NOT NULL AND fwd_ret_5d IS NOT NULL), {Q.metric_parts('fold_id')}, {Q.FOLD_METRICS}", "fold_metrics", "fold_id, rows, score_outlier", "score_mean score_std score_min score_max mean_rank_ic gross net")
    for name, key, source in (
        ("model_metrics", "model", "SELECT 'momentum' AS model, * FROM fold_preds"),
        ("fixed_controls", "control", "SELECT 'active' AS control, * FROM fold_preds UNION ALL SELECT 'constant', * REPLACE (CAST(0 AS DOUBLE) AS score) FROM fold_preds UNION ALL SELECT 'lagged', * REPLACE (lag(score) OVER (PARTITION BY ticker ORDER BY date, fold_id) AS score) FROM fold_preds"),
        ("negative_controls", "control", "SELECT 'active' AS control, * FROM fold_preds UNION ALL SELECT 'constant', * REPLACE (CAST(0 AS DOUBLE) AS score) FROM fold_preds UNION ALL SELECT 'lagged', * REPLACE (lag(score) OVER (PARTITION BY ticker ORDER BY date, fold_id) AS score) FROM fold_preds" + "".join(f" UNION ALL SELECT 'random_{seed}', * REPLACE (@{seed}@ AS score) FROM fold_preds" for seed in (101, 202))),
    ):
        out[name] = r(f"{scored}, given AS ({source}), used AS (SELECT * FROM given WHERE score IS NOT NULL AND fwd_ret_5d IS NOT NULL), {Q.metric_parts(key)}, {Q.metrics(key)}", "metrics", f"{key}, missing_rows, rows, folds, min_date, max_date, dates_below_buckets, dates_below_quintiles, top_days", "mean_ic ic_t_stat long_gross long_net short_gross short_net gross net long_hit_rate short_hit_rate top_names top_gross top_net top_turnover decile_turnover")
    out["master_audit"] = Q.master_audit(A.MASTER_COLUMNS, A.MASTER_DATES, A.MASTER_FLAGS, A.MASTER_OPEN, A.FLAG_WORDS)
    out["corporate_actions_audit"] = Q.events_audit(A.EVENT_COLUMNS, A.EVENT_DATES, A.EVENT_NUMBERS, A.EVENT_TYPES)
    out["option_faults"] = Q.OPTION_FAULTS
    out["option_coverage"] = f"WITH {Q.BARS} SELECT ticker, max(date) AS score_date, 'long' AS side, count(DISTINCT date) AS snapshots, count(*) AS contracts, string_agg(CAST(date AS VARCHAR), '|' ORDER BY date) AS dates, max(date) AS latest, true AS matches FROM bars GROUP BY 1"
    out["discovery_correlations"] = r(
        f"""{every}, sampled AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY fold_id, feature ORDER BY date) AS d FROM long) WHERE (d - 1) % 20 = 0),
ranks AS MATERIALIZED (SELECT fold_id, date, ticker, feature, {Q.average_rank('value', 'fold_id, feature')} AS r FROM sampled),
per AS (SELECT a.fold_id, a.feature AS feature_a, b.feature AS feature_b, abs({Q.pearson('a.r', 'b.r')}) AS c FROM ranks a JOIN ranks b ON a.fold_id = b.fold_id AND a.date = b.date AND a.ticker = b.ticker AND a.feature < b.feature GROUP BY 1, 2, 3),
correlations AS (SELECT feature_a, feature_b, count(c) AS folds, avg(c) AS mean_abs_corr, max(c) AS max_abs_corr FROM per GROUP BY 1, 2)""",
        "correlations", "feature_a, feature_b, folds", "mean_abs_corr max_abs_corr",
    )
    leak = " OR ".join(f"contains(lower(feature), '{t}')" for t in ("target", "label", "fwd_ret", "next_open", "exit_close", "exit_date"))
    out["selection"] = r(
        f"""{daily}, long AS MATERIALIZED (SELECT p.fold_id, u.feature, round(m.fwd_ret_5d, 9) AS target, round(u.value, 9) AS value FROM matrix m JOIN plan p ON m.date BETWEEN p.train_start_date AND p.train_end_date, LATERAL (VALUES {', '.join(f"('{f}', m.{f})" for f in X.BASELINE_NAMES)}) AS u(feature, value)), {stats}, {pooled},
means AS (SELECT feature, avg(fold_rank_ic) AS m FROM pooled GROUP BY 1),
stable AS (SELECT feature, avg(fold_rank_ic) AS mean_fold_rank_ic, coalesce(avg(CASE WHEN m = 0 THEN 0 ELSE CAST(sign(fold_rank_ic) = sign(m) AS DOUBLE) END) FILTER (fold_rank_ic IS NOT NULL), 0) AS sign_stability FROM pooled JOIN means USING (feature) GROUP BY 1),
folded AS (SELECT feature, count(DISTINCT fold_id) AS folds_scored, avg(mean_daily_rank_ic) AS mean_daily_rank_ic, abs(avg(mean_daily_rank_ic)) AS abs_mean_rank_ic FROM daily GROUP BY 1),
shares AS (SELECT feature, avg(non_null_pct) AS non_null_pct, avg(finite_pct) AS finite_pct, avg(std) AS std FROM s GROUP BY 1),
chosen AS (SELECT *, CASE WHEN {leak} THEN 'leakage_name' WHEN non_null_pct < 0.5 THEN 'excessive_nulls' WHEN finite_pct < 0.99 THEN 'non_finite' WHEN coalesce(std <= 1e-12, true) THEN 'near_zero_variance' WHEN coalesce(abs_mean_rank_ic < 0.001, true) THEN 'weak_rank_ic' WHEN sign_stability < 0.5 THEN 'unstable_sign' ELSE '' END AS reject_reason,
  coalesce(abs_mean_rank_ic, 0) * coalesce(sign_stability, 0) * coalesce(non_null_pct, 0) AS selection_score FROM folded JOIN stable USING (feature) JOIN shares USING (feature))""",
        "chosen", "feature, folds_scored, reject_reason", "mean_daily_rank_ic mean_fold_rank_ic abs_mean_rank_ic sign_stability non_null_pct finite_pct std selection_score",
    )
    u = lambda seed, k: f"((('0x' || substr(md5(concat_ws('|', '{seed}', '{k}', CAST(date AS VARCHAR), ticker)), 1, 10))::BIGINT + 0.5) / {1 << 40})"
    normal = lambda seed: f"(sqrt(-2 * ln({u(seed, 1)})) * cos(2 * pi() * {u(seed, 2)}))"
    out["random_control_ic"] = r(
        f"""{q}, drawn AS (SELECT date, fwd_ret_5d, {normal(101)} AS score FROM preds WHERE fwd_ret_5d IS NOT NULL),
ic AS (SELECT date, {Q.pearson('s', 'r')} AS ic FROM (SELECT date, {Q.average_rank('rs', 'date')} AS s, {Q.average_rank('fr', 'date')} AS r FROM (SELECT date, round(score, 9) AS rs, round(fwd_ret_5d, 9) AS fr FROM drawn)) GROUP BY date),
s AS (SELECT count(ic) AS dates, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t_stat FROM ic)""",
        "s", "dates", "mean_ic std_ic t_stat",
    )
    checks = [f"CASE WHEN {m} IS NULL THEN '{m}_missing' WHEN {m} {op} {t} THEN '{m}_{said}' END" for m, op, t, said in (
        ("total_oos_rows", "<", 1_000_000, "below_threshold"), ("fold_count", "<", 20, "below_threshold"), ("mean_daily_rank_ic", "<=", 0, "failed_positive_threshold"),
        ("rank_ic_t_stat", "<", 2, "below_threshold"), ("long_short_net_return", "<=", 0, "failed_positive_threshold"), ("top_decile_net_return", "<=", 0, "failed_positive_threshold"))]
    warned = [f"CASE WHEN {cond} THEN '{said}' END" for cond, said in (
        ("missing_rows > 0", "metrics_warning:missing_or_null_prediction_rows"), ("dates_below_buckets > 0", "metrics_warning:dates_with_too_few_names_for_deciles"), ("dates_below_quintiles > 0", "metrics_warning:dates_with_too_few_names_for_quintiles"),
        ("bottom_decile_net_short_return <= 0", "short_leg_net_return_non_positive"), ("greatest(abs(score_min), abs(score_max)) > 5", "extreme_prediction_score"),
        ("long_short_net_return > 0 AND long_short_net_return < 0.005", "long_short_net_return_positive_but_small"), ("mean_daily_rank_ic < 0.05", "mean_daily_rank_ic_below_0_05"))]
    given = out["negative_controls"]
    given = given[given.index("WITH ") + 5 : given.index("\nSELECT control")].replace(given[given.index(" UNION ALL SELECT 'random_202'") : given.index("), used AS")], "")
    out["research_gate"] = r(
        f"""{given},
extremes AS (SELECT control, min(score) AS score_min, max(score) AS score_max FROM used GROUP BY 1),
outlying AS (SELECT control, list(concat('metrics_warning:fold_', fold_id, '_score_outlier')) AS odd_folds FROM (SELECT control, fold_id FROM used GROUP BY ALL HAVING max(abs(score)) > 5) GROUP BY 1),
facts AS (SELECT control, rows AS total_oos_rows, folds AS fold_count, mean_ic AS mean_daily_rank_ic, ic_t_stat AS rank_ic_t_stat, net AS long_short_net_return, long_net AS top_decile_net_return, short_net AS bottom_decile_net_short_return, score_min, score_max,
  missing_rows, dates_below_buckets, dates_below_quintiles, coalesce(odd_folds, []) AS extreme FROM metrics LEFT JOIN extremes USING (control) LEFT JOIN outlying USING (control)),
told AS (SELECT *, list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL) AS f, list_sort(list_filter(list_concat([{', '.join(warned)}], extreme), lambda x: x IS NOT NULL)) AS w FROM facts),
verdicts AS (SELECT *, array_to_string(f, ';') AS failures, array_to_string(w, ';') AS warnings, CASE WHEN len(f) > 0 THEN 'FAIL' WHEN len(w) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status, len(f) = 0 AS passed,
  CASE WHEN len(f) > 0 THEN 'stop_and_inspect_pipeline_model_data' ELSE 'proceed_to_feature_expansion' END AS recommendation, CASE WHEN len(f) = 0 THEN 'feature_expansion' END AS next_stage FROM told)""",
        "verdicts", "control, total_oos_rows, fold_count, failures, warnings, status, passed, recommendation, next_stage", "mean_daily_rank_ic rank_ic_t_stat long_short_net_return top_decile_net_return bottom_decile_net_short_return score_min score_max",
    )
    for name, seed in ((n, s) for n in ("negative_controls", "research_gate") for s in (101, 202)):
        out[name] = out[name].replace(f"@{seed}@", f"round({normal(seed)}, 12)")
    out["plan_summary"] = f"WITH {Q.PLAN}, n AS (SELECT count(DISTINCT date) AS dates FROM labelled WHERE label_valid_5d) SELECT count(*) AS folds, min(train_start_date) AS first_train_date, max(test_end_date) AS last_test_date, sum(train_rows)::BIGINT AS train_rows, sum(test_rows)::BIGINT AS test_rows, any_value(dates) AS dates, CASE WHEN any_value(dates) < 568 THEN concat('insufficient_history: ', any_value(dates), ' of 568 dates') ELSE '' END AS warning FROM plan, n"
    out["lagged_control_ic"] = r(
        f"""{q}, used AS (SELECT date, score, round(fwd_ret_5d, 9) AS fr FROM (SELECT date, fwd_ret_5d, lag(score) OVER (PARTITION BY ticker ORDER BY date) AS score FROM preds) WHERE score IS NOT NULL AND fwd_ret_5d IS NOT NULL),
ic AS (SELECT date, count(*) AS names, {Q.pearson('s', 'r')} AS ic FROM (SELECT date, {Q.average_rank('score', 'date')} AS s, {Q.average_rank('fr', 'date')} AS r FROM used) GROUP BY date)""",
        "ic", "date, names", "ic",
    )
    ok = "coalesce(l.close >= 10 AND l.zero_volume_count_60 = 0 AND l.history_bars >= 252 AND l.median_dollar_volume_60 >= {}, false)"
    settled_ctes = q.replace("labelled AS (", "labelled AS MATERIALIZED (").replace("matrix AS (", "matrix AS MATERIALIZED (").replace("preds AS (", "preds AS MATERIALIZED (")
    out["momentum_signals"] = r(
        f"""{settled_ctes}, last AS MATERIALIZED (SELECT max(date) AS date FROM preds), newest AS (SELECT preds.* FROM preds JOIN last USING (date)), {Q.bucketed('newest')}, today AS (SELECT labelled.* FROM labelled JOIN last USING (date)),
found AS (SELECT b.*, l.close, l.median_dollar_volume_60, l.zero_volume_count_60, l.history_bars, CASE WHEN b.bucket = 10 THEN 'long' ELSE 'short' END AS side, {ok.format('25e6')} AS liquid_25m, {ok.format('50e6')} AS liquid_50m
  FROM bucketed b JOIN today l USING (date, ticker) WHERE b.bucket IN (1, 10))""",
        "found", "date, ticker, bucket, CAST(history_bars AS INTEGER) AS history_bars, side, liquid_25m, liquid_50m", "fwd_ret_5d score close median_dollar_volume_60 zero_volume_count_60",
    )
    out["raw_validation"], out["raw_gaps"] = Q.RAW_VALIDATION, Q.RAW_GAPS
    out |= {f"features_{n}": _sql_pick(Q.BASELINE, "matrix", c) for n, c in FAMILIES.items()}
    out |= {f"expanded_{n}": _sql_pick(Q.EXPANDED, "expanded", c) for n, c in EXPANDED_FAMILIES.items()}
    out["features_long_only"] = _sql_pick(Q.LONG_ONLY, "long_only", X.LONG_ONLY_NAMES)
    return out
