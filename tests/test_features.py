"""Feature names against a written list, and values against hand-computed cases."""

import datetime as dt
import math

import pytest

from pitlark.operators import features as X

#: The configured feature names.
BASELINE = """ret_1d ret_3d ret_5d ret_10d ret_20d ret_60d gap_return intraday_return realized_vol_5d realized_vol_10d realized_vol_20d realized_vol_60d
true_range_pct atr_14_pct range_pct range_z_20d body_pct upper_wick_pct lower_wick_pct close_position_in_day_range dist_sma_10d dist_sma_20d dist_sma_50d
dist_sma_200d sma_20d_slope sma_50d_slope sma_200d_slope dist_to_20d_high dist_to_60d_high dist_to_252d_high dist_to_20d_low dist_to_60d_low dist_to_252d_low
drawdown_from_60d_high drawdown_from_252d_high bounce_from_20d_low bounce_from_60d_low rsi_14 rsi_30 close_position_in_20d_range close_position_in_60d_range
volume_z_20d volume_z_60d dollar_volume_z_20d dollar_volume_z_60d volume_ratio_5d_20d dollar_volume_ratio_5d_20d day_of_week month
rank_ret_20d rank_rsi_14 rank_drawdown_from_60d_high rank_dist_to_60d_low rank_volume_z_20d rank_dollar_volume_z_20d""".split()
EXPANDED = """ret_2d ret_4d ret_15d ret_30d ret_120d ret_252d log_ret_1d log_ret_5d log_ret_20d ret_5d_z_60d ret_20d_z_252d reversal_5d_20d momentum_20d_60d
drawdown_from_20d_high drawdown_from_120d_high bounce_from_120d_low bounce_from_252d_low close_position_in_120d_range close_position_in_252d_range
days_since_20d_low days_since_60d_low days_since_20d_high days_since_60d_high dist_sma_100d sma_10d_slope sma_100d_slope sma_20_50_spread sma_50_200_spread
trend_consistency_20d realized_vol_120d realized_vol_252d vol_ratio_20d_60d vol_ratio_20d_252d atr_14_z_252d downside_vol_20d upside_vol_20d
downside_upside_vol_ratio_20d volume_z_120d dollar_volume_z_120d volume_ratio_20d_60d dollar_volume_ratio_20d_60d price_volume_trend_20d lower_wick_z_60d
upper_wick_z_60d body_z_60d gap_z_60d large_down_day_20d_count large_up_day_20d_count rank_ret_5d_z_60d rank_ret_20d_z_252d rank_drawdown_from_120d_high
rank_bounce_from_120d_low rank_close_position_in_252d_range rank_vol_ratio_20d_252d rank_lower_wick_z_60d rank_upper_wick_z_60d""".split()
LONG_ONLY = """mom_20d_vol_adj mom_60d_vol_adj trend_pos_ret_frac_20d pullback_5d_vs_60d vol_ratio_5d_20d vol_ratio_20d_60d atr14_to_vol20 dollar_volume_ratio_20d_60d
vol_ratio_10d_60d range_compression_20d_60d sma_slope_agreement_20_50 sma_stack_score_20_50_200 dollar_volume_accel_10d_60d vol_regime_rank_by_date""".split()


def test_names():
    assert sorted(X.BASELINE_NAMES) == sorted(BASELINE) and len(BASELINE) == 55
    assert sorted(X.EXPANDED_NAMES) == sorted(EXPANDED) and len(EXPANDED) == 56
    assert sorted(X.LONG_ONLY_NAMES) == sorted(LONG_ONLY)


@pytest.fixture(scope="module")
def panel(spark):
    """Two names, 300 business days, closes rising by 1 from 10 and from 1010."""
    days, d = [], dt.date(2010, 1, 1)
    while len(days) < 300:
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(1)
    rows = [(d, t, c - 0.5, c + 1.0, c - 1.0, float(c), 1000 + i, float(c * (1000 + i)), True, 0.01, 0) for t, base in (("A", 10), ("B", 1010)) for i, d in enumerate(days) for c in [base + i]]
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume long, dollar_volume double, label_valid_5d boolean, fwd_ret_5d double, target_class_5d int")


def test_baseline_by_hand(panel):
    rows = {(r["ticker"], i): r for t in "AB" for i, r in enumerate(sorted((r for r in X.baseline(panel).collect() if r["ticker"] == t), key=lambda r: r["date"]))}
    a = rows["A", 60]
    assert a["ret_1d"] == pytest.approx(70 / 69 - 1) and a["ret_60d"] == pytest.approx(70 / 10 - 1) and rows["A", 59]["ret_60d"] is None
    assert a["gap_return"] == pytest.approx(69.5 / 69 - 1) and a["intraday_return"] == pytest.approx(70 / 69.5 - 1)
    assert a["true_range_pct"] == pytest.approx(2 / 69) and rows["A", 0]["true_range_pct"] is None
    assert a["close_position_in_day_range"] == 0.5 and a["rsi_14"] == 100 and rows["A", 12]["rsi_14"] is None and rows["A", 13]["rsi_14"] == 100
    assert a["dist_sma_10d"] == pytest.approx(70 / 65.5 - 1) and a["dist_to_20d_high"] == pytest.approx(70 / 71 - 1) and a["dist_to_20d_low"] == pytest.approx(70 / 50 - 1)
    returns = [(10 + i) / (9 + i) - 1 for i in range(56, 61)]
    mean = sum(returns) / 5
    assert a["realized_vol_5d"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in returns) / 5))
    assert rows["A", 251]["dist_to_252d_high"] is not None and rows["A", 250]["dist_to_252d_high"] is None
    assert a["rank_ret_20d"] == 1.0 and rows["B", 60]["rank_ret_20d"] == 0.5 and a["rank_rsi_14"] == 0.75  # a tie of two


def test_expanded_by_hand(panel):
    rows = sorted((r for r in X.expanded(X.baseline(panel)).collect() if r["ticker"] == "A"), key=lambda r: r["date"])
    a = rows[260]
    assert a["log_ret_5d"] == pytest.approx(math.log(270 / 265)) and a["reversal_5d_20d"] == pytest.approx(270 / 265 - 270 / 250)
    assert a["days_since_20d_high"] == 0 and a["days_since_20d_low"] == 19 and a["trend_consistency_20d"] == 1 and rows[19]["trend_consistency_20d"] is None
    assert a["upside_vol_20d"] > 0 and a["downside_vol_20d"] == 0 and a["large_down_day_20d_count"] == 0
    assert a["rank_drawdown_from_120d_high"] == 0.5 and a["rank_bounce_from_120d_low"] == 1.0
