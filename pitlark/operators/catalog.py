"""The feature catalog: every feature's formula, by level (a level may use the columns of those before it).

Formulas take the kernel they run on (pitlark.functions.expr.SparkOps). Levels are emitted as one projection each, so
all windows of a panel share one exchange and one sort by (ticker, date).
"""

from __future__ import annotations

from collections.abc import Callable

Level = dict[str, Callable]


def _ret(w: int) -> Callable:
    return lambda o: o.div("close", o.lag("close", w)) - 1


def _over(x: str, f: str, w: int) -> Callable:
    return lambda o: getattr(o, f)(x, w)


def _dist(x: str) -> Callable:
    return lambda o: o.div("close", x) - 1


def _place(low: str, high: str) -> Callable:
    return lambda o: o.div(o.c("close") - o.c(low), o.c(high) - o.c(low))


def _ratio(a: str, b: str) -> Callable:
    return lambda o: o.div(a, b)


def _rsi(w: int) -> Callable:
    def f(o):
        g, l = o.rmean("_gain", w), o.rmean("_loss", w)
        return o.case((o.both(l == 0, g > 0), o.lit(100.0)), (l == 0, o.lit(50.0)), other=o.lit(100.0) - o.div(o.lit(100.0), o.lit(1.0) + o.div(g, l)))

    return f


BASELINE: list[Level] = [
    {
        "_prev": lambda o: o.lag("close", 1),
        **{f"ret_{w}d": _ret(w) for w in (1, 3, 5, 10, 20, 60)},
        "intraday_return": lambda o: o.div("close", "open") - 1,
        "range_pct": lambda o: o.div(o.c("high") - o.c("low"), "close"),
        "body_pct": lambda o: o.div(o.c("close") - o.c("open"), "close"),
        "upper_wick_pct": lambda o: o.div(o.c("high") - o.greatest("open", "close"), "close"),
        "lower_wick_pct": lambda o: o.div(o.least("open", "close") - o.c("low"), "close"),
        "close_position_in_day_range": _place("low", "high"),
        **{f"_sma_{w}": _over("close", "rmean", w) for w in (10, 20, 50, 200)},
        **{f"_high_{w}": _over("high", "rmax", w) for w in (20, 60, 252)},
        **{f"_low_{w}": _over("low", "rmin", w) for w in (20, 60, 252)},
        **{f"{v}_z_{w}d": _over(v, "zscore", w) for v in ("volume", "dollar_volume") for w in (20, 60)},
        **{f"{v}_ratio_5d_20d": lambda o, v=v: o.div(o.rmean(v, 5), o.rmean(v, 20)) for v in ("volume", "dollar_volume")},
        "day_of_week": lambda o: o.weekday("date"),
        "month": lambda o: o.month("date"),
    },
    {
        "gap_return": lambda o: o.div("open", "_prev") - 1,
        "true_range_pct": lambda o: o.div(o.case((o.c("_prev") == o.c("_prev"), o.greatest(o.c("high") - o.c("low"), o.abs(o.c("high") - o.c("_prev")), o.abs(o.c("low") - o.c("_prev"))))), "_prev"),
        **{f"realized_vol_{w}d": _over("ret_1d", "rstd", w) for w in (5, 10, 20, 60)},
        "range_z_20d": _over("range_pct", "zscore", 20),
        **{f"dist_sma_{w}d": _dist(f"_sma_{w}") for w in (10, 20, 50, 200)},
        **{f"sma_{w}d_slope": lambda o, w=w: o.div(f"_sma_{w}", o.lag(f"_sma_{w}", 5)) - 1 for w in (20, 50, 200)},
        **{f"dist_to_{w}d_{s}": _dist(f"_{s}_{w}") for w in (20, 60, 252) for s in ("high", "low")},
        **{f"drawdown_from_{w}d_high": _dist(f"_high_{w}") for w in (60, 252)},
        **{f"bounce_from_{w}d_low": _dist(f"_low_{w}") for w in (20, 60)},
        **{f"close_position_in_{w}d_range": _place(f"_low_{w}", f"_high_{w}") for w in (20, 60)},
        "_gain": lambda o: o.case((o.c("close") - o.c("_prev") > 0, o.c("close") - o.c("_prev")), other=o.lit(0.0)),
        "_loss": lambda o: o.case((o.c("_prev") - o.c("close") > 0, o.c("_prev") - o.c("close")), other=o.lit(0.0)),
    },
    {
        "atr_14_pct": _over("true_range_pct", "rmean", 14),
        "rsi_14": _rsi(14),
        "rsi_30": _rsi(30),
    },
]
BASELINE_RANKS = ["ret_20d", "rsi_14", "drawdown_from_60d_high", "dist_to_60d_low", "volume_z_20d", "dollar_volume_z_20d"]

EXPANDED: list[Level] = [
    {
        "bar": lambda o: o.bar(),
        **{f"ret_{w}d": _ret(w) for w in (2, 4, 15, 30, 120, 252)},
        **{f"log_ret_{w}d": lambda o, w=w: o.ln(o.div("close", o.lag("close", w))) for w in (1, 5, 20)},
        "ret_5d_z_60d": _over("ret_5d", "zscore", 60),
        "ret_20d_z_252d": _over("ret_20d", "zscore", 252),
        "reversal_5d_20d": lambda o: o.c("ret_5d") - o.c("ret_20d"),
        "momentum_20d_60d": lambda o: o.c("ret_20d") - o.c("ret_60d"),
        **{f"_xhigh_{w}": _over("high", "rmax", w) for w in (20, 120, 252)},
        **{f"_xlow_{w}": _over("low", "rmin", w) for w in (120, 252)},
        **{f"_xsma_{w}": _over("close", "rmean", w) for w in (10, 20, 50, 100, 200)},
        "_up": lambda o: o.flag(o.c("ret_1d") > 0),
        **{f"realized_vol_{w}d": _over("ret_1d", "rstd", w) for w in (120, 252)},
        "atr_14_z_252d": _over("atr_14_pct", "zscore", 252),
        "_down_ret": lambda o: o.case((o.c("ret_1d") < 0, "ret_1d"), other=o.lit(0.0)),
        "_up_ret": lambda o: o.case((o.c("ret_1d") > 0, "ret_1d"), other=o.lit(0.0)),
        **{f"{v}_z_120d": _over(v, "zscore", 120) for v in ("volume", "dollar_volume")},
        **{f"{v}_ratio_20d_60d": lambda o, v=v: o.div(o.rmean(v, 20), o.rmean(v, 60)) for v in ("volume", "dollar_volume")},
        "_flow": lambda o: o.c("ret_1d") * o.c("volume"),
        **{f"{n}_z_60d": _over(x, "zscore", 60) for n, x in (("lower_wick", "lower_wick_pct"), ("upper_wick", "upper_wick_pct"), ("body", "body_pct"), ("gap", "gap_return"))},
        "_large_down": lambda o: o.flag(o.c("ret_1d") < o.lit(-2.0) * o.c("realized_vol_20d")),
        "_large_up": lambda o: o.flag(o.c("ret_1d") > o.lit(2.0) * o.c("realized_vol_20d")),
        "vol_ratio_20d_60d": _ratio("realized_vol_20d", "realized_vol_60d"),
    },
    {
        **{f"drawdown_from_{w}d_high": _dist(f"_xhigh_{w}") for w in (20, 120)},
        **{f"bounce_from_{w}d_low": _dist(f"_xlow_{w}") for w in (120, 252)},
        **{f"close_position_in_{w}d_range": _place(f"_xlow_{w}", f"_xhigh_{w}") for w in (120, 252)},
        **{f"days_since_{w}d_{s}": lambda o, w=w, s=s: o.since(s, w, s == "high") for w in (20, 60) for s in ("low", "high")},
        "dist_sma_100d": _dist("_xsma_100"),
        **{f"sma_{w}d_slope": lambda o, w=w: o.div(f"_xsma_{w}", o.lag(f"_xsma_{w}", 5)) - 1 for w in (10, 100)},
        "sma_20_50_spread": lambda o: o.div("_xsma_20", "_xsma_50") - 1,
        "sma_50_200_spread": lambda o: o.div("_xsma_50", "_xsma_200") - 1,
        "trend_consistency_20d": _over("_up", "rmean", 20),
        "vol_ratio_20d_252d": _ratio("realized_vol_20d", "realized_vol_252d"),
        "downside_vol_20d": _over("_down_ret", "rstd", 20),
        "upside_vol_20d": _over("_up_ret", "rstd", 20),
        "price_volume_trend_20d": _over("_flow", "rsum", 20),
        "large_down_day_20d_count": _over("_large_down", "rsum", 20),
        "large_up_day_20d_count": _over("_large_up", "rsum", 20),
    },
    {"downside_upside_vol_ratio_20d": lambda o: o.case((o.c("upside_vol_20d") > 1e-9, o.div("downside_vol_20d", "upside_vol_20d")))},
]
EXPANDED_RANKS = ["ret_5d_z_60d", "ret_20d_z_252d", "drawdown_from_120d_high", "bounce_from_120d_low", "close_position_in_252d_range", "vol_ratio_20d_252d", "lower_wick_z_60d", "upper_wick_z_60d"]

LONG_ONLY: list[Level] = [
    {
        "mom_20d_vol_adj": _ratio("ret_20d", "realized_vol_20d"),
        "mom_60d_vol_adj": _ratio("ret_60d", "realized_vol_60d"),
        "_pos": lambda o: o.flag(o.c("ret_1d") > 0),
        "pullback_5d_vs_60d": lambda o: o.c("ret_5d") - o.c("ret_60d"),
        "vol_ratio_5d_20d": _ratio("realized_vol_5d", "realized_vol_20d"),
        "vol_ratio_20d_60d": _ratio("realized_vol_20d", "realized_vol_60d"),
        "atr14_to_vol20": _ratio("atr_14_pct", "realized_vol_20d"),
        "dollar_volume_ratio_20d_60d": lambda o: o.div(o.rmean("dollar_volume", 20), o.rmean("dollar_volume", 60)),
        "vol_ratio_10d_60d": _ratio("realized_vol_10d", "realized_vol_60d"),
        "range_compression_20d_60d": lambda o: o.div(o.rmean("true_range_pct", 20), o.rmean("true_range_pct", 60)),
        "sma_slope_agreement_20_50": lambda o: o.flag(o.c("sma_20d_slope") > 0) + o.flag(o.c("sma_50d_slope") > 0) - 1,
        "sma_stack_score_20_50_200": lambda o: o.flag(o.c("dist_sma_20d") > 0) + o.flag(o.c("dist_sma_50d") > 0) + o.flag(o.c("dist_sma_200d") > 0),
        "dollar_volume_accel_10d_60d": lambda o: o.div(o.rmean("dollar_volume", 10), o.rmean("dollar_volume", 60)),
    },
    {"trend_pos_ret_frac_20d": _over("_pos", "rmean", 20)},
]


def names(levels: list[Level]) -> list[str]:
    return [n for level in levels for n in level if n[0] != "_" and n != "bar"]
