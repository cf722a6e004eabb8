"""Independent SQL (DuckDB) for the registered queries, written out by hand; nothing of the engine's catalog is used."""

from __future__ import annotations

T = "PARTITION BY ticker ORDER BY date"


def rolling(f: str, x: str, w: int) -> str:
    """f over the last w rows, null unless all w have a value."""
    frame = f"OVER ({T} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {w} THEN {f}({x}) {frame} END"


def zscore(x: str, w: int) -> str:
    sd = f"({rolling('stddev_pop', x, w)})"
    return f"CASE WHEN {sd} > 1e-9 THEN ({x} - ({rolling('avg', x, w)})) / {sd} END"


KEY = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
ROLL = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
BARS = f"""trades AS (SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS ticker, CAST(l_shipdate AS DATE) AS date, 1000 + l_extendedprice / 100 AS px, * FROM lineitem),
bars AS (SELECT ticker, date, first(px ORDER BY {KEY}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {KEY}) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
         FROM trades WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2)"""


def _guard(f: str, w: int) -> str:
    frame = ROLL.format(w - 1)
    return f"CASE WHEN count(*) {frame} >= {w} THEN {f} {frame} END"


GATED = f"""{BARS},
dollars AS (SELECT *, close * volume AS dollar_volume, CAST(volume = 0 AS DOUBLE) AS zero FROM bars),
rolled AS (SELECT * EXCLUDE (zero), row_number() OVER ({T}) - 1 AS history_bars, {_guard('median(dollar_volume)', 20)} AS median_dollar_volume_20,
  {_guard('median(dollar_volume)', 60)} AS median_dollar_volume_60, {_guard('sum(zero)', 20)} AS zero_volume_count_20, {_guard('sum(zero)', 60)} AS zero_volume_count_60 FROM dollars),
gated AS (SELECT *, coalesce(history_bars >= 252 AND close >= 5 AND median_dollar_volume_20 >= 1e4 AND zero_volume_count_20 = 0, false) AS tradable FROM rolled),
universe AS (SELECT *, date >= DATE '1997-01-01' AND tradable AS model_eligible FROM gated WHERE date >= DATE '1995-01-01')"""


def _classes(source: str, value: str, valid: str, out: str) -> str:
    by = f"PARTITION BY date, {valid}"
    return f"""(SELECT * EXCLUDE (rn, n), CASE WHEN NOT {valid} OR n < 5 OR floor(n * 0.2) < 1 THEN 0 WHEN rn > n - floor(n * 0.2) THEN 1 WHEN rn <= floor(n * 0.2) THEN -1 ELSE 0 END::INTEGER AS {out}
  FROM (SELECT *, row_number() OVER ({by} ORDER BY round({value}, 9) NULLS FIRST, ticker) AS rn, count(*) OVER ({by}) AS n FROM {source}))"""


LABELLED = f"""{GATED},
flagged AS (SELECT *, coalesce(open / nullif(lag(close) OVER ({T}), 0) <= 0.55 OR open / nullif(lag(close) OVER ({T}), 0) >= 1.8, false) AS split_gap FROM universe),
ahead AS (SELECT *, lead(open) OVER ({T}) AS next_open, lead(close, 5) OVER ({T}) AS exit_close_5d, lead(date, 5) OVER ({T}) AS exit_date_5d,
  coalesce(bool_or(split_gap) OVER ({T} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS split_gap_in_window FROM flagged),
returned AS (SELECT *, exit_close_5d / nullif(next_open, 0) - 1 AS fwd_ret_5d, date < DATE '1997-01-01' AS pre_research, NOT model_eligible AS not_eligible, false AS is_excluded FROM ahead),
judged AS (SELECT *, fwd_ret_5d IS NULL AS missing_future, NOT (pre_research OR not_eligible OR fwd_ret_5d IS NULL OR split_gap_in_window) AS label_valid_5d FROM returned),
labelled AS {_classes('judged', 'fwd_ret_5d', 'label_valid_5d', 'target_class_5d')}"""


def average_rank(x: str, by: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + count({x}) OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 END)"


def ranks(source: str, name: str, columns: list[str]) -> str:
    inner = ", ".join(f'round("{c}", 9) AS "_r_{c}"' for c in columns)
    made = ", ".join(f'{average_rank(chr(34) + "_r_" + c + chr(34), "date")} / count("_r_{c}") OVER (PARTITION BY date) AS "rank_{c}"' for c in columns)
    return f"{name} AS (SELECT *, {made} FROM (SELECT *, {inner} FROM {source}))"


RETURNS = ", ".join(f"close / nullif(lag(close, {w}) OVER ({T}), 0) - 1 AS ret_{w}d" for w in (1, 3, 5, 10, 20, 60))
BASELINE = f"""{LABELLED},
base_1 AS (SELECT *, lag(close) OVER ({T}) AS pc, {RETURNS}, close / nullif(open, 0) - 1 AS intraday_return,
  (high - low) / nullif(close, 0) AS range_pct, (close - open) / nullif(close, 0) AS body_pct,
  (high - greatest(open, close)) / nullif(close, 0) AS upper_wick_pct, (least(open, close) - low) / nullif(close, 0) AS lower_wick_pct, (close - low) / nullif(high - low, 0) AS close_position_in_day_range,
  {rolling("avg", "close", 10)} AS s10, {rolling("avg", "close", 20)} AS s20, {rolling("avg", "close", 50)} AS s50, {rolling("avg", "close", 200)} AS s200,
  {rolling("max", "high", 20)} AS h20, {rolling("max", "high", 60)} AS h60, {rolling("max", "high", 252)} AS h252, {rolling("min", "low", 20)} AS l20, {rolling("min", "low", 60)} AS l60, {rolling("min", "low", 252)} AS l252,
  {zscore("volume", 20)} AS volume_z_20d, {zscore("volume", 60)} AS volume_z_60d, {zscore("dollar_volume", 20)} AS dollar_volume_z_20d, {zscore("dollar_volume", 60)} AS dollar_volume_z_60d,
  ({rolling("avg", "volume", 5)}) / nullif({rolling("avg", "volume", 20)}, 0) AS volume_ratio_5d_20d, ({rolling("avg", "dollar_volume", 5)}) / nullif({rolling("avg", "dollar_volume", 20)}, 0) AS dollar_volume_ratio_5d_20d,
  (isodow(date) - 1)::INTEGER AS day_of_week, month(date)::INTEGER AS month FROM labelled),
base_2 AS (SELECT *, open / nullif(pc, 0) - 1 AS gap_return, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) / nullif(pc, 0) END AS true_range_pct,
  {rolling("stddev_pop", "ret_1d", 5)} AS realized_vol_5d, {rolling("stddev_pop", "ret_1d", 10)} AS realized_vol_10d, {rolling("stddev_pop", "ret_1d", 20)} AS realized_vol_20d, {rolling("stddev_pop", "ret_1d", 60)} AS realized_vol_60d,
  {zscore("range_pct", 20)} AS range_z_20d, close / nullif(s10, 0) - 1 AS dist_sma_10d, close / nullif(s20, 0) - 1 AS dist_sma_20d, close / nullif(s50, 0) - 1 AS dist_sma_50d, close / nullif(s200, 0) - 1 AS dist_sma_200d,
  s20 / nullif(lag(s20, 5) OVER ({T}), 0) - 1 AS sma_20d_slope, s50 / nullif(lag(s50, 5) OVER ({T}), 0) - 1 AS sma_50d_slope, s200 / nullif(lag(s200, 5) OVER ({T}), 0) - 1 AS sma_200d_slope,
  close / nullif(h20, 0) - 1 AS dist_to_20d_high, close / nullif(h60, 0) - 1 AS dist_to_60d_high, close / nullif(h252, 0) - 1 AS dist_to_252d_high,
  close / nullif(l20, 0) - 1 AS dist_to_20d_low, close / nullif(l60, 0) - 1 AS dist_to_60d_low, close / nullif(l252, 0) - 1 AS dist_to_252d_low,
  close / nullif(h60, 0) - 1 AS drawdown_from_60d_high, close / nullif(h252, 0) - 1 AS drawdown_from_252d_high, close / nullif(l20, 0) - 1 AS bounce_from_20d_low, close / nullif(l60, 0) - 1 AS bounce_from_60d_low,
  (close - l20) / nullif(h20 - l20, 0) AS close_position_in_20d_range, (close - l60) / nullif(h60 - l60, 0) AS close_position_in_60d_range,
  CASE WHEN close - pc > 0 THEN close - pc ELSE 0 END AS gain, CASE WHEN pc - close > 0 THEN pc - close ELSE 0 END AS loss FROM base_1),
base_3 AS (SELECT *, {rolling("avg", "true_range_pct", 14)} AS atr_14_pct, {rolling("avg", "gain", 14)} AS g14, {rolling("avg", "loss", 14)} AS o14, {rolling("avg", "gain", 30)} AS g30, {rolling("avg", "loss", 30)} AS o30 FROM base_2),
base AS (SELECT *, CASE WHEN o14 = 0 AND g14 > 0 THEN 100 WHEN o14 = 0 THEN 50 ELSE 100 - 100 / (1 + g14 / o14) END AS rsi_14, CASE WHEN o30 = 0 AND g30 > 0 THEN 100 WHEN o30 = 0 THEN 50 ELSE 100 - 100 / (1 + g30 / o30) END AS rsi_30 FROM base_3),
{ranks("base", "ranked", ["ret_20d", "rsi_14", "drawdown_from_60d_high", "dist_to_60d_low", "volume_z_20d", "dollar_volume_z_20d"])},
matrix AS (SELECT * FROM ranked WHERE label_valid_5d)"""


def _since(x: str, w: int, newest_of: str) -> str:
    frame = f"OVER ({T} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"bar - arg_max(bar, {{'a': {newest_of}{x}, 'b': bar}}) {frame}"


#: Over the label-valid rows only: windows count those.
EXPANDED = f"""{BASELINE},
exp_1 AS (SELECT *, row_number() OVER ({T}) AS bar, {", ".join(f"close / nullif(lag(close, {w}) OVER ({T}), 0) - 1 AS ret_{w}d" for w in (2, 4, 15, 30, 120, 252))},
  {", ".join(f"ln(close / nullif(lag(close, {w}) OVER ({T}), 0)) AS log_ret_{w}d" for w in (1, 5, 20))},
  {zscore("ret_5d", 60)} AS ret_5d_z_60d, {zscore("ret_20d", 252)} AS ret_20d_z_252d, ret_5d - ret_20d AS reversal_5d_20d, ret_20d - ret_60d AS momentum_20d_60d,
  {rolling("max", "high", 20)} AS xh20, {rolling("max", "high", 120)} AS xh120, {rolling("max", "high", 252)} AS xh252, {rolling("min", "low", 120)} AS xl120, {rolling("min", "low", 252)} AS xl252,
  {rolling("avg", "close", 10)} AS x10, {rolling("avg", "close", 20)} AS x20, {rolling("avg", "close", 50)} AS x50, {rolling("avg", "close", 100)} AS x100, {rolling("avg", "close", 200)} AS x200,
  (ret_1d > 0)::DOUBLE AS up, {rolling("stddev_pop", "ret_1d", 120)} AS realized_vol_120d, {rolling("stddev_pop", "ret_1d", 252)} AS realized_vol_252d, {zscore("atr_14_pct", 252)} AS atr_14_z_252d,
  CASE WHEN ret_1d < 0 THEN ret_1d ELSE 0 END AS down_ret, CASE WHEN ret_1d > 0 THEN ret_1d ELSE 0 END AS up_ret, {zscore("volume", 120)} AS volume_z_120d, {zscore("dollar_volume", 120)} AS dollar_volume_z_120d,
  ({rolling("avg", "volume", 20)}) / nullif({rolling("avg", "volume", 60)}, 0) AS volume_ratio_20d_60d, ({rolling("avg", "dollar_volume", 20)}) / nullif({rolling("avg", "dollar_volume", 60)}, 0) AS dollar_volume_ratio_20d_60d,
  ret_1d * volume AS flow, {zscore("lower_wick_pct", 60)} AS lower_wick_z_60d, {zscore("upper_wick_pct", 60)} AS upper_wick_z_60d, {zscore("body_pct", 60)} AS body_z_60d, {zscore("gap_return", 60)} AS gap_z_60d,
  (ret_1d < -2 * realized_vol_20d)::DOUBLE AS big_down, (ret_1d > 2 * realized_vol_20d)::DOUBLE AS big_up, realized_vol_20d / nullif(realized_vol_60d, 0) AS vol_ratio_20d_60d FROM matrix),
exp_2 AS (SELECT *, close / nullif(xh20, 0) - 1 AS drawdown_from_20d_high, close / nullif(xh120, 0) - 1 AS drawdown_from_120d_high, close / nullif(xl120, 0) - 1 AS bounce_from_120d_low, close / nullif(xl252, 0) - 1 AS bounce_from_252d_low,
  (close - xl120) / nullif(xh120 - xl120, 0) AS close_position_in_120d_range, (close - xl252) / nullif(xh252 - xl252, 0) AS close_position_in_252d_range,
  {_since("low", 20, "-")} AS days_since_20d_low, {_since("low", 60, "-")} AS days_since_60d_low, {_since("high", 20, "")} AS days_since_20d_high, {_since("high", 60, "")} AS days_since_60d_high,
  close / nullif(x100, 0) - 1 AS dist_sma_100d, x10 / nullif(lag(x10, 5) OVER ({T}), 0) - 1 AS sma_10d_slope, x100 / nullif(lag(x100, 5) OVER ({T}), 0) - 1 AS sma_100d_slope, x20 / nullif(x50, 0) - 1 AS sma_20_50_spread, x50 / nullif(x200, 0) - 1 AS sma_50_200_spread,
  {rolling("avg", "up", 20)} AS trend_consistency_20d, realized_vol_20d / nullif(realized_vol_252d, 0) AS vol_ratio_20d_252d, {rolling("stddev_pop", "down_ret", 20)} AS downside_vol_20d, {rolling("stddev_pop", "up_ret", 20)} AS upside_vol_20d,
  {rolling("sum", "flow", 20)} AS price_volume_trend_20d, {rolling("sum", "big_down", 20)} AS large_down_day_20d_count, {rolling("sum", "big_up", 20)} AS large_up_day_20d_count FROM exp_1),
exp_3 AS (SELECT *, CASE WHEN upside_vol_20d > 1e-9 THEN downside_vol_20d / upside_vol_20d END AS downside_upside_vol_ratio_20d FROM exp_2),
{ranks("exp_3", "expanded", ["ret_5d_z_60d", "ret_20d_z_252d", "drawdown_from_120d_high", "bounce_from_120d_low", "close_position_in_252d_range", "vol_ratio_20d_252d", "lower_wick_z_60d", "upper_wick_z_60d"])}"""
#: Over the whole labelled panel, then the label-valid rows.
LONG_ONLY = f"""{BASELINE},
long_1 AS (SELECT *, ret_20d / nullif(realized_vol_20d, 0) AS mom_20d_vol_adj, ret_60d / nullif(realized_vol_60d, 0) AS mom_60d_vol_adj, (ret_1d > 0)::DOUBLE AS pos, ret_5d - ret_60d AS pullback_5d_vs_60d,
  realized_vol_5d / nullif(realized_vol_20d, 0) AS vol_ratio_5d_20d, realized_vol_20d / nullif(realized_vol_60d, 0) AS vol_ratio_20d_60d, atr_14_pct / nullif(realized_vol_20d, 0) AS atr14_to_vol20,
  ({rolling("avg", "dollar_volume", 20)}) / nullif({rolling("avg", "dollar_volume", 60)}, 0) AS dollar_volume_ratio_20d_60d, realized_vol_10d / nullif(realized_vol_60d, 0) AS vol_ratio_10d_60d,
  ({rolling("avg", "true_range_pct", 20)}) / nullif({rolling("avg", "true_range_pct", 60)}, 0) AS range_compression_20d_60d, (sma_20d_slope > 0)::DOUBLE + (sma_50d_slope > 0)::DOUBLE - 1 AS sma_slope_agreement_20_50,
  (dist_sma_20d > 0)::DOUBLE + (dist_sma_50d > 0)::DOUBLE + (dist_sma_200d > 0)::DOUBLE AS sma_stack_score_20_50_200, ({rolling("avg", "dollar_volume", 10)}) / nullif({rolling("avg", "dollar_volume", 60)}, 0) AS dollar_volume_accel_10d_60d FROM ranked),
long_2 AS (SELECT *, {rolling("avg", "pos", 20)} AS trend_pos_ret_frac_20d, round(realized_vol_20d, 9) AS rv FROM long_1),
long_only AS (SELECT * FROM (SELECT *, {average_rank('rv', 'date')} / count(*) OVER (PARTITION BY date) AS vol_regime_rank_by_date FROM long_2) WHERE label_valid_5d)"""
PREDS = f"{BASELINE},\npreds AS (SELECT date, ticker, fwd_ret_5d, round(ret_20d, 9) AS score FROM matrix WHERE ret_20d IS NOT NULL)"


def bucketed(source: str, by: str = "date") -> str:
    return f"bucketed AS (SELECT *, CAST(least(greatest(floor((row_number() OVER (PARTITION BY {by} ORDER BY score, ticker) - 1) * 10.0 / count(*) OVER (PARTITION BY {by})) + 1, 1), 10) AS INTEGER) AS bucket FROM {source})"


LONG_SHORT = f"""{PREDS},
{bucketed('preds')},
legs AS (SELECT date, count(*) FILTER (bucket = 10) AS long_count, count(*) FILTER (bucket = 1) AS short_count, avg(fwd_ret_5d) FILTER (bucket = 10) AS long_gross, avg(-fwd_ret_5d) FILTER (bucket = 1) AS short_gross,
  avg(CAST(fwd_ret_5d > 0 AS DOUBLE)) FILTER (bucket = 10) AS long_hit_rate, avg(CAST(-fwd_ret_5d > 0 AS DOUBLE)) FILTER (bucket = 1) AS short_hit_rate FROM bucketed GROUP BY date),
long_short AS (SELECT *, long_gross - 0.0025 AS long_net, short_gross - 0.0025 AS short_net, 0.5 * long_gross + 0.5 * short_gross AS gross, 0.5 * (long_gross - 0.0025) + 0.5 * (short_gross - 0.0025) AS net FROM legs WHERE long_count > 0 AND short_count > 0)"""


def pearson(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / CASE WHEN stddev_pop({x}) FILTER ({y} IS NOT NULL) * stddev_pop({y}) FILTER ({x} IS NOT NULL) > 1e-12 THEN stddev_pop({x}) FILTER ({y} IS NOT NULL) * stddev_pop({y}) FILTER ({x} IS NOT NULL) END"


IC = f"""{PREDS},
ic AS (SELECT date, count(*) AS names, {pearson('s', 'r')} AS ic FROM (SELECT date, {average_rank('score', 'date')} AS s, {average_rank('fr', 'date')} AS r FROM (SELECT *, round(fwd_ret_5d, 9) AS fr FROM preds WHERE fwd_ret_5d IS NOT NULL)) GROUP BY date)"""
PLAN = f"""{LABELLED},
days AS (SELECT date, count(*) AS n, row_number() OVER (ORDER BY date) - 1 AS i FROM labelled WHERE label_valid_5d GROUP BY date),
folds AS (SELECT t, ((t - 505) / 63 + 1)::INTEGER AS fold_id FROM (SELECT unnest(range(505, (SELECT max(i) FROM days) - 63 + 2, 63)) AS t)),
plan AS (SELECT fold_id, max(CASE WHEN i = t - 505 THEN date END) AS train_start_date, max(CASE WHEN i = t - 6 THEN date END) AS train_end_date, max(CASE WHEN i = t THEN date END) AS test_start_date, max(CASE WHEN i = t + 62 THEN date END) AS test_end_date,
  CAST(sum(CASE WHEN i <= t - 6 THEN n ELSE 0 END) AS BIGINT) AS train_rows, CAST(sum(CASE WHEN i >= t THEN n ELSE 0 END) AS BIGINT) AS test_rows FROM folds JOIN days ON i BETWEEN t - 505 AND t + 62 GROUP BY fold_id)"""


def metric_parts(key: str) -> str:
    """CTEs over used(key, date, ticker, fwd_ret_5d, score): correlations, legs."""
    by = f"{key}, date"
    return f"""ic AS (SELECT {by}, {pearson('s', 'r')} AS ic FROM (SELECT {by}, {average_rank('score', by)} AS s, {average_rank('fr', by)} AS r FROM (SELECT *, round(fwd_ret_5d, 9) AS fr FROM used)) GROUP BY {by}),
ics AS (SELECT {key}, avg(ic) AS mean_ic, CASE WHEN count(ic) > 1 THEN avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) END AS ic_t_stat FROM ic GROUP BY 1),
{bucketed('used', by)},
legs AS (SELECT {by}, avg(fwd_ret_5d) FILTER (bucket = 10) AS long_gross, avg(-fwd_ret_5d) FILTER (bucket = 1) AS short_gross, avg(CAST(fwd_ret_5d > 0 AS DOUBLE)) FILTER (bucket = 10) AS long_hit_rate, avg(CAST(-fwd_ret_5d > 0 AS DOUBLE)) FILTER (bucket = 1) AS short_hit_rate
  FROM bucketed GROUP BY {by} HAVING count(*) FILTER (bucket = 10) > 0 AND count(*) FILTER (bucket = 1) > 0),
portfolio AS (SELECT {key}, avg(long_gross) AS long_gross, avg(long_gross) - 0.0025 AS long_net, avg(short_gross) AS short_gross, avg(short_gross) - 0.0025 AS short_net, avg(long_gross + short_gross) / 2 AS gross, avg(long_gross + short_gross) / 2 - 0.0025 AS net,
  avg(long_hit_rate) AS long_hit_rate, avg(short_hit_rate) AS short_hit_rate FROM legs GROUP BY 1)"""


FOLD_METRICS = """fold_metrics AS (SELECT fold_id, count(*) AS rows, avg(score) AS score_mean, stddev_pop(score) AS score_std, min(score) AS score_min, max(score) AS score_max, greatest(abs(min(score)), abs(max(score))) > 5 AS score_outlier,
  any_value(mean_ic) AS mean_rank_ic, any_value(gross) AS gross, any_value(net) AS net FROM used LEFT JOIN ics USING (fold_id) LEFT JOIN portfolio USING (fold_id) GROUP BY 1)"""


def metrics(key: str) -> str:
    by = f"{key}, date"
    changed = lambda source: f"SELECT a.{key}, a.date, avg(CAST(b.ticker IS NULL AS DOUBLE)) AS t FROM {source} a LEFT JOIN {source} b ON a.{key} = b.{key} AND a.ticker = b.ticker AND b.k = a.k - 1 WHERE a.k > 1 GROUP BY 1, 2"
    return f"""best AS (SELECT *, dense_rank() OVER (PARTITION BY {key} ORDER BY date) AS k FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, ticker) AS rn FROM used) WHERE rn <= 20),
decile AS (SELECT *, dense_rank() OVER (PARTITION BY {key} ORDER BY date) AS k FROM bucketed WHERE bucket = 10),
top_days AS (SELECT {key}, count(*) AS top_days, avg(n) AS top_names, avg(r) AS top_gross, avg(r) - 0.0025 AS top_net FROM (SELECT {by}, count(*) AS n, avg(fwd_ret_5d) AS r FROM best GROUP BY {by}) GROUP BY 1),
top_change AS (SELECT {key}, avg(t) AS top_turnover FROM ({changed('best')}) GROUP BY 1),
decile_change AS (SELECT {key}, avg(t) AS decile_turnover FROM ({changed('decile')}) GROUP BY 1),
few AS (SELECT {key}, count(*) FILTER (n < 10) AS dates_below_buckets, count(*) FILTER (n < 5) AS dates_below_quintiles FROM (SELECT {by}, count(*) AS n FROM used GROUP BY {by}) GROUP BY 1),
held AS (SELECT {key}, count(*) AS rows, count(DISTINCT fold_id) AS folds, min(date) AS min_date, max(date) AS max_date FROM used GROUP BY 1),
lost AS (SELECT {key}, count(*) FILTER (score IS NULL OR fwd_ret_5d IS NULL) AS missing_rows FROM given GROUP BY 1),
metrics AS (SELECT * REPLACE (coalesce(rows, 0) AS rows, coalesce(folds, 0) AS folds, coalesce(dates_below_buckets, 0) AS dates_below_buckets, coalesce(dates_below_quintiles, 0) AS dates_below_quintiles, coalesce(top_days, 0) AS top_days) FROM lost LEFT JOIN held USING ({key}) LEFT JOIN few USING ({key}) LEFT JOIN ics USING ({key}) LEFT JOIN portfolio USING ({key}) LEFT JOIN top_days USING ({key}) LEFT JOIN top_change USING ({key}) LEFT JOIN decile_change USING ({key}))"""


# Audits over text: the SQL writes the same text and judges it by its own rules.
def _faulty(rules: dict[str, str]) -> str:
    return ", ".join(f"count(*) FILTER (coalesce({rule}, false)) AS {name}" for name, rule in rules.items())


def _day(c: str) -> str:
    return f"try_strptime(nullif(trim({c}), ''), '%Y-%m-%d')"


def _blank(c: str) -> str:
    return f"coalesce(trim({c}), '') = ''"


RAW_JUDGED = f"""WITH {BARS},
numbered AS (SELECT *, day(date) AS k, strftime(date, '%Y%m%d') AS told FROM bars),
once AS (SELECT k, concat(ticker, '.US') AS ticker, concat(lower(ticker), '.us.txt') AS source_file, CASE k WHEN 3 THEN 'X' ELSE 'D' END AS per, CASE k WHEN 11 THEN '20201399' ELSE told END AS date, CASE k WHEN 4 THEN '123000' WHEN 5 THEN '0' ELSE '000000' END AS time,
  CASE k WHEN 12 THEN 'q' ELSE CAST(open AS VARCHAR) END AS open, CASE k WHEN 8 THEN '0.5' ELSE CAST(high AS VARCHAR) END AS high, CASE k WHEN 14 THEN '-1' ELSE CAST(low AS VARCHAR) END AS low, CAST(close AS VARCHAR) AS close,
  CASE k WHEN 6 THEN '-1' WHEN 7 THEN 'n/a' ELSE CAST(volume AS VARCHAR) END AS vol, CASE k WHEN 9 THEN 'abc' ELSE '0' END AS openint FROM numbered),
raw AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE k = 10),
typed AS (SELECT *, regexp_replace(upper(trim(ticker)), '[.]US$', '') AS p_ticker, CASE WHEN regexp_full_match(date, '\\s*\\d{{8}}\\s*') THEN try_strptime(trim(date), '%Y%m%d') END AS p_date, regexp_replace(trim(coalesce(time, '')), '[.]0$', '') AS t,
  TRY_CAST(trim(open) AS DOUBLE) AS o, TRY_CAST(trim(high) AS DOUBLE) AS h, TRY_CAST(trim(low) AS DOUBLE) AS l, TRY_CAST(trim(close) AS DOUBLE) AS c, TRY_CAST(trim(vol) AS DOUBLE) AS v, TRY_CAST(trim(openint) AS DOUBLE) AS i FROM raw),
judged AS (SELECT *, list_filter([CASE WHEN upper(trim(per)) <> 'D' THEN 'bad_per' END, CASE WHEN lpad(t, greatest(6, length(t))::INTEGER, '0') <> '000000' THEN 'bad_time' END, CASE WHEN p_date IS NULL THEN 'bad_date' END,
  CASE WHEN o IS NULL OR h IS NULL OR l IS NULL OR c IS NULL THEN 'bad_numeric_ohlc' END, CASE WHEN v IS NULL THEN 'bad_numeric_volume' END, CASE WHEN o <= 0 OR h <= 0 OR l <= 0 OR c <= 0 THEN 'bad_ohlc_positive' END, CASE WHEN v < 0 THEN 'bad_volume_negative' END,
  CASE WHEN o IS NULL OR h IS NULL OR l IS NULL OR c IS NULL OR h < o OR h < l OR h < c OR l > o OR l > h OR l > c THEN 'bad_ohlc_consistency' END,
  CASE WHEN p_date IS NOT NULL AND count(*) OVER (PARTITION BY source_file, p_ticker, p_date) > 1 THEN 'duplicate_ticker_date' END, CASE WHEN i IS NULL THEN 'bad_numeric_openint' END], lambda x: x IS NOT NULL) AS reasons FROM typed)"""
RAW_VALIDATION = f"{RAW_JUDGED} SELECT reason, count(*) AS rows, count(DISTINCT date) AS distinct_dates FROM (SELECT date, unnest(reasons) AS reason FROM judged) GROUP BY 1"
RAW_GAPS = f"""{RAW_JUDGED}, followed AS (SELECT source_file, p_ticker AS ticker, CAST(p_date AS DATE) AS date, o AS open, lag(c) OVER (PARTITION BY source_file, p_ticker ORDER BY p_date) AS prev_close FROM judged WHERE len(reasons) = 0)
SELECT source_file, ticker, date, round(prev_close, 6) + 0.0 AS prev_close, round(open, 6) + 0.0 AS open, round((open / nullif(prev_close, 0) - 1) * 100, 6) + 0.0 AS gap_pct FROM followed WHERE open / nullif(prev_close, 0) <= 0.55 OR open / nullif(prev_close, 0) >= 1.8"""


def master_audit(columns: list[str], days: list[str], flags: list[str], may_be_empty: list[str], words: list[str]) -> str:
    required = [c for c in columns if c not in may_be_empty + flags]
    rules = {f"empty_{c}": _blank(c) for c in required}
    rules |= {f"bad_date_{c}": f"{_day(c)} IS NULL" + (f" AND NOT ({_blank(c)})" if c in may_be_empty else "") for c in days}
    rules |= {f"bad_flag_{c}": f"lower(trim({c})) NOT IN ({', '.join(repr(w) for w in words)})" for c in flags}
    rules |= {"duplicate_identity": "copies > 1", "reversed_listing": f"{_day('listing_date')} > {_day('delisting_date')}", "reversed_ticker": f"{_day('ticker_start_date')} > {_day('ticker_end_date')}", "delisted_rows": f"NOT ({_blank('delisting_date')})"}
    told = ", ".join(f"CASE WHEN k % 7 = 0 THEN 'maybe' ELSE 'No' END AS {c}" for c in flags)
    return f"""WITH {BARS}, spans AS (SELECT ticker, CAST(substr(ticker, 2, 5) AS INTEGER) AS k, CAST(min(date) AS VARCHAR) AS a, CAST(max(date) AS VARCHAR) AS b FROM bars GROUP BY ticker),
once AS (SELECT k, CASE WHEN k % 5 = 0 THEN ' ' ELSE concat('P', ticker) END AS permanent_id, concat(ticker, '.US') AS raw_ticker, ticker, 'stock' AS security_type, CASE WHEN k % 3 = 0 THEN 'n/a' ELSE a END AS listing_date, CASE WHEN k % 2 = 0 THEN b ELSE '' END AS delisting_date,
  CASE WHEN k % 4 = 0 THEN b ELSE a END AS ticker_start_date, CASE WHEN k % 4 = 0 THEN a ELSE b END AS ticker_end_date, 'X' AS exchange, {told}, 's' AS source, '2020-01-01' AS source_asof_date FROM spans),
master AS (SELECT *, count(*) OVER (PARTITION BY permanent_id, ticker, ticker_start_date) AS copies FROM (SELECT * FROM once UNION ALL SELECT * FROM once WHERE k % 11 = 0))
SELECT count(*) AS rows, 0::INTEGER AS missing_columns, {_faulty(rules)} FROM master"""


def events_audit(columns: list[str], days: list[str], numbers: list[str], kinds: list[str]) -> str:
    there = columns + ["split_ratio", "cash_amount"]
    rules = {f"empty_{c}": _blank(c) for c in columns}
    rules |= {f"bad_date_{c}": f"{_day(c)} IS NULL" for c in days if c in there}
    rules |= {f"bad_number_{c}": f"NOT ({_blank(c)}) AND coalesce(TRY_CAST(trim({c}) AS DOUBLE) <= 0, true)" for c in numbers if c in there}
    rules |= {"zero_split_ratio": "trim(split_ratio) = '0'", "unknown_action_type": f"lower(trim(action_type)) NOT IN ({', '.join(repr(w) for w in kinds)})"}
    absent = "".join(f", CAST(NULL AS BIGINT) AS {n}" for n in [f"bad_date_{c}" for c in days if c not in there] + [f"bad_number_{c}" for c in numbers if c not in there])
    return f"""WITH {BARS}, numbered AS (SELECT *, day(date) AS k, CAST(date AS VARCHAR) AS told FROM bars),
events AS (SELECT concat(ticker, '.US') AS raw_ticker, ticker, CASE k WHEN 3 THEN '2020-13-01' WHEN 4 THEN '' ELSE told END AS event_date, CASE k WHEN 5 THEN 'rights' ELSE 'Split' END AS action_type, CASE k WHEN 6 THEN '' ELSE 's' END AS source, told AS source_asof_date,
  CASE k WHEN 7 THEN '0' ELSE '2' END AS split_ratio, CASE k WHEN 8 THEN '-1' WHEN 9 THEN 'n/a' WHEN 10 THEN '' ELSE '1.5' END AS cash_amount FROM numbered)
SELECT count(*) AS rows, 0::INTEGER AS missing_columns, {_faulty(rules)}{absent} FROM events"""


OPTION_FAULTS = f"""WITH {BARS}, numbered AS (SELECT *, day(date) AS k, CAST(date AS VARCHAR) AS told FROM bars),
once AS (SELECT k, lower(ticker) AS underlying_ticker, concat(ticker, '_', told) AS option_symbol, 'bars' AS data_source, told AS snapshot_date, CASE k WHEN 3 THEN told ELSE CAST(CAST(date + 30 AS DATE) AS VARCHAR) END AS expiration, CAST(open AS VARCHAR) AS strike,
  CASE WHEN k = 4 THEN 'X' WHEN k % 2 = 0 THEN 'call' ELSE 'P' END AS call_put, CASE k WHEN 5 THEN '-1' ELSE CAST(low AS VARCHAR) END AS bid, CASE k WHEN 6 THEN '0' WHEN 7 THEN 'n/a' ELSE CAST(high AS VARCHAR) END AS ask FROM numbered),
raw AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE k = 8),
typed AS (SELECT upper(trim(underlying_ticker)) AS underlying, nullif(trim(option_symbol), '') AS symbol, nullif(trim(data_source), '') AS source, {_day('snapshot_date')} AS snapshot, {_day('expiration')} AS expires, TRY_CAST(trim(strike) AS DOUBLE) AS strike,
  CASE upper(trim(call_put)) WHEN 'CALL' THEN 'C' WHEN 'PUT' THEN 'P' ELSE upper(trim(call_put)) END AS side, TRY_CAST(trim(bid) AS DOUBLE) AS bid, TRY_CAST(trim(ask) AS DOUBLE) AS ask FROM raw),
counted AS (SELECT *, count(*) OVER (PARTITION BY snapshot, source, underlying, symbol, expires, strike, side) AS copies FROM typed)
SELECT {_faulty({
    'null_core': 'snapshot IS NULL OR underlying IS NULL OR symbol IS NULL OR expires IS NULL OR strike IS NULL OR side IS NULL OR bid IS NULL OR ask IS NULL OR source IS NULL',
    'call_put': "side NOT IN ('C', 'P')", 'negative': 'bid < 0 OR ask < 0 OR strike < 0', 'crossed': 'ask < bid', 'expired': 'expires <= snapshot', 'duplicate': 'copies > 1', 'negative_volume': 'false',
})} FROM counted"""
