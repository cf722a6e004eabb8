"""Comparison of scored models: focus portfolios, profiles by year and fold, and the verdict on a variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import row_rank

TOP, MIN_DOLLAR_VOLUME, COST_BPS = 25, 25e6, 25.0


def with_liquidity(preds: DataFrame, panel: DataFrame) -> DataFrame:
    """preds with the panel's median_dollar_volume_60; a prediction that the panel does not hold fails the query."""
    proxy = panel.select("date", "ticker", "median_dollar_volume_60", F.lit(True).alias("_there"))
    found = preds.join(proxy, ["date", "ticker"], "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.lit("a prediction has no row in the panel")).cast("double")).otherwise(F.col("median_dollar_volume_60"))
    return found.withColumn("median_dollar_volume_60", checked).drop("_there")


def focus_daily(preds: DataFrame, top: int = TOP, min_dollar_volume: float = MIN_DOLLAR_VOLUME, cost_bps: float = COST_BPS) -> DataFrame:
    """preds(model, fold_id, date, ticker, score, fwd_ret_5d, median_dollar_volume_60) -> per model, fold and date the return of the
    liquid names among the `top` best scores. Names are ranked before the liquidity rule, which so leaves fewer than `top`."""
    best = preds.withColumn("rn", row_rank("score", "model", "fold_id", "date", descending=True)).where((F.col("rn") <= top) & (F.col("median_dollar_volume_60") >= min_dollar_volume))
    daily = best.groupBy("model", "fold_id", "date").agg(F.avg("fwd_ret_5d").alias("gross"), F.count("*").alias("candidates"))
    return daily.select("model", "fold_id", "date", F.year("date").alias("year"), "gross", (F.col("gross") - cost_bps / 1e4).alias("net"), "candidates")


def by_period(daily: DataFrame, period: str) -> DataFrame:
    """period: year or fold_id."""
    return daily.groupBy("model", period).agg(F.avg("net").alias("net"), F.avg("gross").alias("gross"), F.avg("candidates").alias("avg_candidates"), F.count("*").alias("active_days"))


def profiles(daily: DataFrame) -> DataFrame:
    """One row per model; of equally bad years or folds the first is named."""
    out = daily.groupBy("model").agg(F.avg("gross").alias("gross"), F.avg("net").alias("net"), (F.avg("gross") * 1e4).alias("break_even_bps"), F.avg("candidates").alias("avg_candidates"))
    for period, name in (("year", "year"), ("fold_id", "fold")):
        worst = F.min(F.when(F.col("net").isNotNull(), F.struct("net", period)))
        part = by_period(daily, period).groupBy("model").agg(F.count_if(F.col("net") > 0).alias(f"positive_{name}s"), F.count("*").alias(f"total_{name}s"), worst[period].alias(f"worst_{name}"), worst["net"].alias(f"worst_{name}_net"))
        out = out.join(part, "model")  # a row per model
    return out


def compared(found: DataFrame, variant: str, benchmark: str) -> DataFrame:
    """profiles with each model's lead over `benchmark` and the verdict on `variant` (null on other rows).

    continue_review: more positive folds, no fewer positive years, no lower net return, ten candidates a day;
    reject_variant: lower net return without more positive folds; needs_review otherwise.
    """
    base = found.where(F.col("model") == benchmark).select(F.col("net").alias("_net"), F.col("positive_folds").alias("_folds"), F.col("positive_years").alias("_years"))
    both = found.join(F.broadcast(base), F.lit(True), "left")  # the benchmark is one row
    go = (F.col("positive_folds") > F.col("_folds")) & (F.col("positive_years") >= F.col("_years")) & (F.col("avg_candidates") >= 10) & (F.col("net") >= F.col("_net"))
    stop = (F.col("net") < F.col("_net")) & (F.col("positive_folds") <= F.col("_folds"))
    verdict = F.when(F.col("model") == variant, F.when(go, "continue_review").when(stop, "reject_variant").otherwise("needs_review"))
    return both.select(*found.columns, (F.col("net") - F.col("_net")).alias("net_lead"), verdict.alias("verdict"))
