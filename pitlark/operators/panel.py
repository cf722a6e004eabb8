"""From bars to the labelled panel: causal gating, universe, forward-return labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import SparkOps, by_ticker

O = SparkOps()


@dataclass(frozen=True)
class PanelConfig:
    min_history_bars: int = 252
    price_min: float = 5.0
    median_dollar_volume_min: float = 1e4
    warmup_start: str = "1995-01-01"
    research_start: str = "1997-01-01"
    horizon: int = 5
    quantile: float = 0.2
    gap_low: float = 0.55
    gap_high: float = 1.8


def gate(bars: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Adds dollar_volume, history_bars, rolling medians and zero-volume counts, and tradable; each bar sees only its past."""
    df = bars.withColumns({"dollar_volume": F.col("close") * F.col("volume"), "_zero": (F.col("volume") == 0).cast("double")})
    df = df.select(
        "*",
        (F.row_number().over(by_ticker()) - 1).alias("history_bars"),
        *(O.rmedian("dollar_volume", w).alias(f"median_dollar_volume_{w}") for w in (20, 60)),
        *(O.rsum("_zero", w).alias(f"zero_volume_count_{w}") for w in (20, 60)),
    )
    ok = (F.col("history_bars") >= cfg.min_history_bars) & (F.col("close") >= cfg.price_min) & (F.col("median_dollar_volume_20") >= cfg.median_dollar_volume_min) & (F.col("zero_volume_count_20") == 0)
    return df.withColumn("tradable", F.coalesce(ok, F.lit(False))).drop("_zero")


def universe(gated: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Rows from the warm-up on; eligible ones are tradable and inside the research period."""
    df = gated.where(F.col("date") >= F.lit(cfg.warmup_start).cast("date"))
    return df.withColumn("model_eligible", (F.col("date") >= F.lit(cfg.research_start).cast("date")) & F.col("tradable"))


def split_gaps(bars: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Bars whose open is far from the close before: likely splits."""
    df = bars.withColumn("prev_close", F.lag("close").over(by_ticker())).withColumn("gap_ratio", F.try_divide("open", "prev_close"))
    return df.where((F.col("gap_ratio") <= cfg.gap_low) | (F.col("gap_ratio") >= cfg.gap_high)).select("ticker", "date", "prev_close", "open", ((F.col("gap_ratio") - 1) * 100).alias("gap_pct"))


def label(panel: DataFrame, gaps: DataFrame | None = None, cfg: PanelConfig = PanelConfig(), excluded: tuple[str, ...] = ()) -> DataFrame:
    """Forward returns (entry at the next open, exit at the close h bars ahead), validity and its reasons, and classes.

    gaps(ticker, date): bars to keep out of the holding window; None computes them from the panel itself, on the same
    exchange as the other windows.
    """
    h = cfg.horizon
    if gaps is None:
        ratio = F.try_divide("open", F.lag("close").over(by_ticker()))
        df = panel.withColumn("split_gap", F.coalesce((ratio <= cfg.gap_low) | (ratio >= cfg.gap_high), F.lit(False)))
    else:
        flags = gaps.select("ticker", "date").dropDuplicates().withColumn("split_gap", F.lit(True))
        df = panel.join(flags, ["ticker", "date"], "left").withColumn("split_gap", F.coalesce("split_gap", F.lit(False)))
    df = df.select(
        "*",
        F.lead("open", 1).over(by_ticker()).alias("next_open"),
        F.lead("close", h).over(by_ticker()).alias("exit_close_5d"),
        F.lead("date", h).over(by_ticker()).alias("exit_date_5d"),
        F.coalesce(F.max("split_gap").over(by_ticker().rowsBetween(1, h)), F.lit(False)).alias("split_gap_in_window"),
    )
    df = df.withColumn("fwd_ret_5d", F.try_divide("exit_close_5d", "next_open") - 1)
    df = df.select(
        "*",
        (F.col("date") < F.lit(cfg.research_start).cast("date")).alias("pre_research"),
        (~F.col("model_eligible")).alias("not_eligible"),
        F.col("fwd_ret_5d").isNull().alias("missing_future"),
        F.col("ticker").isin(*excluded).alias("is_excluded") if excluded else F.lit(False).alias("is_excluded"),
    )
    bad = F.col("pre_research") | F.col("not_eligible") | F.col("missing_future") | F.col("is_excluded") | F.col("split_gap_in_window")
    return classes(df.withColumn("label_valid_5d", ~bad), "fwd_ret_5d", "label_valid_5d", "target_class_5d", cfg.quantile)


def classes(df: DataFrame, value: str, valid: str, out: str, quantile: float = 0.2) -> DataFrame:
    """Per date over valid rows: bottom floor(n q) -1, top 1, else 0; all 0 below five names; invalid rows 0."""
    by = Window.partitionBy("date", valid)
    order = by.orderBy(F.round(value, 9), "ticker")
    df = df.select("*", F.row_number().over(order).alias("_rn"), F.count(F.lit(1)).over(by).alias("_n"))
    k = F.floor(F.col("_n").cast("double") * quantile)
    found = F.when(~F.col(valid) | (F.col("_n") < 5) | (k < 1), 0).when(F.col("_rn") > F.col("_n") - k, 1).when(F.col("_rn") <= k, -1).otherwise(0)
    return df.withColumn(out, found.cast("int")).drop("_rn", "_n")


def volatility_target(labelled: DataFrame, cfg: PanelConfig = PanelConfig(), epsilon: float = 1e-6) -> DataFrame:
    """The forward return over the trailing 60-bar volatility, and its classes."""
    df = labelled.withColumn("_r", F.try_divide("close", F.lag("close").over(by_ticker())) - 1)
    df = df.withColumn("trailing_vol_60d", O.rstd("_r", 60)).drop("_r")
    ok = F.coalesce(F.col("trailing_vol_60d") > epsilon, F.lit(False))
    df = df.withColumns({"vol_denominator_valid": ok, "fwd_ret_5d_vol_norm60": F.when(ok, F.col("fwd_ret_5d") / F.col("trailing_vol_60d"))})
    df = df.withColumn("label_valid_5d_vol_norm60", F.col("label_valid_5d") & ok)
    return classes(df, "fwd_ret_5d_vol_norm60", "label_valid_5d_vol_norm60", "target_class_5d_vol_norm60", cfg.quantile)


REASONS = ["pre_research", "not_eligible", "missing_future", "is_excluded", "split_gap_in_window"]


def label_reasons(labelled: DataFrame) -> DataFrame:
    """One row: how often each reason holds, and how often it is the first that holds."""
    first = F.lit("valid")
    for r in reversed(REASONS):
        first = F.when(F.col(r), r).otherwise(first)
    df = labelled.withColumn("first_reason", first)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("label_valid_5d").alias("valid_rows"),
        *(F.count_if(r).alias(f"any_{r}") for r in REASONS),
        *(F.count_if(F.col("first_reason") == r).alias(f"first_{r}") for r in REASONS),
    )


def label_counts(labelled: DataFrame, key: str) -> DataFrame:
    c = F.when(F.col("label_valid_5d"), F.col("target_class_5d"))
    return labelled.groupBy(key).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("label_valid_5d").alias("valid_rows"), *(F.count_if(c == k).alias(n) for k, n in ((-1, "class_neg"), (0, "class_zero"), (1, "class_pos"))))


def rows_by_year(research: DataFrame) -> DataFrame:
    return research.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("rows"), F.count_if("model_eligible").alias("eligible_rows"), F.countDistinct("ticker").alias("tickers"))


def class_agreement(df: DataFrame) -> DataFrame:
    """One row: how far the volatility-normalized classes differ from the plain ones on rows valid in both."""
    both = F.col("label_valid_5d") & F.col("label_valid_5d_vol_norm60")
    a, b = F.col("target_class_5d"), F.col("target_class_5d_vol_norm60")
    share = lambda cond, hit: F.avg(F.when(cond, hit.cast("double")))
    return df.agg(
        F.count("*").alias("rows"), F.count_if("label_valid_5d").alias("base_valid_rows"), F.count_if("label_valid_5d_vol_norm60").alias("valid_rows"),
        F.count_if(~F.col("vol_denominator_valid")).alias("bad_denominator_rows"), share(both, a != b).alias("class_churn"),
        share(both & (a == 1), b == 1).alias("long_agreement"), share(both & (a == -1), b == -1).alias("short_agreement"),
    )
