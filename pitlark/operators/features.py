"""Feature builders over the catalog, column registry and leakage checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import SparkOps, average_rank, percent_rank
from . import catalog as C
from .rules import SELECTION

OPS = SparkOps()


def add_levels(df: DataFrame, levels: list[C.Level]) -> DataFrame:
    for level in levels:
        df = df.select(*(c for c in df.columns if c not in level), *(f(OPS).alias(n) for n, f in level.items()))
    return df


def add_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """rank_<column>: average rank over the non-null count of the date. One more exchange, by date."""
    return df.select("*", *(F.round(c, 9).alias(f"_r_{c}") for c in columns)).select(*df.columns, *(percent_rank(f"_r_{c}", "date").alias(f"rank_{c}") for c in columns))


def baseline(labelled: DataFrame, keep_invalid: bool = False) -> DataFrame:
    """The 55 baseline features over the whole panel; ranks see all rows, then only label-valid rows stay."""
    df = add_ranks(add_levels(labelled, C.BASELINE), C.BASELINE_RANKS)
    return df if keep_invalid else df.where("label_valid_5d")


def expanded(matrix: DataFrame) -> DataFrame:
    """The 56 further features, over the surviving rows of the baseline matrix (a window of 20 is 20 such rows)."""
    return add_ranks(add_levels(matrix.where("label_valid_5d"), C.EXPANDED), C.EXPANDED_RANKS)


def long_only(labelled: DataFrame) -> DataFrame:
    """The 14 long-only features, over the whole panel, then only label-valid rows."""
    return _with_long_only(add_levels(labelled, C.BASELINE)).where("label_valid_5d")


def _with_long_only(base: DataFrame) -> DataFrame:
    df = add_levels(base, C.LONG_ONLY).withColumn("_rv", F.round("realized_vol_20d", 9))
    rank = average_rank("_rv", "date") / F.count(F.lit(1)).over(Window.partitionBy("date"))
    return df.withColumn("vol_regime_rank_by_date", rank).drop("_rv")


BASELINE_NAMES = C.names(C.BASELINE) + [f"rank_{c}" for c in C.BASELINE_RANKS]
EXPANDED_NAMES = [n for n in C.names(C.EXPANDED)] + [f"rank_{c}" for c in C.EXPANDED_RANKS]
LONG_ONLY_NAMES = C.names(C.LONG_ONLY) + ["vol_regime_rank_by_date"]


#: The long-only features of the two phases, and what the ablations leave out of the first.
PHASE1 = ["mom_20d_vol_adj", "mom_60d_vol_adj", "trend_pos_ret_frac_20d", "pullback_5d_vs_60d", "vol_ratio_5d_20d", "vol_ratio_20d_60d", "atr14_to_vol20", "dollar_volume_ratio_20d_60d"]
PHASE2 = ["vol_ratio_10d_60d", "range_compression_20d_60d", "vol_regime_rank_by_date", "sma_slope_agreement_20_50", "sma_stack_score_20_50_200", "dollar_volume_accel_10d_60d"]
FEATURE_SETS = {
    "baseline": BASELINE_NAMES,
    "expanded": BASELINE_NAMES + EXPANDED_NAMES,
    "phase1": BASELINE_NAMES + PHASE1,
    "phase2_core": BASELINE_NAMES + PHASE2,
    "phase1_no_momentum_trend": BASELINE_NAMES + PHASE1[3:],
    "phase1_vol_liq_only": BASELINE_NAMES + PHASE1[4:],
    "vol20_60_only": BASELINE_NAMES + ["vol_ratio_20d_60d"],
    "vol_norm60_target": BASELINE_NAMES,
}


def feature_set(labelled: DataFrame, name: str, scoring: bool = False) -> tuple[DataFrame, list[str], str]:
    """(matrix, its features, the target) of a named set: label-valid rows, or with `scoring` all rows. The volatility-normalized
    target has its own classes and validity."""
    features = FEATURE_SETS[name]
    if name == "expanded":
        if scoring:
            raise ValueError("windows of the expanded set count label-valid rows only")
        return expanded(baseline(labelled)), features, "target_class_5d"
    if name == "vol_norm60_target":
        from .panel import volatility_target

        found = baseline(volatility_target(labelled), keep_invalid=True)
        return (found if scoring else found.where("label_valid_5d_vol_norm60")), features, "target_class_5d_vol_norm60"
    if name == "baseline":
        return baseline(labelled, keep_invalid=scoring), features, "target_class_5d"
    found = add_ranks(add_levels(labelled, C.BASELINE), C.BASELINE_RANKS)
    found = _with_long_only(found)
    return (found if scoring else found.where("label_valid_5d")), features, "target_class_5d"


@dataclass(frozen=True)
class Registry:
    features: list[str]
    targets: list[str]
    metadata: list[str]
    excluded: list[str]


def registry(columns: list[str], features: list[str], targets: list[str], metadata: list[str]) -> Registry:
    """Sorts columns into groups; a configured column that is missing, or a feature that is also a target, is an error."""
    missing = [c for c in [*features, *targets, *metadata] if c not in columns]
    if missing:
        raise ValueError(f"configured columns are missing: {missing}")
    known = {*features, *targets, *metadata}
    excluded = [c for c in columns if c not in known]
    if set(features) & {*targets, *excluded}:
        raise ValueError("features overlap targets or excluded columns")
    return Registry(features, targets, metadata, excluded)


def check_model_inputs(features: list[str], groups: Registry, tokens: list[str] = SELECTION["leakage_tokens"]) -> None:
    """An error where a feature is a target, metadata or excluded, or its name speaks of the future."""
    bad = [f for f in features if f in {*groups.targets, *groups.excluded, *groups.metadata} or any(t in f.lower() for t in tokens)]
    if bad:
        raise ValueError(f"not to be used as inputs: {bad}")


def null_counts(matrix: DataFrame, features: list[str]) -> DataFrame:
    """(feature, nulls) of all features in one aggregation."""
    one = matrix.agg(*(F.count_if(F.col(f).isNull()).alias(f) for f in features))
    return one.unpivot([], features, "feature", "nulls")
