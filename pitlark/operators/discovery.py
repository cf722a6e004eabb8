"""Feature discovery by fold, and selection rules.

What concerns one date (a feature's rank correlation with the target, its counts and moments) is computed once per date, in
one exchange of the matrix, and met with the folds that train on the date afterwards.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import held, packed, unpacked
from ..sources.store import settled
from . import rules as R
from .matrix import average_ranks
from .ranks import sample_correlations, sampled


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Of the rows where both are there; none where either does not vary."""
    both = ~np.isnan(x) & ~np.isnan(y)
    if not both.any():
        return None
    a, b = x[both] - x[both].mean(), y[both] - y[both].mean()
    size = np.sqrt((a**2).mean() * (b**2).mean())
    return float((a * b).mean() / size) if size > 1e-12 else None


BY_DATE = "date date, feature string, rows long, non_null long, finite long, mean double, spread double, ic double"


#: Rows that are packed together for their way to the dates.
PACKED_ROWS = 65_536


def by_date(matrix: DataFrame, features: list[str], target: str = "fwd_ret_5d") -> DataFrame:
    """(date, feature): rows, values there and finite, their mean and sum of squared deviations, and the rank correlation with
    the target. A date's rows (one per name) meet in one task, packed; the target is ranked once a date."""
    rows = matrix.select("date", F.col(target).cast("double").alias("_target"), *(F.col(f).cast("double") for f in features))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in held(batches, PACKED_ROWS):
            day = table.column(0).combine_chunks()
            day, undated = day.cast(pa.int32()).to_numpy(zero_copy_only=False), np.asarray(day.is_null())
            day = np.where(undated, -(2**31), day).astype(np.int64)
            order = np.argsort(day, kind="stable")
            days, starts = np.unique(day[order], return_index=True)
            ends = np.append(starts[1:], len(day))
            columns = [table.column(1 + i).combine_chunks() for i in range(1 + len(features))]
            values = np.array([c.to_numpy(zero_copy_only=False) for c in columns])[:, order]
            there = np.array([~np.asarray(c.is_null()) for c in columns])[1:, order]
            nan = np.add.reduceat((there & np.isnan(values[1:])).astype(np.int64), starts, axis=1).T if len(features) else np.zeros((len(days), 0), np.int64)  # NaN counts as there
            data = [packed(values[:, a:b].ravel()) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([None if d == -(2**31) else d for d in days.tolist()], pa.int32()).cast(pa.date32()), pa.array((ends - starts).tolist(), pa.int32()), pa.array(data, pa.binary()), pa.array(nan.tolist(), pa.list_(pa.int64()))], ["date", "n", "data", "nan"])

    def judge(part: pa.Table) -> pa.Table:
        day, sizes, data = part.column("date")[0].as_py(), part.column("n").to_pylist(), part.column("data").to_pylist()
        nan = np.sum(part.column("nan").to_pylist(), axis=0)
        columns = np.concatenate([unpacked(d, n * (1 + len(features))).reshape(-1, n) for d, n in zip(data, sizes)], axis=1)
        goal = average_ranks(columns[0])
        out = []
        for i, f in enumerate(features):
            x = columns[1 + i]
            there, n = ~np.isnan(x), len(x)
            finite = np.isfinite(x)
            mean = float(x[finite].mean()) if finite.any() else None
            out.append((day, f, n, int(there.sum() + nan[i]), int(finite.sum()), mean, float(((x[finite] - mean) ** 2).sum()) if finite.any() else None, correlation(average_ranks(x), goal) if there.any() else None))
        kinds = [pa.date32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in BY_DATE.split(", ")])

    return rows.mapInArrow(send, "date date, n int, data binary, nan array<long>").groupBy("date").applyInArrow(judge, BY_DATE)


def _in_folds(days: DataFrame, folds: DataFrame) -> DataFrame:
    slim = F.broadcast(folds.select("fold_id", "train_start_date", "train_end_date"))  # one row a fold
    return days.join(slim, days["date"].between(F.col("train_start_date"), F.col("train_end_date")))


def feature_stats(days: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold and feature: rows, shares of values there and finite, population deviation (from the dates' moments)."""
    met = _in_folds(days, folds).withColumn("_m", F.sum(F.col("mean") * F.col("finite")).over(Window.partitionBy("fold_id", "feature")) / F.sum("finite").over(Window.partitionBy("fold_id", "feature")))
    spread = F.sum(F.col("spread") + F.col("finite") * F.pow(F.col("mean") - F.col("_m"), 2))
    return met.groupBy("fold_id", "feature").agg(F.sum("rows").alias("rows"), (F.sum("non_null") / F.sum("rows")).alias("non_null_pct"), (F.sum("finite") / F.sum("rows")).alias("finite_pct"), F.sqrt(F.try_divide(spread, F.sum("finite").cast("double"))).alias("std"))


def daily_ic(days: DataFrame, folds: DataFrame) -> DataFrame:
    """Mean over a fold's training dates of the rank correlation with the target."""
    return _in_folds(days, folds).groupBy("fold_id", "feature").agg(F.avg("ic").alias("mean_daily_rank_ic"), F.count("ic").alias("dates"))


def summary(daily: DataFrame, fold_ic: DataFrame) -> DataFrame:
    """Per feature over folds, of daily_ic() and ranks.fold_correlations(): folds, means of the daily and of the folds' pooled rank
    correlations, sign stability of the latter (share of folds with their mean's sign; 0 for a zero mean or without any), and
    their map as JSON."""
    met = daily.join(fold_ic, ["fold_id", "feature"], "full").withColumn("_m", F.avg("fold_rank_ic").over(Window.partitionBy("feature")))
    same = F.when(F.col("_m") == 0, 0.0).otherwise((F.signum("fold_rank_ic") == F.signum("_m")).cast("double"))
    return met.groupBy("feature").agg(
        F.countDistinct("fold_id").alias("folds_scored"),
        F.avg("mean_daily_rank_ic").alias("mean_daily_rank_ic"),
        F.avg("fold_rank_ic").alias("mean_fold_rank_ic"),
        F.abs(F.avg("mean_daily_rank_ic")).alias("abs_mean_rank_ic"),
        F.coalesce(F.avg(F.when(F.col("fold_rank_ic").isNotNull(), same)), F.lit(0.0)).alias("sign_stability"),
        F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("fold_id", F.round("fold_rank_ic", 6).alias("ic")))), lambda e: F.struct(e["fold_id"].cast("string"), e["ic"])))).alias("fold_ics"),
    )


def correlations(matrix: DataFrame, folds: DataFrame, features: list[str], stride: int = 20, most: int = 250_000, chosen: DataFrame | None = None) -> DataFrame:
    """|Spearman| of feature pairs per fold on at most `most` rows of every `stride`-th training date, then mean and maximum over
    folds. `chosen`: see sampled()."""
    sample = settled(sampled(matrix.select("date", "ticker", *features), folds, stride, most, chosen))
    per = sample_correlations(sample, features).withColumn("c", F.abs("c"))
    return per.groupBy("feature_a", "feature_b").agg(F.count("c").alias("folds"), F.avg("c").alias("mean_abs_corr"), F.max("c").alias("max_abs_corr"))


def reject_reasons(found: DataFrame, settings: dict = R.SELECTION, rules: list[R.Rule] = R.REJECTS) -> DataFrame:
    """The first rule a feature breaks (empty if none), and its selection score."""
    score = F.coalesce("abs_mean_rank_ic", F.lit(0.0)) * F.coalesce("sign_stability", F.lit(0.0)) * F.coalesce("non_null_pct", F.lit(0.0))
    return found.select("*", R.first_verdict(rules, settings).alias("reject_reason"), score.alias("selection_score"))


def prune(rejects: list[dict], pairs: dict[frozenset, float], limit: int = 64, most: float = 0.95) -> tuple[list[str], set[str]]:
    """(chosen, pruned): greedy, best score first, skipping what correlates too much with a chosen one, until `limit` are chosen.
    What comes after that is neither. Over at most some hundred features."""
    chosen: list[str] = []
    pruned: set[str] = set()
    for r in sorted((r for r in rejects if not r["reject_reason"]), key=lambda r: (-r["selection_score"], r["feature"])):
        if len(chosen) >= limit:
            break
        if any((pairs.get(frozenset((r["feature"], c))) or 0) >= most for c in chosen):
            pruned.add(r["feature"])
        else:
            chosen.append(r["feature"])
    return chosen, pruned


def selected(found: DataFrame, pairs: DataFrame, settings: dict = R.SELECTION) -> DataFrame:
    """reject_reasons()' rows with `rank` and `selected`, after pruning by the largest correlation of each pair. Features beyond
    the limit have no reason. Both tables hold one row a feature or pair of features."""
    rows = [r.asDict() for r in found.collect()]
    strongest = {frozenset((r["feature_a"], r["feature_b"])): r["max_abs_corr"] for r in pairs.collect()}
    chosen, pruned = prune(rows, strongest, settings["max_selected_features"], settings["correlation_prune_threshold"])
    rank = {f: i + 1 for i, f in enumerate(chosen)}
    spark = found.sparkSession
    marks = spark.createDataFrame([(r["feature"], rank.get(r["feature"]), r["feature"] in pruned) for r in rows], "feature string, rank int, _pruned boolean")
    out = found.join(F.broadcast(marks), "feature").withColumn("selected", F.col("rank").isNotNull())
    return out.withColumn("reject_reason", F.when(F.col("_pruned"), "correlation_pruned").otherwise(F.col("reject_reason"))).drop("_pruned")


def freeze(chosen: list[str], settings: dict) -> dict:
    """A manifest of a selection: the features in order, what they were chosen with, and a digest that changes with either."""
    body = {"features": list(chosen), "feature_count": len(chosen), "settings": dict(sorted(settings.items()))}
    return {**body, "sha256": hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()}
