"""Walk-forward folds and the ridge baseline: all folds are fitted together, each is scored by itself.

A fold's training window is a union of date blocks, the dates that the same folds train on; see moments.py.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import percent_rank, row_rank
from ..sources.store import settled
from .moments import Training
from .rules import SELECTION


@dataclass(frozen=True)
class FoldConfig:
    train: int = 500
    test: int = 63
    step: int = 63
    purge: int = 5
    embargo: int = 0


def plan(panel: DataFrame, cfg: FoldConfig = FoldConfig()) -> DataFrame:
    """Full folds over the sorted distinct dates, by index: train, purge, test; then one step on. Few rows: one per date."""
    dates = panel.groupBy("date").agg(F.count("*").alias("rows")).withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    last = dates.agg(F.max("i").alias("last"))
    first_test, stride = cfg.train + cfg.purge, cfg.step + cfg.embargo
    folds = last.where(F.col("last") - cfg.test + 1 >= first_test).select(F.explode(F.sequence(F.lit(first_test), F.col("last") - cfg.test + 1, F.lit(stride))).alias("t"))
    folds = folds.select(((F.col("t") - first_test) / stride + 1).cast("int").alias("fold_id"), (F.col("t") - first_test).alias("a"), (F.col("t") - cfg.purge - 1).alias("b"), F.col("t").alias("c"), (F.col("t") + cfg.test - 1).alias("d"))
    met = folds.join(F.broadcast(dates), (F.col("i") >= F.col("a")) & (F.col("i") <= F.col("d")))
    at = lambda c: F.max(F.when(F.col("i") == F.col(c), F.col("date")))
    train, test = F.col("i").between(F.col("a"), F.col("b")), F.col("i").between(F.col("c"), F.col("d"))
    return met.groupBy("fold_id").agg(at("a").alias("train_start_date"), at("b").alias("train_end_date"), at("c").alias("test_start_date"), at("d").alias("test_end_date"), F.sum(F.when(train, F.col("rows")).otherwise(0)).alias("train_rows"), F.sum(F.when(test, F.col("rows")).otherwise(0)).alias("test_rows"))


def plan_summary(folds: DataFrame, panel: DataFrame, cfg: FoldConfig = FoldConfig()) -> DataFrame:
    """One row: folds, first and last dates, rows, and a warning where the history is too short for a fold."""
    dates = panel.agg(F.countDistinct("date").alias("dates"))
    need = cfg.train + cfg.purge + cfg.test
    made = folds.agg(F.count("*").alias("folds"), F.min("train_start_date").alias("first_train_date"), F.max("test_end_date").alias("last_test_date"), F.sum("train_rows").alias("train_rows"), F.sum("test_rows").alias("test_rows"))
    warning = F.when(F.col("dates") < need, F.concat(F.lit("insufficient_history: "), "dates", F.lit(f" of {need} dates"))).otherwise("")
    return made.crossJoin(dates).withColumn("warning", warning)  # one row each


def check_folds(rows: list) -> None:
    """Folds in order of time, no window reversed, no test date trained on by its own fold, no two tests overlapping."""
    rows = sorted(rows, key=lambda r: r["fold_id"])
    for r in rows:
        if not r["train_start_date"] <= r["train_end_date"] < r["test_start_date"] <= r["test_end_date"]:
            raise ValueError(f"fold {r['fold_id']}: training and test dates overlap or are out of order")
    for a, b in zip(rows, rows[1:]):
        if not a["test_end_date"] < b["test_start_date"]:
            raise ValueError(f"folds {a['fold_id']} and {b['fold_id']}: test dates overlap or are out of order")


class RidgeWalk:
    """A ridge regression per fold: medians, means and scales from the fold's training rows only.

    Missing values become the median (0 without any), columns are centred and scaled by their population deviation (1 where that
    is 0), the intercept is not penalized. All folds are fitted together, from sums over blocks of dates; a fold is scored by
    itself. The rows are read several times: they are written once first, unless `is_settled` says that they are already.
    """

    def __init__(self, matrix: DataFrame, folds: DataFrame, features: list[str], target: str = "target_class_5d", alpha: float = 1.0, scoring: DataFrame | None = None, is_settled: bool = False):
        unfit = [f for f in features if f in (target, "fwd_ret_5d", "date", "ticker") or any(t in f.lower() for t in SELECTION["leakage_tokens"])]
        if unfit:
            raise ValueError(f"not to be used as inputs: {unfit}")
        cast = [F.col(f).cast("double").alias(f) for f in features]
        keep = lambda df: df.select("date", "ticker", "fwd_ret_5d", F.col(target).cast("double").alias("y"), *cast)
        self.features, self.plan = features, folds.collect()  # one row a fold
        check_folds(self.plan)
        rows = keep(matrix) if is_settled else settled(keep(matrix))
        self.models = Training(rows, folds, features).models(alpha)
        self.tested = rows if scoring is None else keep(scoring)

    def score(self, *fold_ids: int) -> DataFrame:
        """fold_id, date, ticker, target, fwd_ret_5d, score and ranks of the folds' test dates; an error where a fold has no model."""
        for i in fold_ids:
            if isinstance(self.models[i], Exception):
                raise self.models[i]
        k, spark = len(self.features), self.tested.sparkSession
        parts = [f"{p}_{i}" for p in ("median", "mean", "weight") for i in range(k)]
        rows = [(r["fold_id"], r["test_start_date"], r["test_end_date"], *(float(v) for part in (m.median, m.mean, m.weight) for v in part), m.level) for r in self.plan if r["fold_id"] in fold_ids for m in [self.models[r["fold_id"]]]]
        model = F.broadcast(spark.createDataFrame(rows, "fold_id int, test_start_date date, test_end_date date, " + "".join(f"{p} double, " for p in parts) + "level double"))  # one row a fold
        test = self.tested.join(model, self.tested["date"].between(F.col("test_start_date"), F.col("test_end_date")))
        score = F.col("level")
        for i, f in enumerate(self.features):
            score = score + F.col(f"weight_{i}") * (F.coalesce(F.col(f), F.col(f"median_{i}")) - F.col(f"mean_{i}"))
        return ranked(test.select("fold_id", "date", "ticker", F.col("y").cast("int").alias("target"), "fwd_ret_5d", score.alias("score")))


def ridge_predictions(matrix: DataFrame, folds: DataFrame, features: list[str], target: str = "target_class_5d", alpha: float = 1.0, scoring: DataFrame | None = None, is_settled: bool = False) -> DataFrame:
    """Out-of-sample scores of RidgeWalk on all folds' test dates, or on the rows of `scoring`. Folds without a training row have none."""
    walk = RidgeWalk(matrix, folds, features, target, alpha, scoring, is_settled)
    return walk.score(*(i for i, m in walk.models.items() if not isinstance(m, ValueError)))


def daily_scores(panel: DataFrame, features: list[str], target: str = "target_class_5d", score_date=None, is_settled: bool = False) -> DataFrame:
    """panel: the scoring matrix (all rows, label-valid or not, with the features). A ridge on all label-valid rows before the score date (the
    last date unless given) scores the eligible rows of that date; an error where there is nothing to train on or to score."""
    last = score_date or panel.agg(F.max("date")).first()[0]
    today = panel.where((F.col("date") == F.lit(last)) & F.col("model_eligible"))
    before = panel.where((F.col("date") < F.lit(last)) & F.col("label_valid_5d") & F.col(target).isNotNull())
    span = before.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    if span["a"] is None:
        raise ValueError("no training rows before the score date")
    if not today.limit(1).count():
        raise ValueError("no eligible rows on the score date")
    fold = panel.sparkSession.createDataFrame([(1, span["a"], span["b"], last, last)], "fold_id int, train_start_date date, train_end_date date, test_start_date date, test_end_date date")
    return ridge_predictions(before, fold, features, target, scoring=today, is_settled=is_settled)


def signal_counts(found: DataFrame) -> DataFrame:
    """Candidates by side, and how many of them pass each liquidity proxy."""
    return found.groupBy("side").agg(F.count("*").alias("rows"), F.count_if("liquid_25m").alias("liquid_25m_rows"), F.count_if("liquid_50m").alias("liquid_50m_rows"))


def ranked(preds: DataFrame) -> DataFrame:
    by = ("fold_id", "date") if "fold_id" in preds.columns else ("date",)
    df = preds.withColumn("_k", F.round("score", 9))
    return df.select(*preds.columns, percent_rank("_k", *by).alias("rank_pct"), row_rank("_k", *by, descending=True).alias("long_rank"), row_rank("_k", *by).alias("short_rank"))


def signals(preds: DataFrame, panel: DataFrame) -> DataFrame:
    """Candidates of the last scored date: deciles 1 and 10 with their side and liquidity proxies."""
    from .evaluation import bucketed

    last = preds.agg(F.max("date").alias("date"))
    now = preds.join(F.broadcast(last), "date")
    df = bucketed(now, 10, "date").where(F.col("bucket").isin(1, 10)).join(panel.select("date", "ticker", "close", "median_dollar_volume_60", "zero_volume_count_60", "history_bars"), ["date", "ticker"])
    base = (F.col("close") >= 10) & (F.col("zero_volume_count_60") == 0) & (F.col("history_bars") >= 252)
    return df.withColumns({"side": F.when(F.col("bucket") == 10, "long").otherwise("short"), "liquid_25m": F.coalesce(base & (F.col("median_dollar_volume_60") >= 25e6), F.lit(False)), "liquid_50m": F.coalesce(base & (F.col("median_dollar_volume_60") >= 50e6), F.lit(False))})
