"""Scores to buckets, returns, rank correlations, turnover and the research gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import average_rank, bucket, pearson, row_rank
from . import rules as R


def bucketed(preds: DataFrame, buckets: int = 10, *by: str) -> DataFrame:
    return preds.withColumn("bucket", bucket("score", buckets, *(by or ("date",))))


def bucket_returns(preds: DataFrame, *by: str) -> DataFrame:
    return preds.groupBy(*(by or ("date",)), "bucket").agg(F.count("*").alias("names"), F.avg("fwd_ret_5d").alias("mean_return"))


def bucket_profile(preds: DataFrame) -> DataFrame:
    """Mean of the dates' means: every date weighs the same."""
    return bucket_returns(preds).groupBy("bucket").agg(F.count("*").alias("dates"), F.avg("mean_return").alias("mean_return"))


def long_short(preds: DataFrame, top: int = 10, bottom: int = 1, cost_bps: float = 25.0, *by: str) -> DataFrame:
    """Per date both legs' counts, hit rates and returns before and after cost; dates without either leg go. One aggregation."""
    is_long, is_short, r = F.col("bucket") == top, F.col("bucket") == bottom, F.col("fwd_ret_5d")
    df = preds.where(is_long | is_short).groupBy(*(by or ("date",))).agg(
        F.count_if(is_long).alias("long_count"),
        F.count_if(is_short).alias("short_count"),
        F.avg(F.when(is_long, r)).alias("long_gross"),
        F.avg(F.when(is_short, -r)).alias("short_gross"),
        F.avg(F.when(is_long & r.isNotNull(), (r > 0).cast("double"))).alias("long_hit_rate"),
        F.avg(F.when(is_short & r.isNotNull(), (-r > 0).cast("double"))).alias("short_hit_rate"),
    )
    df = df.where("long_count > 0 AND short_count > 0")
    cost = cost_bps / 1e4
    df = df.select("*", (F.col("long_gross") - cost).alias("long_net"), (F.col("short_gross") - cost).alias("short_net"))
    return df.select("*", (0.5 * F.col("long_gross") + 0.5 * F.col("short_gross")).alias("gross"), (0.5 * F.col("long_net") + 0.5 * F.col("short_net")).alias("net"))


def rank_ic(preds: DataFrame, *by: str) -> DataFrame:
    """Spearman correlation of score and forward return per date; null where either does not vary."""
    by = by or ("date",)
    both = preds.where("score IS NOT NULL AND fwd_ret_5d IS NOT NULL").select(*by, F.round("score", 9).alias("_s"), F.round("fwd_ret_5d", 9).alias("_r"))
    ranked = both.select(*by, average_rank("_s", *by).alias("_s"), average_rank("_r", *by).alias("_r"))
    return ranked.groupBy(*by).agg(F.count("*").alias("names"), pearson(F.col("_s"), F.col("_r")).alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    n, sd = F.count("ic"), F.stddev_samp("ic")
    return ics.agg(n.alias("dates"), F.avg("ic").alias("mean_ic"), sd.alias("std_ic"), F.when(n > 1, F.try_divide(F.avg("ic"), F.try_divide(sd, F.sqrt(n.cast("double"))))).alias("t_stat"))


QUANTILES = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def score_stats(preds: DataFrame, *by: str, cells: int = 256) -> DataFrame:
    """Counts, moments and exact interpolated percentiles. Values are counted, the counts summed in cells between approximate
    quantiles, and only the few cells that hold a percentile's two neighbours are looked at value by value."""
    there = preds.where("score IS NOT NULL").withColumn("_all", F.lit(0))
    key = [*by, "_all"]
    stats = there.groupBy(*key).agg(F.count("score").alias("rows"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"), F.percentile_approx("score", [i / cells for i in range(1, cells)], 10_000).alias("_cuts"))
    counts = there.groupBy(*key, "score").agg(F.count("*").alias("_n")).join(F.broadcast(stats.select(*key, "rows", "_cuts")) if not by else stats.select(*key, "rows", "_cuts"), key)
    counts = counts.withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    totals = counts.groupBy(*key, "_cell").agg(F.sum("_n").alias("_t"))
    totals = totals.withColumn("_below", F.sum("_t").over(Window.partitionBy(*key).orderBy("_cell")) - F.col("_t"))  # at most `cells` rows a group
    place = lambda q: F.lit(q) * (F.col("rows") - 1)
    near = lambda q, low, high: (F.col(high) > F.floor(place(q))) & (F.col(low) <= F.ceil(place(q)))
    some = counts.join(totals, [*key, "_cell"]).withColumn("_end", F.col("_below") + F.col("_t"))
    wanted = F.lit(False)
    for q in QUANTILES.values():
        wanted = wanted | near(q, "_below", "_end")
    at = some.where(wanted).withColumn("_upto", F.col("_below") + F.sum("_n").over(Window.partitionBy(*key, "_cell").orderBy("score")))
    at = at.withColumn("_from", F.col("_upto") - F.col("_n"))
    value = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_upto")), F.col("score")))
    found = at.groupBy(*key).agg(*(c for n, q in QUANTILES.items() for c in (value(F.floor(place(q))).alias(f"_lo_{n}"), value(F.ceil(place(q))).alias(f"_hi_{n}"))))
    out = stats.drop("_cuts").join(found, key, "left")
    weight = lambda q: place(q) - F.floor(place(q))
    return out.select(*by, "rows", "mean", "std", "min", "max", *((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * weight(q)).alias(n) for n, q in QUANTILES.items()))


def top_names(preds: DataFrame, n: int, *by: str) -> DataFrame:
    return preds.where("score IS NOT NULL").withColumn("rn", row_rank("score", *by, "date", descending=True)).where(F.col("rn") <= n)


def turnover(members: DataFrame, *by: str) -> DataFrame:
    """Share of a date's names that the date before did not hold; the first date has none. Joins on a dense date number,
    so no date's names are gathered in one row."""
    dates = members.select(*by, "date").distinct().withColumn("k", F.dense_rank().over(Window.partitionBy(*by).orderBy("date")))  # one row a date
    now = members.select(*by, "date", "ticker").join(F.broadcast(dates), [*by, "date"])
    before = now.select(*by, (F.col("k") + 1).alias("k"), "ticker", F.lit(True).alias("held"))
    df = now.where("k > 1").join(before, [*by, "k", "ticker"], "left").groupBy(*by, "date")
    return df.agg(F.count("*").alias("names"), F.count_if(F.col("held").isNull()).alias("new_names"), F.avg(F.col("held").isNull().cast("double")).alias("turnover"))


def lagged_scores(preds: DataFrame) -> DataFrame:
    """Negative control: each name's score of its row before; first rows go."""
    w = Window.partitionBy("ticker").orderBy("date", "fold_id") if "fold_id" in preds.columns else Window.partitionBy("ticker").orderBy("date")
    return preds.withColumn("score", F.lag("score").over(w)).where("score IS NOT NULL")


def _normal(seed: int) -> Column:
    """A normal number made of digests of seed, date and ticker (any engine with MD5 gets the same)."""
    digest = lambda k: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(k)), F.col("date").cast("string"), F.col("ticker")))
    u = lambda k: (F.conv(F.substring(digest(k), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(2))


def random_scores(preds: DataFrame, seed: int) -> DataFrame:
    """Negative control: normal scores made of a hash of seed, date and ticker: the same for any partitioning."""
    return preds.withColumn("score", _normal(seed))


def constant_scores(preds: DataFrame) -> DataFrame:
    """Negative control: equal scores; ranks then follow the tickers, and no date has a correlation."""
    return preds.withColumn("score", F.lit(0.0))


def control_scores(preds: DataFrame, seeds: tuple[int, ...] = (101, 202)) -> DataFrame:
    """preds(fold_id, date, ticker, fwd_ret_5d, score) once per control: the scores themselves, random ones per seed, equal ones,
    and each name's score of its row before. One pass: the controls are columns until they are exploded."""
    lag = F.lag("score").over(Window.partitionBy("ticker").orderBy("date", "fold_id"))
    found = {"active": F.col("score"), **{f"random_{s}": _normal(s) for s in seeds}, "constant": F.lit(0.0), "lagged": F.col("_lag")}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("control"), c.alias("score")) for n, c in found.items())))
    return preds.withColumn("_lag", lag).select("fold_id", "date", "ticker", "fwd_ret_5d", each.alias("e")).select("e.*", "fold_id", "date", "ticker", "fwd_ret_5d")


def fold_metrics(preds: DataFrame, buckets: int = 10, cost_bps: float = 25.0, outlier: float = 5.0, *by: str) -> DataFrame:
    """Per fold: rows, scores, mean rank correlation, long-short returns with buckets dealt inside the fold, outlier flag."""
    by = (*by, "fold_id")
    df = preds.where("score IS NOT NULL AND fwd_ret_5d IS NOT NULL")
    stats = df.groupBy(*by).agg(F.count("*").alias("rows"), F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    ics = rank_ic(df, *by, "date").groupBy(*by).agg(F.avg("ic").alias("mean_rank_ic"))
    legs = long_short(bucketed(df, buckets, *by, "date"), buckets, 1, cost_bps, *by, "date").groupBy(*by).agg(F.avg("gross").alias("gross"), F.avg("net").alias("net"))
    out = stats.join(ics, [*by], "left").join(legs, [*by], "left")
    return out.withColumn("score_outlier", F.greatest(F.abs("score_min"), F.abs("score_max")) > outlier)


def metrics(preds: DataFrame, by: str, buckets: int = 10, quintiles: int = 5, cost_bps: float = 25.0, top: int = 20) -> DataFrame:
    """One row of metrics per value of `by` (a model or a control): rows, folds, dates with few names, rank correlation and its
    t statistic, both legs and the long-short portfolio, the fixed top names and the turnovers. Rows without a score or a
    return count as missing only. Every part is an aggregation by (by, date), so they share that exchange's keys."""
    day = (by, "date")
    df = preds.where("score IS NOT NULL AND fwd_ret_5d IS NOT NULL")
    base = preds.groupBy(by).agg(F.count_if(F.col("score").isNull() | F.col("fwd_ret_5d").isNull()).alias("missing_rows"))
    used = df.groupBy(by).agg(F.count("*").alias("rows"), F.countDistinct("fold_id").alias("folds"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    names = df.groupBy(*day).agg(F.count("*").alias("n")).groupBy(by).agg(F.count_if(F.col("n") < buckets).alias("dates_below_buckets"), F.count_if(F.col("n") < quintiles).alias("dates_below_quintiles"))
    n, sd = F.count("ic"), F.stddev_samp("ic")
    ics = rank_ic(df, *day).groupBy(by).agg(F.avg("ic").alias("mean_ic"), F.when(n > 1, F.try_divide(F.avg("ic"), F.try_divide(sd, F.sqrt(n.cast("double"))))).alias("ic_t_stat"))
    dealt = bucketed(df, buckets, *day)
    legs = long_short(dealt, buckets, 1, cost_bps, *day).groupBy(by).agg(*(F.avg(c).alias(c) for c in ("long_gross", "long_net", "short_gross", "short_net", "gross", "net", "long_hit_rate", "short_hit_rate")))
    best = top_names(df, top, by)
    fixed = best.groupBy(*day).agg(F.count("*").alias("k"), F.avg("fwd_ret_5d").alias("r")).groupBy(by).agg(F.count("*").alias("top_days"), F.avg("k").alias("top_names"), F.avg("r").alias("top_gross"), (F.avg("r") - cost_bps / 1e4).alias("top_net"))
    changed = turnover(best, by).groupBy(by).agg(F.avg("turnover").alias("top_turnover"))
    decile = turnover(dealt.where(F.col("bucket") == buckets), by).groupBy(by).agg(F.avg("turnover").alias("decile_turnover"))
    out = base
    for part in (used, names, ics, legs, fixed, changed, decile):
        out = out.join(part, by, "left")
    return out.fillna(0, ["rows", "folds", "dates_below_buckets", "dates_below_quintiles", "top_days"])


def gate_inputs(preds: DataFrame, by: str = "model", outlier: float = 5.0) -> DataFrame:
    """The metrics that the gate judges, a row per value of `by`, with the metrics' own warnings and blockers."""
    found = metrics(preds, by)
    used = preds.where("score IS NOT NULL AND fwd_ret_5d IS NOT NULL")
    scores = used.groupBy(by).agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    by_fold = used.groupBy(by, "fold_id").agg(F.max(F.abs("score")).alias("_m")).where(F.col("_m") > outlier)
    extreme = by_fold.groupBy(by).agg(F.collect_set(F.concat(F.lit("fold_"), "fold_id", F.lit("_score_outlier"))).alias("_folds"))  # at most a fold each
    said = lambda n, text: F.when(F.col(n) > 0, text)
    warned = F.array_compact(F.array(said("missing_rows", "missing_or_null_prediction_rows"), said("dates_below_buckets", "dates_with_too_few_names_for_deciles"), said("dates_below_quintiles", "dates_with_too_few_names_for_quintiles")))
    blocked = F.array_compact(F.array(F.when(F.col("rows") == 0, "missing_oos_predictions")))
    met = found.join(scores, by, "left").join(extreme, by, "left")
    return met.select(
        by, F.col("rows").alias("total_oos_rows"), F.col("folds").alias("fold_count"), F.col("mean_ic").alias("mean_daily_rank_ic"), F.col("ic_t_stat").alias("rank_ic_t_stat"),
        F.col("net").alias("long_short_net_return"), F.col("long_net").alias("top_decile_net_return"), F.col("short_net").alias("bottom_decile_net_short_return"), "score_min", "score_max",
        F.array_union(warned, F.coalesce("_folds", F.array().cast("array<string>"))).alias("metric_warnings"), blocked.alias("metric_blockers"),
    )


def gate(found: DataFrame, settings: dict = R.GATE, rules: dict[str, list[R.Rule]] = R.GATE_RULES, failures: tuple[str, ...] = ()) -> DataFrame:
    """gate_inputs()' rows (any number) with status (FAIL, PASS_WITH_WARNINGS, PASS), passed, failures in the rules' order after
    the given ones, warnings by name, recommendation and next_stage. Nothing is collected; without a row there is no verdict."""
    none = F.array().cast("array<string>")
    low, high = (F.abs(F.coalesce(c, F.lit(0.0))) for c in ("score_min", "score_max"))
    facts = found.withColumns({"has_blockers": F.size(F.coalesce("metric_blockers", none)) > 0, "max_abs_score": F.greatest(low, high)})
    given = F.array(*map(F.lit, failures)).cast("array<string>")
    carried = F.transform(F.coalesce("metric_warnings", none), lambda w: F.concat(F.lit("metrics_warning:"), w))
    out = facts.withColumns({"failures": F.concat(given, R.all_verdicts(rules["failures"], settings)), "warnings": F.array_sort(F.array_union(carried, R.all_verdicts(rules["warnings"], settings)))})
    failed = F.size("failures") > 0
    out = out.withColumns({"status": F.when(failed, "FAIL").when(F.size("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"), "passed": ~failed})
    return out.withColumns({"recommendation": F.when(failed, "stop_and_inspect_pipeline_model_data").otherwise("proceed_to_feature_expansion"), "next_stage": F.when(~failed, "feature_expansion")}).drop("has_blockers", "max_abs_score")
