"""Command line: python -m pitlark COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import discovery as D
from .operators import evaluation as E
from .operators import features as X
from .operators import options as O
from .operators import panel as P
from .operators import ranks as N
from .operators import rules as U
from .operators import walkforward as W
from .plans import queries as K
from .sources import archives as R
from .sources import bars as B
from .sources import folds as L
from .sources import publish as H
from .sources import store as S


def validate(spark, a):
    """Raw text to valid bars by year, rejected rows per reason, and the counts."""
    raw = B.read_raw(spark, a.input)
    if a.limit:  # whole files, the first by name
        raw = raw.join(F.broadcast(raw.select("source_file").distinct().orderBy("source_file").limit(a.limit)), "source_file")
    found = S.settled(B.validate(raw))
    S.write_by(B.valid_bars(found), f"{a.output}/bars", "year")
    S.write_csv(B.reject_counts(found).orderBy("reason"), f"{a.output}/rejects")
    B.reject_details(found).write.mode("overwrite").parquet(f"{a.output}/reject_details")
    B.zero_volume_warnings(found).write.mode("overwrite").parquet(f"{a.output}/warnings")
    S.write_csv(B.validation_summary(found).orderBy("source_file"), f"{a.output}/files")
    S.write_csv(B.rejected_files(spark, a.input).orderBy("source_file"), f"{a.output}/rejected_files")


def manifest(spark, a):
    """Raw text files with digests, rows and spans of dates."""
    found = S.settled(R.file_manifest(spark, a.input))
    S.write_csv(found.orderBy("source_file"), f"{a.output}/manifest")
    S.write_json(spark, R.manifest_summary(found).first().asDict(), f"{a.output}/manifest_summary")


def listing(spark, a):
    """A listing of symbols over HTTP (INPUT is the address) to Parquet, with rows by status and state."""
    found = S.settled(R.fetch_listing(spark, a.input, a.asof, **{k: v for k, v in (("key_env", a.key_env), ("key_file", a.key_file), ("date", a.date), ("pause", a.pause)) if v}))
    R.listing_export(found).coalesce(1).write.mode("overwrite").parquet(f"{a.output}/listing")
    S.write_csv(R.listing_counts(found).orderBy("what", "value"), f"{a.output}/listing_counts")


def export(spark, a):
    df = R.strict_export(B.read_raw(spark, a.input))
    df.repartition("ticker_path").sortWithinPartitions("ticker_path", "market", "year", "date", "time").write.mode("overwrite").partitionBy("ticker_path").parquet(f"{a.output}/tickers")


def archives(spark, a):
    found = S.settled(R.inventory(R.read_members(spark, a.input)))
    found.write.mode("overwrite").parquet(f"{a.output}/inventory")
    profile = R.schema_profile(found).orderBy("archive", "kind")
    whole = R.archive_profile(found).first().asDict(recursive=True)
    S.write_json(spark, whole, f"{a.output}/profile")
    S.write_text(spark, S.markdown("Archives", {"members": whole["total_inner_files"]}, {"Kinds": profile}), f"{a.output}/report")


def panel(spark, a):
    """Bars by year to the labelled panel and the feature matrix, with a summary of both."""
    bars = spark.read.parquet(a.input)
    S.write_by(P.label(P.universe(P.gate(bars))).withColumn("year", F.year("date")), f"{a.output}/labelled", "year")
    labelled = spark.read.parquet(f"{a.output}/labelled").drop("year")
    X.baseline(labelled).write.mode("overwrite").parquet(f"{a.output}/matrix")
    matrix = spark.read.parquet(f"{a.output}/matrix")
    nulls = {r["feature"]: r["nulls"] for r in X.null_counts(matrix, X.BASELINE_NAMES).collect()}
    S.write_json(spark, {"rows": matrix.count(), "null_counts": nulls, **P.label_reasons(labelled).first().asDict()}, f"{a.output}/summary")


def folds(spark, a):
    """A feature matrix to predictions by fold, several folds side by side; what a fold came to is written when it ends."""
    matrix, features = spark.read.parquet(a.input), a.features.split(",")
    plan = S.settled(S.select_folds(W.plan(matrix, W.FoldConfig(a.train, a.test, a.test, a.purge)), a.fold_id, a.max_folds, a.start_fold, a.end_fold))
    path = f"{a.output}/predictions"
    whole = L.Ledger(H.Folder(spark, path)).whole() if a.resume else {}
    left = plan.where(~F.col("fold_id").isin(list(whole)))  # only these are fitted
    walk = W.RidgeWalk(matrix, left, features) if left.limit(1).count() else None
    try:
        done = L.run_folds(plan, lambda fold: walk.score(fold["fold_id"]), path, a.resume, a.on_error, a.at_once)
    except L.FoldsFailed as failure:
        S.write_csv(L.outcome_table(spark, failure.outcomes).orderBy("fold_id"), f"{a.output}/folds")
        raise
    S.write_csv(done.orderBy("fold_id"), f"{a.output}/folds")
    facts = done.agg(F.count("*").alias("folds_completed"), F.sum("prediction_rows").alias("total_oos_rows"), F.min("first_date").alias("min_prediction_date"), F.max("last_date").alias("max_prediction_date")).first().asDict()
    S.write_json(spark, {**facts, "feature_count": len(features), "model_type": "ridge_regression"}, f"{a.output}/folds_summary")


def matrix(spark, a):
    """The labelled panel to the matrix of a feature set, with the registry of its columns."""
    labelled = spark.read.parquet(a.input)
    found, features, target = X.feature_set(labelled.drop("year"), a.set, a.scoring)
    found.write.mode("overwrite").parquet(f"{a.output}/{a.set}")
    groups = X.registry(found.columns, features, [target, "fwd_ret_5d", "label_valid_5d"], ["date", "ticker", "open", "high", "low", "close", "volume", "dollar_volume", "model_eligible"])
    X.check_model_inputs(features, groups)
    S.write_json(spark, {"features": groups.features, "targets": groups.targets, "metadata": groups.metadata, "excluded": groups.excluded}, f"{a.output}/{a.set}_columns")


def discover(spark, a):
    """A feature matrix to each feature's statistics by fold and over folds, and the correlations between features."""
    settings, _ = U.configured(a.config, U.SELECTION, U.SELECTION_RULES)
    found = S.settled(spark.read.parquet(a.input))
    features = [f for f in a.features.split(",") if not any(t in f.lower() for t in settings["leakage_tokens"])]
    plan = S.settled(S.select_folds(W.plan(found, W.FoldConfig(a.train, a.test, a.test, a.purge)), max_folds=a.max_folds))
    days = S.settled(D.by_date(found, features))
    daily, pooled = S.settled(D.daily_ic(days, plan)), S.settled(N.fold_correlations(found, plan, features))
    stats = S.settled(D.feature_stats(days, plan))
    S.write_csv(stats.join(daily, ["fold_id", "feature"], "left").join(pooled, ["fold_id", "feature"], "left").orderBy("fold_id", "feature"), f"{a.output}/discovery_by_fold")
    over = stats.groupBy("feature").agg(*(F.avg(c).alias(c) for c in ("non_null_pct", "finite_pct", "std")))
    S.write_csv(D.summary(daily, pooled).join(over, "feature").orderBy("feature"), f"{a.output}/discovery")
    pairs = D.correlations(found, plan, features, settings["correlation_sample_date_stride"], settings["correlation_sample_rows_per_fold"])
    S.write_csv(pairs.orderBy(F.desc("max_abs_corr"), "feature_a", "feature_b"), f"{a.output}/correlations")
    facts = plan.agg(F.count("*").alias("folds_used"), F.sum("train_rows").alias("train_rows"), F.min("train_start_date").alias("min_train_date"), F.max("train_end_date").alias("max_train_date")).first().asDict()
    S.write_json(spark, {**facts, "features_scored": len(features), "warnings": ["correlations are of a bounded sample of training dates and rows of each fold"]}, f"{a.output}/discovery_summary")


def metrics(spark, a):
    """Predictions by fold to their metrics: over all, by fold, by date and by bucket."""
    preds = S.settled(spark.read.schema(S.FOLD_PREDICTIONS).parquet(a.input).withColumn("model", F.lit(a.model)))
    used = preds.where("score IS NOT NULL AND fwd_ret_5d IS NOT NULL")
    S.write_csv(E.metrics(preds, "model"), f"{a.output}/metrics")
    S.write_csv(E.fold_metrics(preds).orderBy("fold_id"), f"{a.output}/fold_metrics")
    S.write_csv(E.rank_ic(used).orderBy("date"), f"{a.output}/rank_ic_by_date")
    S.write_csv(E.long_short(E.bucketed(used)).orderBy("date"), f"{a.output}/long_short_by_date")
    S.write_csv(E.bucket_profile(E.bucketed(used)).orderBy("bucket"), f"{a.output}/buckets")
    S.write_csv(E.score_stats(used), f"{a.output}/score_stats")


def select(spark, a):
    """A feature matrix to the selected features: judged by the configured rules, pruned by correlation, and frozen in a manifest."""
    settings, rules = U.configured(a.config, U.SELECTION, U.SELECTION_RULES)
    found = S.settled(spark.read.parquet(a.input))
    features = [f for f in a.features.split(",") if not any(t in f.lower() for t in settings["leakage_tokens"])]
    plan = W.plan(found, W.FoldConfig(a.train, a.test, a.test, a.purge))
    days = S.settled(D.by_date(found, features))
    pairs = S.settled(D.correlations(found, plan, features, settings["correlation_sample_date_stride"], settings["correlation_sample_rows_per_fold"]))
    chosen = S.settled(D.selected(S.settled(K.judged(found, plan, days, features, settings, rules["rejects"])), pairs, settings))
    S.write_csv(pairs.orderBy(F.desc("max_abs_corr"), "feature_a", "feature_b"), f"{a.output}/correlations")
    S.write_csv(chosen.orderBy("reject_reason", F.desc("selection_score"), "feature"), f"{a.output}/selection")
    names = [r["feature"] for r in chosen.where("selected").orderBy("rank").collect()]
    S.write_json(spark, D.freeze(names, {"train": a.train, "test": a.test, "purge": a.purge, "candidates": len(features), **settings}), f"{a.output}/frozen")


def gate(spark, a):
    """Predictions by fold to the metrics and the verdict of the configured gate. A file that is not there fails it."""
    settings, rules = U.configured(a.config, U.GATE, U.GATE_RULES, "baseline_h5")
    preds = S.read_or_empty(spark, a.input, S.FOLD_PREDICTIONS).withColumn("model", F.lit(a.model))
    found = E.gate_inputs(S.settled(preds), "model")
    missing = () if found.limit(1).count() else ("metrics_file_missing",)
    if missing:
        kinds = {f.name: f.dataType.simpleString() for f in found.schema}
        found = spark.range(1).select(*(F.lit(a.model if n == "model" else None).cast(k).alias(n) for n, k in kinds.items()))
    S.write_json(spark, E.gate(found, settings, rules, missing).first().asDict() | {"thresholds": settings}, f"{a.output}/gate")  # one model


def score(spark, a):
    """A scoring matrix (all rows) to the candidates of its last date, with counts by side."""
    panel = S.settled(spark.read.parquet(a.input))
    found = S.settled(W.signals(W.daily_scores(panel, a.features.split(",")), panel))
    S.write_csv(found.orderBy("bucket", "score", "ticker"), f"{a.output}/candidates")
    S.write_csv(W.signal_counts(found).orderBy("side"), f"{a.output}/sides")


def options(spark, a):
    """One snapshot (--snapshot), or all of a manifest: its files lie in the input folder."""
    if a.snapshot:
        raw = spark.read.csv(a.snapshot, header=True)
        plain = lambda df: df.drop(*(f"broken_{n}" for n in O.HARD_RULES))
        facts = H.publish(O.flagged(O.normalize(raw)), f"{a.output}/options", O.import_facts(), O.broken_rules, plain)  # one pass checks and writes
        H.Folder(spark, a.output).copy_from(a.snapshot, f"snapshots/{os.path.basename(a.snapshot)}")
        summary = {"input": a.snapshot, "schema_columns": O.SCHEMA, "required_core_columns": O.CORE, **facts}
        if a.candidates:
            candidates = spark.read.csv(a.candidates, header=True).withColumn("score_date", F.to_date("score_date"))
            linked = {"linked_rows": F.count_if("is_candidate"), "unlinked_option_rows": F.count_if(~F.col("is_candidate")), "snapshot_matches_score_date_rows": F.count_if("snapshot_matches_score_date")}
            summary |= H.publish(O.link(spark.read.parquet(f"{a.output}/options"), candidates), f"{a.output}/linked", linked)
        S.write_json(spark, summary, f"{a.output}/import_summary")
        return
    raw = spark.read.csv(a.input, header=True, pathGlobFilter="*.csv").withColumn("file_path", F.element_at(F.split(F.input_file_name(), "/"), -1))
    good, files = O.import_batch(raw, spark.read.csv(a.manifest, header=True))
    files = S.settled(files)
    S.write_csv(files.withColumn("reasons", F.array_join("reasons", ";")), f"{a.output}/files")
    if not files.where("status = 'ok'").limit(1).count():
        raise SystemExit("no snapshot could be imported")
    good.write.mode("overwrite").parquet(f"{a.output}/options")
    S.write_json(spark, O.batch_summary(spark.read.parquet(f"{a.output}/options"), files).first().asDict(), f"{a.output}/import_summary")


def query(spark, a):
    """A registered query over a folder of tables, written as Parquet."""
    K.queries()[a.name](spark, a.input).write.mode("overwrite").parquet(f"{a.output}/{a.name}")


def provenance(spark, a):
    S.provenance(spark, a.input).write.mode("overwrite").parquet(f"{a.output}/provenance")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pitlark")
    subs = top.add_subparsers(required=True)
    made = {}
    for f in (validate, manifest, listing, export, archives, panel, matrix, folds, discover, select, metrics, gate, score, options, query, provenance):
        made[f.__name__] = sub = subs.add_parser(f.__name__, help=(f.__doc__ or "").split("\n")[0])
        sub.add_argument("input")
        sub.add_argument("output")
        sub.add_argument("--root", help="folder that outputs must lie in")
        sub.set_defaults(run=f)
    made["validate"].add_argument("--limit", type=int)
    for name in ("key-env", "key-file", "date", "pause"):
        made["listing"].add_argument(f"--{name}")
    made["listing"].add_argument("--asof", required=True)
    for name in ("fold-id", "max-folds", "start-fold", "end-fold"):
        made["folds"].add_argument(f"--{name}", type=int)
    made["matrix"].add_argument("--set", default="baseline", choices=sorted(X.FEATURE_SETS))
    made["matrix"].add_argument("--scoring", action="store_true")
    made["discover"].add_argument("--max-folds", type=int)
    for command in ("folds", "discover", "select"):
        for name, value in (("train", 500), ("test", 63), ("purge", 5)):
            made[command].add_argument(f"--{name}", type=int, default=value)
    for command in ("discover", "select", "gate"):
        made[command].add_argument("--config", help="settings and rules, YAML or JSON")
    for command in ("metrics", "gate"):
        made[command].add_argument("--model", default="baseline")
    for command in ("folds", "discover", "select", "score"):
        made[command].add_argument("--features", default=",".join(K.RIDGE_FEATURES))
    made["folds"].add_argument("--resume", action="store_true", help="leave folds that are whole as they are")
    made["folds"].add_argument("--on-error", default="continue", choices=("continue", "stop"))
    made["folds"].add_argument("--at-once", type=int, default=4, help="folds that are computed side by side")
    one = made["options"].add_mutually_exclusive_group(required=True)
    one.add_argument("--snapshot")
    one.add_argument("--manifest")
    made["options"].add_argument("--candidates", help="the candidates of a score date, to link a snapshot with")
    made["query"].add_argument("name", choices=sorted(K.queries()))
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    S.guard(a.output, a.root or os.path.dirname(os.path.abspath(a.output) if "://" not in a.output else a.output), source=a.input)
    spark = SparkSession.builder.appName("pitlark").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    a.run(spark, a)
    print(json.dumps({"done": a.run.__name__, "output": a.output}))


if __name__ == "__main__":
    main()
