"""Folds that fail alone: what is done stays, what failed is told, and to resume computes only that."""

import datetime as dt
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlark import __main__ as cli
from pitlark.operators import walkforward as W
from pitlark.sources import folds as L
from pitlark.sources import publish as P
from pitlark.sources import store as S


def made(spark, fold_id, rows=3):
    return spark.range(rows).selectExpr("date_add(date'2020-01-01', int(id)) AS date", "concat('T', id) AS ticker", "1 AS target", "0.5D AS fwd_ret_5d", f"1D * {fold_id} + id AS score", "1D AS rank_pct", "1 AS long_rank", "1 AS short_rank", f"{fold_id} AS fold_id")


def broken(spark, fold_id):
    """Fails in a task, after the job has begun."""
    return made(spark, fold_id).selectExpr("date", "ticker", "target", "fwd_ret_5d", "if(score > 3, raise_error('no such luck'), score) AS score", "rank_pct", "long_rank", "short_rank", "fold_id")


def there(spark, path):
    return {r["fold_id"]: r["n"] for r in S.read_or_empty(spark, path, S.FOLD_PREDICTIONS).groupBy("fold_id").count().withColumnRenamed("count", "n").collect()}


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame([(1,), (2,), (3,)], "fold_id int")


def test_one_of_three_fails_and_is_resumed(spark, plan, tmp_path):
    path, calls = str(tmp_path / "p"), []

    def score(good):
        def run(fold):
            calls.append(fold["fold_id"])
            return made(spark, fold["fold_id"]) if good or fold["fold_id"] != 2 else broken(spark, 2)

        return run

    with pytest.raises(L.FoldsFailed, match=r"1 fold\(s\) failed: \[2\]") as failure:
        L.run_folds(plan, score(False), path)
    assert [o["status"] for o in failure.value.outcomes] == ["done", "failed", "done"] and "no such luck" in failure.value.outcomes[1]["error"]
    assert there(spark, path) == {1: 3, 3: 3} and sorted(calls) == [1, 2, 3]
    events = {(e["fold_id"], e["event"]): e for e in L.Ledger(P.Folder(spark, path)).events()}
    assert set(events) == {(1, "started"), (1, "done"), (2, "started"), (2, "failed"), (3, "started"), (3, "done")}
    assert events[3, "done"]["prediction_rows"] == 3 and events[3, "done"]["score_mean"] == 4.0 and "no such luck" in events[2, "failed"]["error"]
    calls.clear()
    got = {r["fold_id"]: r for r in L.run_folds(plan, score(True), path, resume=True).collect()}
    assert calls == [2] and [got[i]["resumed"] for i in (1, 2, 3)] == [True, False, True] and there(spark, path) == {1: 3, 2: 3, 3: 3}
    assert got[1]["score_std"] == pytest.approx(np.std([1, 2, 3])) and got[1]["first_date"] == dt.date(2020, 1, 1) and got[2]["last_date"] == dt.date(2020, 1, 3)
    assert not (tmp_path / "p/_staging").exists()


def test_stop_leaves_the_rest_undone(spark, plan, tmp_path):
    path = str(tmp_path / "p")
    with pytest.raises(L.FoldsFailed) as failure:
        L.run_folds(plan, lambda fold: (broken if fold["fold_id"] == 2 else made)(spark, fold["fold_id"]), path, on_error="stop", at_once=1)
    assert [o["status"] for o in failure.value.outcomes] == ["done", "failed", "not started"] and there(spark, path) == {1: 3}


def test_stop_cancels_what_runs(spark, plan, tmp_path):
    def slow(batches):
        for batch in batches:
            time.sleep(120)
            yield batch

    def score(fold):
        rows = made(spark, fold["fold_id"])
        if fold["fold_id"] == 1:
            return rows.mapInArrow(slow, rows.schema)
        time.sleep(3)  # the first one's job runs by then
        return broken(spark, 2) if fold["fold_id"] == 2 else rows

    began = time.time()
    with pytest.raises(L.FoldsFailed, match=r"\[2\]") as failure:
        L.run_folds(plan, score, str(tmp_path / "p"), on_error="stop", at_once=2)
    assert time.time() - began < 60 and [o["status"] for o in failure.value.outcomes] == ["cancelled", "failed", "not started"]
    assert there(spark, str(tmp_path / "p")) == {}


def test_a_killed_run_leaves_the_old_fold_readable(spark, plan, tmp_path):
    path = str(tmp_path / "p")
    L.run_folds(plan, lambda fold: made(spark, fold["fold_id"]), path)
    with pytest.raises(L.FoldsFailed):
        L.run_folds(plan, lambda fold: broken(spark, fold["fold_id"]) if fold["fold_id"] == 3 else made(spark, fold["fold_id"], 5), path)
    assert there(spark, path) == {1: 5, 2: 5, 3: 3}  # whole before, whole after
    # a fold whose files are not those that were written is computed again, and so is one that was begun and never ended
    next((tmp_path / "p/fold_id=1").glob("*.parquet")).unlink()
    done = {r["fold_id"]: r["resumed"] for r in L.run_folds(plan, lambda fold: made(spark, fold["fold_id"], 7), path, resume=True).collect()}
    assert done == {1: False, 2: True, 3: False} and there(spark, path) == {1: 7, 2: 5, 3: 7}


def test_the_command_writes_summaries_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(0)
    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(d), f"T{t}", float(rng.normal()), int(rng.integers(-1, 2)), float(rng.normal()), float(rng.normal())) for d in range(40) for t in range(5)]
    spark.createDataFrame(rows, "date date, ticker string, fwd_ret_5d double, target_class_5d int, f1 double, f2 double").write.parquet(str(tmp_path / "matrix"))
    command = ["folds", str(tmp_path / "matrix"), str(tmp_path / "out"), "--train", "15", "--test", "5", "--purge", "2", "--features", "f1,f2"]
    cli.main([*command, "--max-folds", "2"])
    cli.main([*command, "--resume", "--on-error", "stop"])
    got = spark.read.csv(str(tmp_path / "out/folds"), header=True, inferSchema=True).orderBy("fold_id").collect()
    assert [(r["fold_id"], r["resumed"], r["prediction_rows"]) for r in got] == [(1, True, 25), (2, True, 25), (3, False, 25), (4, False, 25)]
    facts = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "out/folds_summary")).collect()))
    assert facts["folds_completed"] == 4 and facts["total_oos_rows"] == 100 and facts["feature_count"] == 2
    with pytest.raises(ValueError, match="not to be used"):
        W.RidgeWalk(spark.read.parquet(str(tmp_path / "matrix")), spark.createDataFrame([], "fold_id int, train_start_date date, train_end_date date"), ["fwd_ret_5d"])
    cli.main(["metrics", str(tmp_path / "out/predictions"), str(tmp_path / "judged")])
    assert spark.read.csv(str(tmp_path / "judged/fold_metrics"), header=True).count() == 4 and spark.read.csv(str(tmp_path / "judged/metrics"), header=True).first()["rows"] == "100"
    cli.main(["discover", *command[1:2], str(tmp_path / "found"), *command[3:], "--max-folds", "2"])
    by_fold = spark.read.csv(str(tmp_path / "found/discovery_by_fold"), header=True).collect()
    assert {(r["fold_id"], r["feature"]) for r in by_fold} == {(i, f) for i in "12" for f in ("f1", "f2")} and all(r["fold_rank_ic"] and r["mean_daily_rank_ic"] for r in by_fold)
    assert spark.read.csv(str(tmp_path / "found/correlations"), header=True).count() == 1 and set(json.loads(spark.read.csv(str(tmp_path / "found/discovery"), header=True).first()["fold_ics"])) == {"1", "2"}
    cli.main(["gate", str(tmp_path / "out/predictions"), str(tmp_path / "judged")])
    verdict = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "judged/gate")).collect()))
    assert verdict["status"] == "FAIL" and verdict["total_oos_rows"] == 100 and "total_oos_rows_below_threshold" in verdict["failures"]
    cli.main(["gate", str(tmp_path / "nothing"), str(tmp_path / "judged")])
    verdict = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "judged/gate")).collect()))
    assert verdict["failures"][0] == "metrics_file_missing"


def test_what_is_checked_is_written_in_the_same_pass(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).mapInArrow(counted, "id long")
    facts = {"rows": F.count(F.lit(1)), "most": F.max("id"), "odd": F.count_if(F.col("id") % 2 == 1)}
    path = str(tmp_path / "out")
    got = P.publish(rows, path, facts, then=lambda df: df.where("id < 10"))
    assert got == {"rows": 1000, "most": 999, "odd": 500} and read.value == 1000 and spark.read.parquet(path).count() == 10 and P.is_whole(spark, path)
    with pytest.raises(P.Refused, match="500 odd"):
        P.publish(rows, path, facts, lambda f: [f"{f['odd']} odd"])
    with pytest.raises(Exception, match="no such luck"):
        P.publish(spark.range(9).selectExpr("if(id > 5, raise_error('no such luck'), id) AS id"), path, facts)
    assert spark.read.parquet(path).count() == 10 and [p.name for p in tmp_path.iterdir()] == ["out"]  # as it was, and nothing left behind
    next((tmp_path / "out").glob("*.parquet")).unlink()
    assert not P.is_whole(spark, path) and not P.is_whole(spark, str(tmp_path / "none"))
    P.publish(rows, path, facts)
    assert P.is_whole(spark, path) and spark.read.parquet(path).count() == 1000


def test_a_snapshot_is_imported_whole_or_not_at_all(spark, tmp_path):
    head = "snapshot_date,underlying_ticker,option_symbol,expiration,strike,call_put,bid,ask,data_source\n"
    good = tmp_path / "s1.csv"
    good.write_text(head + "2020-01-02,aaa,O1,2020-01-20,10,call,2,4,s\n2020-01-02,bbb,O2,2020-01-20,10,put,2,4,s\n")
    (tmp_path / "s2.csv").write_text(head + "2020-01-02,aaa,O1,2020-01-20,10,call,5,4,s\n" * 2)
    (tmp_path / "c.csv").write_text("ticker,score_date,side\nAAA,2020-01-02,long\n")
    out = str(tmp_path / "out")
    cli.main(["options", str(tmp_path), out, "--snapshot", str(good), "--candidates", str(tmp_path / "c.csv"), "--root", str(tmp_path)])
    told = json.loads("\n".join(r[0] for r in spark.read.text(f"{out}/import_summary").collect()))
    assert (told["rows"], told["linked_rows"], told["unlinked_option_rows"], told["snapshot_matches_score_date_rows"], told["missing_volume"], told["first_snapshot_date"]) == (2, 1, 1, 1, 2, "2020-01-02")
    assert (tmp_path / "out/snapshots/s1.csv").read_bytes() == good.read_bytes() and spark.read.parquet(f"{out}/linked").count() == 2
    with pytest.raises(P.Refused, match="crossed: 2 rows; duplicate: 2 rows"):
        cli.main(["options", str(tmp_path), out, "--snapshot", str(tmp_path / "s2.csv"), "--root", str(tmp_path)])
    assert spark.read.parquet(f"{out}/options").count() == 2
