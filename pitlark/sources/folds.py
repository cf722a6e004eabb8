"""Folds that are computed side by side, fail alone and are written whole or not at all.

Every fold is a Spark job of its own with a tag, in a pool of the fair scheduler, so folds share the cluster and one can be
cancelled. Its rows go to a staging folder, are counted while they are written, and are published by renaming the folder. What
happened to a fold is told in the ledger, a small file per event: started, and then done (with its summary and the names
and lengths of its files), failed or cancelled. To resume trusts the ledger where its files are there, not the folder.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from .publish import Folder, data_files
from .store import json_safe

OUTCOME = "fold_id int, status string, resumed boolean, prediction_rows long, score_mean double, score_std double, score_min double, score_max double, first_date date, last_date date, seconds double, error string"
_SUMMARY = ("prediction_rows", "score_mean", "score_std", "score_min", "score_max", "first_date", "last_date")


class FoldsFailed(RuntimeError):
    """Raised at the end, when all that could be done is done; `failed` has the ids, `outcomes` all folds."""

    def __init__(self, failed: list[int], outcomes: list[dict]):
        super().__init__(f"{len(failed)} fold(s) failed: {failed}")
        self.failed, self.outcomes = failed, outcomes


class Ledger:
    """What happened to folds, below `_ledger`: a file per fold and event, the latest run's in place of earlier ones."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def tell(self, fold_id: int, event: str, **facts) -> None:
        self.folder.put(f"_ledger/{fold_id:05d}-{event}.json", json.dumps(json_safe({"fold_id": fold_id, "event": event, "at": time.time(), **facts}), sort_keys=True))

    def forget(self, fold_id: int) -> None:
        for event in ("started", "done", "failed", "cancelled"):
            self.folder.delete(f"_ledger/{fold_id:05d}-{event}.json")

    def events(self) -> list[dict]:
        return [json.loads(self.folder.read(f"_ledger/{n}")) for n in sorted(self.folder.files("_ledger")) if n.endswith(".json")]

    def whole(self) -> dict[int, dict]:
        """The folds that are done and whose files are there as they were written."""
        done = {e["fold_id"]: e for e in self.events() if e["event"] == "done"}
        return {i: e for i, e in done.items() if e["files"] and e["files"] == data_files(self.folder.files(f"fold_id={i}"))}


def run_folds(plan: DataFrame, score: Callable[[Row], DataFrame], path: str, resume: bool = False, on_error: str = "continue", at_once: int = 4) -> DataFrame:
    """Writes score(fold), one row of the plan, below path as fold_id=N for every fold of the plan, `at_once` of them side by
    side, and returns OUTCOME, a row per fold.

    A fold that fails is told in the ledger with its error. With on_error "continue" the others go on and FoldsFailed is raised
    at the end; with "stop" running folds are cancelled, none is begun, and then it is raised. With resume, folds that are
    whole are not computed again. Without it what is there of a fold is replaced once its new rows are written."""
    if on_error not in ("continue", "stop"):
        raise ValueError("on_error is continue or stop")
    spark = plan.sparkSession
    sc, run = spark.sparkContext, uuid.uuid4().hex
    folder = Folder(spark, path)
    ledger = Ledger(folder)
    whole = ledger.whole() if resume else {}
    stopping, lock, tags = threading.Event(), threading.Lock(), set()

    def cancel_all() -> None:
        stopping.set()
        with lock:
            for tag in tags:
                sc.cancelJobsWithTag(tag)

    def work(fold: Row) -> dict:
        i, began, staged = fold["fold_id"], time.time(), f"_staging/{run}-{fold['fold_id']}"
        told = {"fold_id": i, "resumed": False}
        if i in whole:
            return {**told, **{k: whole[i][k] for k in (*_SUMMARY, "seconds")}, "resumed": True, "status": "done"}
        if stopping.is_set():
            return {**told, "status": "not started"}
        tag = f"fold-{i}-{run}"
        with lock:
            tags.add(tag)
        try:
            sc.setLocalProperty("spark.scheduler.pool", f"fold-{i}")
            sc.addJobTag(tag)
            ledger.forget(i)
            ledger.tell(i, "started", run=run)
            seen = Observation(tag)
            rows = score(fold).observe(
                seen, F.count(F.lit(1)).alias("prediction_rows"), F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
            )
            rows.drop("fold_id").hint("rebalance").write.parquet(f"{path.rstrip('/')}/{staged}")
            if stopping.is_set():
                raise InterruptedError("cancelled")
            facts = seen.get
            folder.publish(staged, f"fold_id={i}")
            found = {**{k: facts[k] for k in _SUMMARY}, "seconds": time.time() - began}
            ledger.tell(i, "done", run=run, files=data_files(folder.files(f"fold_id={i}")), **found)
            return {**told, **found, "status": "done"}
        except Exception as error:
            folder.delete(staged)
            status = "cancelled" if stopping.is_set() else "failed"
            text = f"{type(error).__name__}: {error}".split("\n")[0][:500]
            ledger.tell(i, status, run=run, error=text, seconds=time.time() - began)
            if status == "failed" and on_error == "stop":
                cancel_all()
            return {**told, "status": status, "error": text, "seconds": time.time() - began}
        finally:
            with lock:
                tags.discard(tag)
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.scheduler.pool", None)

    folds = sorted(plan.collect(), key=lambda r: r["fold_id"])  # one row a fold
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        outcomes = list(pool.map(work, folds))
    folder.delete("_staging")
    failed = [o["fold_id"] for o in outcomes if o["status"] == "failed"]
    if failed:
        raise FoldsFailed(failed, outcomes)
    return outcome_table(spark, outcomes)


def outcome_table(spark: SparkSession, outcomes: list[dict]) -> DataFrame:
    import datetime as dt

    names = [x.split()[0] for x in OUTCOME.split(", ")]
    day = lambda v: dt.date.fromisoformat(v) if isinstance(v, str) else v
    return spark.createDataFrame([tuple(day(o.get(n)) if n.endswith("_date") else o.get(n) for n in names) for o in outcomes], OUTCOME)
