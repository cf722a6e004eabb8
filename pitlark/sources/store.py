"""Sinks: partitioned and fold-wise Parquet, reports, and intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import json
import math
import os
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOTS: dict[str, str] = {}
#: Removes an execution's shuffle files when it ends (Spark 4.1).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, removed when the driver ends. Where that is unset, a temporary folder
    of this machine if the master is local (as in tests), an error on a cluster: its executors share no such folder."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='pitlark-')}"
        _ROOTS[app] = f"{base.rstrip('/')}/pitlark-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes an application's intermediate tables; a session that is stopped already leaves them to its folder's owner."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM is gone
        if path.startswith("file://"):
            shutil.rmtree(path[len("file://") :], ignore_errors=True)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: several readers share one computation, and a lost executor loses none of
    it. What was shuffled on the way is removed at the end, where Spark has a setting for that."""
    spark, path = df.sparkSession, f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        if before is not None:
            spark.conf.set(CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files below path with the given columns; no rows where the path does not exist. Other siblings are ignored."""
    try:
        return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def guard(path: str, root: str, forbidden: str = "raw_txt", source: str | None = None) -> str:
    """path, if it lies inside root, outside raw data and outside what is read; nothing else may be overwritten. Paths with a
    scheme are compared as they stand."""
    if "://" in path or "://" in root:
        inside = os.path.normpath(path).startswith(os.path.normpath(root) + os.sep)
        if not inside or forbidden in path.split("/") or (source and os.path.normpath(source).startswith(os.path.normpath(path) + os.sep)):
            raise ValueError(f"not a place for outputs: {path}")
        return path
    if source and (os.path.realpath(source) + os.sep).startswith(os.path.realpath(path) + os.sep):
        raise ValueError(f"not a place for outputs, as it holds the input: {path}")
    real, base = os.path.realpath(path), os.path.realpath(root)
    if real == base or not real.startswith(base + os.sep) or forbidden in real[len(base):].split(os.sep):
        raise ValueError(f"not a place for outputs: {path}")
    return path


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrites the partitions by keys. Rows are dealt by key first, so a partition has few files; AQE splits a large one."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file; for reports of a few rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def json_safe(x):
    """x with NaN and infinity as null and dates as text."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set):
        return [json_safe(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x if x is None or isinstance(x, bool | int | str) else str(x)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short text through Spark's file systems, so path may be any store."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value, path: str) -> None:
    write_text(spark, json.dumps(json_safe(value), indent=2, sort_keys=True), path)


def markdown(title: str, facts: dict, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """A report of facts and of the first `rows` rows of small tables."""
    out = [f"# {title}", "", *(f"- {k}: {v}" for k, v in json_safe(facts).items())]
    for name, df in tables.items():
        found = df.limit(rows).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join("" if v is None else str(json_safe(v)) for v in r) + " |" for r in found)]
    return "\n".join(out) + "\n"


FOLD_PREDICTIONS = "date date, ticker string, target int, fwd_ret_5d double, score double, rank_pct double, long_rank int, short_rank int, fold_id int"


def select_folds(plan: DataFrame, fold_id: int | None = None, max_folds: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """The folds asked for: one by id, or a range, or the first few."""
    if fold_id is not None:
        plan = plan.where(F.col("fold_id") == fold_id)
    if start is not None:
        plan = plan.where(F.col("fold_id") >= start)
    if end is not None:
        plan = plan.where(F.col("fold_id") <= end)
    return plan if max_folds is None else plan.orderBy("fold_id").limit(max_folds)


def provenance(spark: SparkSession, path: str, hash_up_to: int = 25_000_000) -> DataFrame:
    """Size, time and SHA-256 of every file below path; larger files than `hash_up_to` are listed without a hash, unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    facts = ("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    small = files.where(F.col("length") <= hash_up_to).select(*facts, F.sha2("content", 256).alias("sha256"))
    return small.unionByName(files.where(F.col("length") > hash_up_to).select(*facts, F.lit(None).cast("string").alias("sha256")))
