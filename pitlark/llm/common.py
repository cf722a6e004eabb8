"""Shared pieces of the training-data operators: tables, lineage cuts, splits and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here and survives a lost executor. The folder's tables
    are deleted when the driver ends."""
    return settled(df)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text (remainder 0)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most about `rows` rows, chosen by a hash of `key`: the same rows however the table is split.

    One count, then a filter; no sort. Only for fitting on labelled rows.
    """
    total = df.count()
    if total <= rows:
        return df
    keep = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < keep)


def bounded_repeats(sample: DataFrame, most: int = 4) -> DataFrame:
    """At most `most` different texts of each doc_id, for fitting on labelled rows: ids that repeat do not swell the sample."""
    found = sample.groupBy(*(c for c in sample.columns if c != "text"), F.pmod(F.xxhash64("text"), F.lit(most)).alias("_part")).agg(F.min("text").alias("text"))
    return found.select(sample.columns)


def connected_components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) links of long ids -> (node, component), component being the smallest id reachable.

    Large-star / small-star rounds: each node's neighbours are joined to its smallest neighbour until
    nothing changes, O(log^2 n) rounds. Every round is two aggregations and joins; each is written to the
    shared folder, so no lineage piles up and no link list reaches the driver. Self links and null ids are ignored;
    nodes without links are not returned.
    """
    edges = pairs.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    current = materialize(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = _mark(current)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
        current = materialize(small.where("src <> dst").distinct())
        mark, before = _mark(current), mark
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return stars.unionByName(current.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first()
    return row[0], row[1] or 0
