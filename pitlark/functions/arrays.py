"""Arrays of numbers that tasks merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of tasks whose shares of a key are merged apart, so that one key is no one task's work.
GROUPS = 32


def merged(shares: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """shares(key long, data binary), data being doubles, as many for every row of a key -> per key all of them combined. Tasks'
    shares of a key are merged in two steps, in GROUPS groups first, as they stream in; no task holds more than its keys'
    results, and the driver gets one array a key."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(data.as_buffer())
                found[key] = combine(found[key], one) if key in found else one
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["key", "data"])

    some = shares.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    once = some.repartition("key", "_group").select("key", "data").mapInArrow(add, "key long, data binary")
    return {r["key"]: np.frombuffer(r["data"]) for r in once.repartition("key").mapInArrow(add, "key long, data binary").collect()}


def summed(shares: DataFrame) -> dict[int, np.ndarray]:
    """Per key the sum of all shares."""
    return merged(shares, np.add)


_NONE = np.iinfo(np.int64).min


def packed(x: np.ndarray) -> bytes:
    """Doubles rounded to 9 decimals, without loss beyond that: as whole billionths, bytes of one place together, compressed; as
    doubles where they are too large or infinite for that."""
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.rint(x * 1e9)
    there = ~np.isnan(x)
    small = bool((np.abs(whole[there]) < 2**53).all())
    plain = np.where(there, whole, _NONE).astype(np.int64) if small else np.round(x, 9)
    return bytes([small]) + pa.compress(np.ascontiguousarray(plain.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The n doubles of packed()."""
    plain = np.ascontiguousarray(np.frombuffer(pa.decompress(data[1:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1).T)
    if not data[0]:
        return plain.view(np.float64).ravel()
    whole = plain.view(np.int64).ravel()
    return np.where(whole == _NONE, np.nan, whole / 1e9)


def held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have some rows."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(b.num_rows for b in kept) >= rows:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept = []
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()
