"""Vector codes: product quantization of integer vectors, fitted by tree aggregation over blocks of columns.

Vectors are kept as blocks of a bounded number of rows, one array per component. In each round a task accumulates the
distances of a block to its part's codebook component by component, adds the parts up per entry in int64 sums and
counts (`np.add.at`), and these tensors, whose size depends on the codebook alone, merge through a reduction tree.
Everything is integer arithmetic, so no result depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, and rows of it whose distances are held at once.
BLOCK_ROWS, STEP_ROWS = 4096, 512
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Shape:
    """width: components of a part; kind: what distances are added up in, wide enough for the table's largest component."""

    width: int
    parts: int
    kind: type

    @classmethod
    def of(cls, length: int, largest: float, parts: int) -> Shape:
        width = -(-length // parts)
        most = max(1, width) * (2 * (min(largest, 1e100) * SCALE + 2)) ** 2
        return cls(width, parts, np.int32 if most < 2**31 else np.int64 if most < 2**62 else object)

    def integers(self, rows: list[np.ndarray]) -> np.ndarray:
        """(parts, width, rows) of floor(SCALE * x); shorter vectors are filled up with zeros."""
        flat = np.zeros((len(rows), self.parts * self.width), object if self.kind is object else np.int64)
        for i, row in enumerate(rows):
            if self.kind is object:  # the product may be no finite double
                flat[i, : len(row)] = [math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE for x in row.tolist()]
            else:
                flat[i, : len(row)] = np.floor(row * SCALE).astype(np.int64)
        return np.ascontiguousarray(flat.T.reshape(self.parts, self.width, len(rows)))

    def pack(self, block: np.ndarray) -> bytes:
        return "\n".join(map(str, block.ravel())).encode() if self.kind is object else block.astype(self.kind).tobytes()

    def unpack(self, data: bytes, rows: int) -> np.ndarray:
        flat = np.array([int(x) for x in bytes(data).split()] if self.kind is object else np.frombuffer(data, self.kind), self.kind)
        return flat.reshape(self.parts, self.width, rows)


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One part's rows (width, rows) against its codebook (width, entries): the nearest entry (lowest index of equal
    ones) and the squared distance of each row."""
    rows, entries = block.shape[1], book.shape[1]
    at, far = np.empty(rows, np.int64), np.empty(rows, object if block.dtype == object else np.int64)
    book = book.astype(block.dtype)
    for lo in range(0, rows, STEP_ROWS):
        part = block[:, lo : lo + STEP_ROWS]
        total = np.zeros((part.shape[1], entries), block.dtype)
        apart = np.empty_like(total)
        for x, c in zip(part, book):
            np.subtract(x[:, None], c[None], out=apart)
            np.multiply(apart, apart, out=apart)
            np.add(total, apart, out=total)
        at[lo : lo + STEP_ROWS] = total.argmin(1)
        far[lo : lo + STEP_ROWS] = total[np.arange(len(total)), at[lo : lo + STEP_ROWS]]
    return at, far


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vec (doubles) of the rows whose vector is there and holds no null, NaN or infinity."""
    values = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", values.alias("vec")).where(good)


def column_blocks(kept: DataFrame, shape: Shape) -> DataFrame:
    """kept(vec_id, label, vec) -> rows of at most BLOCK_ROWS vectors: vec_id and label (arrays), data (the block)."""
    label = kept.schema["label"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(lo, BLOCK_ROWS)
                vec, n = some.column(2), some.num_rows
                flat, ends = vec.flatten().to_numpy(zero_copy_only=False), np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))
                data = shape.pack(shape.integers(np.split(flat, ends[:-1])))
                whole = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), some.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*whole, pa.array([data], pa.binary())], ["vec_id", "label", "data"])

    return kept.select("vec_id", "label", "vec").mapInArrow(cut, f"vec_id array<long>, label array<{label}>, data binary")


def first_books(kept: DataFrame, shape: Shape, entries: int) -> np.ndarray:
    """(parts, width, entries): the vectors of the smallest vec_ids, ascending; null ids come last, equal ids by vector."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()  # at most `entries` rows
    return shape.integers([np.array(r[0], np.float64) for r in rows])


def fitted_books(blocks: DataFrame, books: np.ndarray, shape: Shape, rounds: int) -> np.ndarray:
    """The codebooks after `rounds` rounds of assigning all parts and replacing entries by floors of means. A round is one
    treeAggregate; per task and in the driver there is one tensor of the codebooks' size."""
    sc = blocks.sparkSession.sparkContext
    data = blocks.select(F.size("vec_id").alias("n"), "data").rdd
    total = object if shape.kind is object else np.int64
    depth = 2 if data.getNumPartitions() <= 256 else 3
    for _ in range(rounds):
        given = sc.broadcast(books)  # parts x width x entries numbers

        def add(sums: tuple | None, row) -> tuple:
            now = given.value
            block = shape.unpack(row["data"], row["n"])
            per, counts = sums or (np.zeros(now.shape, total), np.zeros((len(now), now.shape[2]), np.int64))
            for p in range(len(now)):
                at, _ = nearest(block[p], now[p])
                np.add.at(counts[p], at, 1)
                for j in range(shape.width):
                    np.add.at(per[p, j], at, block[p, j].astype(total))
            return per, counts

        def merge(a: tuple | None, b: tuple | None) -> tuple | None:
            return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

        per, counts = data.treeAggregate(None, add, merge, depth)
        used = counts[:, None, :] > 0
        books = np.where(used, per // np.maximum(counts, 1)[:, None, :], books)
        given.unpersist()
    return books


def digest_of(books: np.ndarray) -> str:
    """sha256 of the components as decimal integers by part, entry, position within the part, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors(vec_id, label, embedding, ...) -> vec_id, label, code, error, label_error, codebooks_sha256.

    A row per row whose vector is there and holds no null, NaN or infinity; the others are left out. A table without such
    rows gives no rows. Shorter vectors (an empty one, too) count as filled up with zeros to the longest, and its length
    to a multiple of `parts`. Fewer than `entries` rows make as many entries. Repeated ids and rows are coded each; null
    ids come last among the first entries. Null labels are one label. Components too large for int64 distances are
    computed with unbounded integers; an error beyond a long is returned as the largest long.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    kept = finite_vectors(vectors)
    length, largest = kept.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    label = kept.schema["label"].dataType.simpleString()
    coded_as = f"vec_id long, label {label}, code string, error long"
    if length is None:
        return spark.createDataFrame([], f"{coded_as}, label_error long, codebooks_sha256 string")
    shape = Shape.of(length, largest or 0.0, parts)
    blocks = materialize(column_blocks(kept, shape))
    books = fitted_books(blocks, first_books(kept, shape, entries), shape, rounds)
    given = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(k).slice(i, 1).flatten() for k in (0, 1))
                block = shape.unpack(batch.column(2)[i].as_buffer(), len(ids))
                found = [nearest(block[p], given.value[p]) for p in range(parts)]
                hexed = np.array([f"{k:02x}" for k in range(256)], object)
                names = sum((hexed[at] for at, _ in found[1:]), hexed[found[0][0]])
                error = [min(int(x), _LONG) for x in sum(far for _, far in found)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(names.tolist(), pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = materialize(blocks.select("vec_id", "label", "data").mapInArrow(code, coded_as))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("_same")).agg(total.alias("label_error"))
    met = coded.join(by_label, coded["label"].eqNullSafe(F.col("_same")))
    return met.select("vec_id", "label", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")).drop("label")


def sql_vector_codes() -> str:
    """Plain SQL: every part against every entry, round by round."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""near{r} AS MATERIALIZED (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pieces p JOIN book{r} b USING (part)) GROUP BY id, part)""")
        if r < ROUNDS:
            rounds.append(f"""book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
  SELECT part, entry, list(v ORDER BY spot) AS x FROM (SELECT n.part, n.entry, spot, floor(sum(p.x[spot])::DOUBLE / count(*))::BIGINT AS v FROM near{r} n JOIN pieces p USING (id, part), range(1, len(p.x) + 1) AS t(spot) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))""")
    return f"""
WITH good AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id) AS id FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
pieces AS MATERIALIZED (SELECT id, part, list_slice(x, part * (len(x) // {PARTS}) + 1, (part + 1) * (len(x) // {PARTS})) AS x FROM good, range({PARTS}) AS t(part)),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM pieces WHERE id <= {ENTRIES}),
{', '.join(rounds)},
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY id),
said AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN good USING (id), said"""
