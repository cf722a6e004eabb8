"""Rank correlations over many overlapping windows of dates, exact, without a row per window.

Dates that the same folds train on are a block, so a fold is a sum of blocks. A value's rank in a fold is the number of
the fold's values below it, and half of those equal to it. Values are dealt to cells between approximate quantiles (any
cuts give the same result): within a cell the ranks of all folds are running sums over the same sorted values, and the
counts of the cells below are added afterwards, in sums. A row travels once per feature, whatever the number of folds;
with it go its target's ranks in the folds that train on it, packed. Equal values of a block are added up before they travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import held, packed, summed, unpacked
from ..sources.store import settled

#: Values that a cell is made for, and the most cells of a column (they bound what is broadcast; fuller cells are as exact).
CELL_ROWS, MAX_CELLS = 200_000, 4096
#: Rows that are looked at to choose boundaries.
SAMPLE_ROWS = 40_000
#: Rows of a sample that are multiplied at once, and columns of a block of a Gram matrix.
CHUNK_ROWS, BLOCK_COLUMNS = 8192, 32


@dataclass(frozen=True)
class Blocks:
    """ids: the folds' ids; days: (date, block) pairs; member[b, f]: whether fold f trains on block b."""

    ids: list[int]
    days: list[tuple]
    member: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, folds: DataFrame) -> Blocks:
        plan = sorted(folds.select("fold_id", "train_start_date", "train_end_date").collect())  # one row a fold
        found: dict[tuple, int] = {}
        days = []
        for (day,) in rows.select("date").distinct().collect():  # one row a date
            mine = tuple(f for f, (_, a, b) in enumerate(plan) if a <= day <= b)
            if mine:
                days.append((day, found.setdefault(mine, len(found))))
        member = np.zeros((len(found), len(plan)), bool)
        for mine, b in found.items():
            member[b, list(mine)] = True
        return cls([r[0] for r in plan], days, member)

    @property
    def trained(self) -> np.ndarray:
        """(blocks, most folds of a block): the folds that train on a block, filled up with -1."""
        most = int(self.member.sum(1).max(initial=0))
        out = np.full((len(self.member), most), -1)
        for b, row in enumerate(self.member):
            at = np.nonzero(row)[0]
            out[b, : len(at)] = at
        return out


def sampled_cuts(rows: DataFrame, columns: list[str], cells: int) -> list[np.ndarray]:
    """Ascending boundaries between about `cells` cells of each column, alike in size: quantiles of at most about SAMPLE_ROWS
    rows, chosen by a hash. Whatever boundaries they are, results are exact; these make cells even."""
    if cells < 2:
        return [np.zeros(0) for _ in columns]
    n = max(1, rows.count())
    if n > SAMPLE_ROWS:
        rows = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < int(SAMPLE_ROWS / n * (1 << 30)))
    found = rows.select(*columns).toArrow()
    grid = np.arange(1, cells) / cells
    out = []
    for c in columns:
        values = found.column(c).to_numpy().astype(float)
        values = values[np.isfinite(values)]
        out.append(np.unique(np.quantile(values, grid, method="inverted_cdf")) if len(values) else np.zeros(0))
    return out


def alone(cuts: np.ndarray) -> np.ndarray:
    """Whether a cell, beyond the cut before it and up to its own, holds one value only."""
    return np.concatenate([[False], np.nextafter(cuts[1:], -np.inf) == cuts[:-1], [False]]) if len(cuts) else np.zeros(1, bool)


def apart(values: np.ndarray, cells: int) -> np.ndarray:
    """Boundaries between about `cells` cells alike in size; a value that would fill several has a cell of its own."""
    values = values[np.isfinite(values)]
    if cells < 2 or not len(values):
        return np.zeros(0)
    grid, n = np.unique(np.quantile(values, np.arange(1, cells) / cells, method="inverted_cdf"), return_counts=True)
    return np.unique(np.concatenate([grid, np.nextafter(grid[n > 1], -np.inf)]))


#: Features that are looked at together (their rows' way to the cells is removed before that of the next), rows that are packed
#: together, and rows of the target that a cell is made for.
TOGETHER, PACKED_ROWS, TARGET_ROWS = 8, 131_072, 100_000
PIECES = "feature int, cell int, data binary"
SUMS = "feature int, cell int, fold int, n_all double, n double, w double, ww double, y double, wy double, yy double"


def _ints(x: np.ndarray) -> bytes:
    """Whole numbers, bytes of one place together, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _back(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _joined(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<i4").tobytes() + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<i4", n, 4)) + 4 * (n + 1)
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends.tolist()], ends.tolist())]


def fold_correlations(matrix: DataFrame, folds: DataFrame, features: list[str], target: str = "fwd_ret_5d") -> DataFrame:
    """(fold_id, feature, fold_rank_ic) over the folds' training rows: features are ranked among their own values, the target
    among its own, and the ranks correlated over rows that have both; null where either does not vary. The matrix is read several
    times."""
    spark = matrix.sparkSession
    blocks = Blocks.of(matrix, folds)
    if not blocks.days:
        return spark.createDataFrame([], "fold_id int, feature string, fold_rank_ic double")
    days = F.broadcast(spark.createDataFrame(blocks.days, "date date, block int"))  # one row a date
    columns = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    rows = matrix.select("date", F.col(target).cast("double").alias("y"), *columns).join(days, "date").drop("date")
    n = rows.count()
    found = _looked_at(rows, n)
    y_cuts = apart(np.round(found.column("y").to_numpy().astype(float), 9) + 0.0, min(MAX_CELLS, math.ceil(n / TARGET_ROWS)))
    total = np.zeros((len(y_cuts) + 1, len(blocks.member)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(total.shape)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            there = ~np.isnan(y)
            np.add.at(counts, (np.searchsorted(y_cuts, np.round(y[there], 9) + 0.0), batch.column(0).to_numpy()[there]), 1)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["key", "data"])

    total = summed(rows.select("block", "y").mapInArrow(tally, "key long, data binary"))[0].reshape(total.shape)
    parts = []
    for at in range(0, len(features), TOGETHER):
        some = list(range(at, min(at + TOGETHER, len(features))))
        cuts = {i: apart(np.round(found.column(f"x{i}").to_numpy().astype(float), 9) + 0.0, min(MAX_CELLS, math.ceil(n / CELL_ROWS))) for i in some}
        parts.append(settled(_sums(rows, blocks, some, cuts, y_cuts, total)))
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)
    return _correlated(sums, blocks.ids, features)


def _looked_at(rows: DataFrame, n: int) -> pa.Table:
    """At most about SAMPLE_ROWS of n rows, chosen by a hash, to choose boundaries from: they change no result."""
    if n > SAMPLE_ROWS:
        rows = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < int(SAMPLE_ROWS / n * (1 << 30)))
    return rows.toArrow()


def _sums(rows: DataFrame, blocks: Blocks, some: list[int], cuts: dict[int, np.ndarray], y_cuts: np.ndarray, total: np.ndarray) -> DataFrame:
    """SUMS of some features. Rows meet by cells of the target, packed, and get its ranks in their folds there; then each
    feature's values meet by cells of the feature. total[cell, block]: rows of the target's cells."""
    member, trained = blocks.member, blocks.trained
    width, single = trained.shape[1], alone(y_cuts)
    by_fold = total @ member
    below, every = np.cumsum(by_fold, 0) - by_fold, by_fold.sum(0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, table in enumerate(held(batches, PACKED_ROWS)):
            block = table.column("block").to_numpy()
            y = np.round(table.column("y").to_numpy().astype(float), 9) + 0.0
            cell = np.where(np.isnan(y), -1, np.searchsorted(y_cuts, y))
            order = np.argsort(cell, kind="stable")
            cells, starts = np.unique(cell[order], return_index=True)
            values = [table.column(f"x{i}").to_numpy().astype(float)[order] for i in some]
            block, y, out = block[order], y[order], []
            for c, a, b in zip(cells.tolist(), starts, [*starts[1:], len(y)]):
                # rows without a target, or of a value's own cell, need no others to be ranked
                part = int(block[a] * 31 + a + turn * 7919) % 64 if c < 0 or single[c] else 0
                out.append((c, part, int(b - a), _joined([_ints(block[a:b]), packed(y[a:b]), *(packed(v[a:b]) for v in values)])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["cell", "part", "n", "data"])

    def cut(part: pa.Table) -> pa.Table:
        c, sizes = part.column("cell")[0].as_py(), part.column("n").to_pylist()
        columns = [np.concatenate(v) for v in zip(*([_back(d, n) if k == 0 else unpacked(d, n) for k, d in enumerate(_split(data))] for data, n in zip(part.column("data").to_pylist(), sizes)))]
        order = np.argsort(columns[0], kind="stable")
        block, y, *xs = (v[order] for v in columns)
        has_y, mine = c >= 0, trained[block]
        ranks = np.zeros((len(block), width), np.int64)
        if has_y:
            values, at = np.unique(y, return_inverse=True)
            for f in np.nonzero(member[np.unique(block)].any(0))[0].tolist():
                row, column = np.nonzero(mine == f)
                here = np.array([by_fold[c, f]]) if single[c] else np.bincount(at[row], minlength=len(values))
                ranks[row, column] = (2 * (below[c, f] + np.cumsum(here) - here) + here - every[f])[at[row]]
        base = np.where(mine >= 0, ranks, np.iinfo(np.int64).max).min(0)
        base = np.where(base == np.iinfo(np.int64).max, 0, base)
        out = []
        for i, x in zip(some, xs):
            x = x + 0.0
            at = np.argsort(x, kind="stable")[: int((~np.isnan(x)).sum())]
            if not len(at):
                continue
            v, b, own = x[at], block[at], ranks[at]
            if has_y:
                squares, used = np.zeros(member.shape[1]), mine[at]
                np.add.at(squares, used[used >= 0], (own[used >= 0] / 2.0) ** 2)
                out.append((i, -1, squares.tobytes()))
            starts = np.nonzero(np.append(True, (v[1:] != v[:-1]) | (b[1:] != b[:-1])))[0]
            n_all = np.diff(np.append(starts, len(at)))
            v, b, added = v[starts], b[starts], np.add.reduceat(own, starts)
            n_both = n_all if has_y else np.zeros(len(n_all), np.int64)
            apart_ = np.where(trained[b] >= 0, added - n_both[:, None] * base, 0) if has_y else np.zeros(added.shape, np.int64)
            cell = np.searchsorted(cuts[i], v)
            edges = np.append(np.nonzero(np.append(True, np.diff(cell) > 0))[0], len(cell)).tolist()
            for lo, hi in zip(edges, edges[1:]):
                out.append((i, int(cell[lo]), _joined([np.array([hi - lo], "<i8").tobytes(), base.astype("<i8").tobytes(), packed(v[lo:hi]), _ints(b[lo:hi]), _ints(n_all[lo:hi]), _ints(n_both[lo:hi]), _ints(apart_[lo:hi].T.ravel())])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.int32(), pa.binary()))], names=["feature", "cell", "data"])

    names = [x.split()[0] for x in SUMS.split(", ")]

    def add(part: pa.Table) -> pa.Table:
        feature, cell = part.column("feature")[0].as_py(), part.column("cell")[0].as_py()
        data, out = part.column("data").to_pylist(), []
        if cell < 0:
            squares = np.sum([np.frombuffer(d) for d in data], axis=0)
            out = [(feature, cell, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, v) for f, v in enumerate(squares.tolist()) if v]
        else:
            pieces = []
            for head, base, *rest in map(_split, data):
                n = int(np.frombuffer(head, "<i8")[0])
                v, (b, n_all, n_both) = unpacked(rest[0], n), (_back(d, n) for d in rest[1:4])
                pieces.append((v, b, n_all, n_both, _back(rest[4], n * width).reshape(width, n).T + n_both[:, None] * np.frombuffer(base, "<i8")))
            x, block, n_all, n_both, added = (np.concatenate(p) for p in zip(*pieces))
            n_all, n_both, added = n_all.astype(float), n_both.astype(float), added / 2.0
            _, at = np.unique(x, return_inverse=True)
            mine = trained[block]
            for f in np.nonzero(member[np.unique(block)].any(0))[0].tolist():
                row, column = np.nonzero(mine == f)
                where = at[row]
                here = np.bincount(where, n_all[row])
                rank = (np.cumsum(here) - here + (here + 1) / 2)[where]
                y, n = added[row, column], n_both[row]
                out.append((feature, cell, f, float(n_all[row].sum()), float(n.sum()), float(rank @ n), float((rank * rank) @ n), float(y.sum()), float(rank @ y), 0.0))
        kinds = [pa.int32()] * 3 + [pa.float64()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 10, kinds)], names=names)

    dealt = rows.select("block", "y", *(f"x{i}" for i in some)).mapInArrow(deal, "cell int, part int, n int, data binary")
    return dealt.groupBy("cell", "part").applyInArrow(cut, PIECES).groupBy("feature", "cell").applyInArrow(add, SUMS)


def _correlated(sums: DataFrame, ids: list[int], features: list[str]) -> DataFrame:
    spark = sums.sparkSession
    # from ranks within cells to ranks less their mean: rows by cells, folds and features
    key = Window.partitionBy("feature", "fold")
    base = F.sum("n_all").over(key.orderBy("cell")) - F.col("n_all") - (F.sum("n_all").over(key) + 1) / 2
    parts = sums.withColumn("b", base)
    b, n = F.col("b"), F.col("n")
    total = parts.groupBy("feature", "fold").agg(
        F.sum("n").alias("n"), F.sum(b * n + F.col("w")).alias("x"), F.sum(b * b * n + 2 * b * F.col("w") + F.col("ww")).alias("xx"), F.sum("y").alias("y"), F.sum(b * F.col("y") + F.col("wy")).alias("xy"), F.sum("yy").alias("yy"),
    )
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / n
    size = F.sqrt(F.greatest(spread("x", "xx"), F.lit(0.0))) * F.sqrt(F.greatest(spread("y", "yy"), F.lit(0.0)))
    ic = F.when((n > 0) & (spread("x", "xx") > 1e-9 * n) & (spread("y", "yy") > 1e-9 * n), (F.col("xy") - F.col("x") * F.col("y") / n) / size)
    facts = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "feature int, name string")
    fold_ids = spark.createDataFrame(list(enumerate(ids)), "fold int, fold_id int")
    found = total.withColumn("ic", ic).select("feature", "fold", "ic")
    every = facts.crossJoin(fold_ids)  # one row a feature and fold
    return every.join(found, ["feature", "fold"], "left").select("fold_id", F.col("name").alias("feature"), F.col("ic").alias("fold_rank_ic"))


def sample_dates(rows: DataFrame, folds: DataFrame, stride: int) -> DataFrame:
    """(fold_id, date): every `stride`-th training date of each fold."""
    slim = F.broadcast(folds.select("fold_id", "train_start_date", "train_end_date"))  # one row a fold
    dates = rows.select("date").distinct().join(slim, F.col("date").between(F.col("train_start_date"), F.col("train_end_date"))).select("fold_id", "date")
    return dates.withColumn("_i", F.row_number().over(Window.partitionBy("fold_id").orderBy("date")) - 1).where(F.col("_i") % stride == 0).drop("_i")


def sampled(matrix: DataFrame, folds: DataFrame, stride: int, most: int, chosen: DataFrame | None = None) -> DataFrame:
    """Rows of every `stride`-th training date of each fold, with fold_id and their place `idx` in the fold's sample; of more
    than `most` rows those with the least hash of fold, date and ticker: exactly `most`, whatever the partitioning. `chosen` gives
    sample_dates() of a matrix that holds these dates only.

    The hash's 16 leading bits are counted first: cells below the one where the count is reached go in whole, and rows are
    ordered only inside of cells."""
    chosen = sample_dates(matrix, folds, stride) if chosen is None else chosen
    rows = matrix.join(F.broadcast(chosen), "date").withColumn("_h", F.xxhash64("fold_id", "date", "ticker"))  # dates by folds
    rows = rows.withColumn("_cell", F.shiftrightunsigned("_h", 48).cast("int"))
    counts = rows.groupBy("fold_id", "_cell").agg(F.count("*").alias("_n"))  # at most 65,536 rows a fold
    upto = F.sum("_n").over(Window.partitionBy("fold_id").orderBy("_cell"))
    counts = settled(counts.withColumn("_below", upto - F.col("_n")).where(F.col("_below") < most).drop("_n"))
    order = F.row_number().over(Window.partitionBy("fold_id", "_cell").orderBy("_h", "date", "ticker"))
    kept = rows.join(counts, ["fold_id", "_cell"]).withColumn("idx", F.col("_below") + order - 1)
    return kept.where(F.col("idx") < most).drop("_h", "_cell", "_below")


RANKED = "fold_id int, chunk int, feature int, data binary"
GRAMS = "fold_id int, a int, b int, data binary"


def sample_correlations(sample: DataFrame, features: list[str]) -> DataFrame:
    """sample(fold_id, idx, features) -> (fold_id, feature_a, feature_b, c): Spearman correlations of all pairs, feature_a being
    the smaller name. A column of a fold's sample is ranked in one task (it is bounded), all others work on chunks of rows
    and blocks of columns: cross products of ranks, with counts and sums over the rows that have both."""
    names = sorted(features)
    slim = sample.select(F.col("fold_id").cast("int"), F.col("idx").cast("int"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, idx, out = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for f in np.unique(fold).tolist():
                at = np.nonzero(fold == f)[0]
                for i in range(len(names)):
                    out.append((f, i, idx[at].astype("<i4").tobytes() + np.round(batch.column(2 + i).to_numpy(zero_copy_only=False)[at], 9).astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.int32(), pa.binary()))], ["fold_id", "feature", "data"])

    def rank(part: pa.Table) -> pa.Table:
        fold, feature, data = part.column("fold_id")[0].as_py(), part.column("feature")[0].as_py(), part.column("data").to_pylist()
        idx = np.concatenate([np.frombuffer(d, "<i4", len(d) // 12) for d in data])
        x = np.concatenate([np.frombuffer(d, "<f8", len(d) // 12, len(d) // 3) for d in data])
        ranks = np.full(int(idx.max()) + 1, np.nan)
        at = np.nonzero(~np.isnan(x))[0]
        if len(at):
            _, place, n = np.unique(x[at] + 0.0, return_inverse=True, return_counts=True)
            ranks[idx[at]] = (np.cumsum(n) - (n - 1) / 2)[place] - (len(at) + 1) / 2
        chunks = range(0, len(ranks), CHUNK_ROWS)
        return pa.table({"fold_id": pa.array([fold] * len(chunks), pa.int32()), "chunk": pa.array([c // CHUNK_ROWS for c in chunks], pa.int32()), "feature": pa.array([feature] * len(chunks), pa.int32()), "data": pa.array([ranks[c : c + CHUNK_ROWS].tobytes() for c in chunks], pa.binary())})

    def multiply(part: pa.Table) -> pa.Table:
        fold, out = part.column("fold_id")[0].as_py(), []
        by = dict(zip(part.column("feature").to_pylist(), part.column("data").to_pylist()))
        ranks = np.array([np.frombuffer(by[i]) for i in range(len(names))])
        there = (~np.isnan(ranks)).astype(float)
        ranks = np.nan_to_num(ranks)
        for a in range(0, len(names), BLOCK_COLUMNS):
            for b in range(a, len(names), BLOCK_COLUMNS):
                p, q, m, o = ranks[a : a + BLOCK_COLUMNS], ranks[b : b + BLOCK_COLUMNS], there[a : a + BLOCK_COLUMNS], there[b : b + BLOCK_COLUMNS]
                products = np.array([m @ o.T, p @ o.T, m @ q.T, (p * p) @ o.T, m @ (q * q).T, p @ q.T])
                out.append((fold, a, b, products.tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["fold_id", "a", "b", "data"])

    def correlate(part: pa.Table) -> pa.Table:
        fold, a, b = (part.column(c)[0].as_py() for c in ("fold_id", "a", "b"))
        total = np.sum([np.frombuffer(d) for d in part.column("data").to_pylist()], axis=0)
        n, x, y, xx, yy, xy = total.reshape(6, min(BLOCK_COLUMNS, len(names) - a), min(BLOCK_COLUMNS, len(names) - b))
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
            c = np.where((n > 0) & (vx > 1e-9) & (vy > 1e-9), (xy / n - x * y / n**2) / np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0)), np.nan)
        out = [(fold, names[a + i], names[b + j], None if np.isnan(c[i, j]) else float(c[i, j])) for i in range(c.shape[0]) for j in range(c.shape[1]) if a + i < b + j]
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.string(), pa.string(), pa.float64()))], names=["fold_id", "feature_a", "feature_b", "c"])

    packed = slim.mapInArrow(columns, "fold_id int, feature int, data binary")
    ranked = packed.groupBy("fold_id", "feature").applyInArrow(rank, RANKED)
    grams = ranked.groupBy("fold_id", "chunk").applyInArrow(multiply, GRAMS)
    return grams.groupBy("fold_id", "a", "b").applyInArrow(correlate, "fold_id int, feature_a string, feature_b string, c double")
