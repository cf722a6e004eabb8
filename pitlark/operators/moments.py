"""Exact medians and stable ridge systems of many overlapping training windows, from sums over their blocks of dates.

Medians are found by refinement: the interval that holds a window's middle value is cut into smaller ones, whose values
tasks count, until few values are left. Co-moments are taken about each block's own centre and merged pairwise (count, mean,
co-moment), so a large mean costs no digits; a gap is a column of its own until the window's median is known. Where the
system is ill-conditioned all the same, it is solved by a block QR of the rows. What tasks send, and what the driver holds,
depends on features, folds and blocks, not on rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import merged, summed
from .ranks import Blocks, sampled_cuts

#: Cells that values are counted in at first, pieces that an interval is cut into, and values that are few enough to be sent:
#: none of them changes a result.
CELLS, PIECES, FEW = 512, 32, 64
#: Condition number from which rows are reduced by QR.
ILL_CONDITIONED = 1e10


@dataclass(frozen=True)
class FoldModel:
    """score = level + sum of weights * (value, or where it is missing the median, less the mean)."""

    fold_id: int
    median: np.ndarray
    mean: np.ndarray
    weight: np.ndarray
    level: float


_ALL_BUT_SIGN = np.int64(2**63 - 1)


def ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles (no NaN)."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _ALL_BUT_SIGN, bits)


def unordered(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.int64)
    return np.where(keys < 0, keys ^ _ALL_BUT_SIGN, keys).view(np.float64)


def _columns(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, targets and features (rows by columns, NaN for missing) of (block, y, features)."""
    data = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k + 2)]
    return data[0], data[1], np.column_stack(data[2:]) if k else np.zeros((len(data[0]), 0))


def _sent(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for key, value in parts.items():
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([value.ravel().tobytes()], pa.binary())], ["key", "data"])


SHARE = "key long, data binary"


def within(batch: pa.RecordBatch, member: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> Iterator[tuple]:
    """(target, fold, feature, keys) of a batch's values that lie in a wanted interval [low, high] of a fold that has their block."""
    k = low.shape[2]
    block, _, x = _columns(batch, k)
    for j in range(k):
        some = wanted[:, :, j]
        if not some.any():
            continue
        there = np.nonzero(~np.isnan(x[:, j]))[0]
        keys = ordered(x[there, j])
        near = (keys >= low[:, :, j][some].min()) & (keys <= high[:, :, j][some].max())
        keys, mine = keys[near], member[block[there[near]]]
        for t, f in zip(*np.nonzero(some)):
            got = keys[mine[:, f] & (keys >= low[t, f, j]) & (keys <= high[t, f, j])]
            if len(got):
                yield t, f, j, got


class Training:
    """rows(date, y, features) of all folds' training windows, read as often as the methods say."""

    def __init__(self, rows: DataFrame, folds: DataFrame, features: list[str]):
        spark = rows.sparkSession
        self.features, self.k = features, len(features)
        self.blocks = Blocks.of(rows, folds)
        days = F.broadcast(spark.createDataFrame(self.blocks.days, "date date, block int"))  # one row a date
        self.rows = rows.where("y IS NOT NULL").join(days, "date").select("block", "y", *features)
        self.folds = range(len(self.blocks.ids))

    def models(self, alpha: float) -> dict[int, FoldModel | Exception]:
        """Per fold id its model, or what went wrong with it."""
        if not self.blocks.days:
            return {i: ValueError("no training rows") for i in self.blocks.ids}
        self._count()
        medians = self._medians()
        return self._solved(medians, alpha)

    def _count(self) -> None:
        """Cuts between cells from a bounded sample; then a pass for rows, counts by cells, and means (as distances from the middle
        cut) per block."""
        *cuts, y = sampled_cuts(self.rows, [*self.features, "y"], CELLS)
        self.cuts = cuts = [c if len(c) else np.zeros(1) for c in cuts]
        self.shift = shift = np.array([c[len(c) // 2] for c in [*cuts, y if len(y) else np.zeros(1)]])
        k = self.k

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                block, y, x = _columns(batch, k)
                for b in np.unique(block).tolist():
                    mine, target = x[block == b], y[block == b]
                    counts = [np.bincount(np.searchsorted(c, v[~np.isnan(v)], "right"), minlength=CELLS) for c, v in zip(cuts, mine.T)]
                    added = np.append(np.nansum(mine - shift[:k], axis=0), (target - shift[k]).sum())
                    part = np.concatenate([*counts, added, [len(mine)]])
                    sums[b] = sums[b] + part if b in sums else part
            yield from _sent(sums)

        self.counts, self.centre = {}, {}
        for b, flat in summed(self.rows.mapInArrow(tally, SHARE)).items():
            counts, added, n = flat[: k * CELLS].reshape(k, CELLS), flat[k * CELLS : -1], flat[-1]
            self.counts[b] = counts
            self.centre[b] = shift + added / np.maximum(np.append(counts.sum(1), n), 1)

    def _medians(self) -> np.ndarray:
        """(folds, features) exact medians, 0 without a value. Targets are the one or two middle values: per fold and feature an
        interval of keys [low, high], and how many of the fold's values lie below it."""
        member, k, n_folds = self.blocks.member, self.k, len(self.folds)
        low, high = np.zeros((2, n_folds, k), np.int64), np.full((2, n_folds, k), -1, np.int64)  # high < low: no target
        below, left, rank = (np.zeros((2, n_folds, k), np.int64) for _ in range(3))
        for f in self.folds:
            own = [self.counts[b] for b in np.nonzero(member[:, f])[0] if b in self.counts]
            if not own:
                continue
            counts = np.sum(own, axis=0).astype(np.int64)
            for j in range(k):
                n, upto, edges = int(counts[j].sum()), np.cumsum(counts[j]), ordered(self.cuts[j])
                for t, r in enumerate(sorted({(n - 1) // 2, n // 2}) if n else ()):
                    cell = int(np.searchsorted(upto, r, "right"))
                    low[t, f, j] = edges[cell - 1] if cell else ordered(np.array([-np.inf]))[0]
                    high[t, f, j] = edges[cell] - 1 if cell < len(edges) else ordered(np.array([np.inf]))[0]
                    below[t, f, j], left[t, f, j], rank[t, f, j] = upto[cell] - counts[j][cell], counts[j][cell], r
        while (open_ := (left > FEW) & (high > low)).any():
            at = np.argwhere(open_)
            pieces, least, most = self._pieces(at, low, high)
            for (t, f, j), n, lo, hi in zip(at.tolist(), pieces, least, most):
                upto = np.cumsum(n)
                piece = int(np.searchsorted(below[t, f, j] + upto, rank[t, f, j], "right"))
                below[t, f, j] += upto[piece] - n[piece]
                left[t, f, j], low[t, f, j], high[t, f, j] = n[piece], ordered(lo[piece : piece + 1])[0], ordered(hi[piece : piece + 1])[0]
        values = self._few(low, high, (left > 0) & (high > low))
        out = np.zeros((2, n_folds, k))
        for t, f, j in zip(*np.nonzero(left > 0)):
            if high[t, f, j] == low[t, f, j]:
                out[t, f, j] = unordered(low[t, f, j])
            else:
                out[t, f, j] = values[t, f, j][rank[t, f, j] - below[t, f, j]]
        return np.where(left[1] > 0, out[0] / 2 + out[1] / 2, out[0])

    def _pieces(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the targets `at` (rows of target, fold, feature) the number, the least and the largest of the values in each of
        PIECES pieces of their interval: equal in width, or where that is infinite in keys."""
        member, n_targets = self.blocks.member, len(at)
        wanted = np.zeros(low.shape, bool)
        wanted[tuple(at.T)] = True
        number = np.full(low.shape, -1)
        number[tuple(at.T)] = np.arange(n_targets)
        a, b = low[tuple(at.T)], high[tuple(at.T)]
        parts = np.arange(1, PIECES) / PIECES
        with np.errstate(over="ignore", invalid="ignore"):
            x, y = unordered(a)[:, None], unordered(b)[:, None]
            even = x * (1 - parts) + y * parts
            finite = np.isfinite(even).all(1) & np.isfinite(x[:, 0]) & np.isfinite(y[:, 0])
        steps = (b.view(np.uint64) - a.view(np.uint64)) // np.uint64(PIECES) + np.uint64(1)
        by_key = (a.view(np.uint64)[:, None] + steps[:, None] * np.arange(1, PIECES, dtype=np.uint64)).view(np.int64)
        by_key = np.where(by_key < a[:, None], _ALL_BUT_SIGN, by_key)  # beyond the largest key
        edges = np.where(finite[:, None], np.maximum.accumulate(ordered(np.where(finite[:, None], even, 0.0)), 1), by_key)
        size = n_targets * PIECES

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.concatenate([np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)])
            for batch in batches:
                for t, f, j, keys in within(batch, member, low, high, wanted):
                    i = number[t, f, j]
                    piece = i * PIECES + np.searchsorted(edges[i], keys, "right")
                    values = unordered(keys)
                    np.add.at(found, piece, 1)
                    np.minimum.at(found, size + piece, values)
                    np.maximum.at(found, 2 * size + piece, values)
            yield from _sent({0: found})

        def combine(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return np.concatenate([p[:size] + q[:size], np.minimum(p[size : 2 * size], q[size : 2 * size]), np.maximum(p[2 * size :], q[2 * size :])])

        n, least, most = merged(self.rows.mapInArrow(count, SHARE), combine)[0].reshape(3, n_targets, PIECES)
        return n.astype(np.int64), least, most

    def _few(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> dict[tuple, np.ndarray]:
        """The values of the wanted intervals, each of which has at most FEW."""
        member = self.blocks.member

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = list(within(batch, member, low, high, wanted))
                at = [np.ravel_multi_index(p[:3], low.shape) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(at, np.int64), [len(p[3]) for p in parts])), pa.array(np.concatenate([np.zeros(0, np.int64), *(p[3] for p in parts)]))], ["at", "key"])

        if not wanted.any():
            return {}
        found = self.rows.mapInArrow(send, "at long, key long").toArrow()  # at most FEW for each of two targets a fold and feature
        at, keys = (found.column(c).to_numpy() for c in ("at", "key"))
        order = np.lexsort((keys, at))
        edges = np.nonzero(np.append(True, np.diff(at[order]) > 0))[0] if len(at) else []
        each = np.split(unordered(keys[order]), edges[1:])
        return {tuple(map(int, np.unravel_index(at[order[e]], low.shape))): v for e, v in zip(edges, each)}

    def _solved(self, medians: np.ndarray, alpha: float) -> dict[int, FoldModel | Exception]:
        """One pass for the co-moments of values (0 for a gap), gaps and target about each block's centre."""
        k, centre, shift = self.k, self.centre, self.shift

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                block, y, x = _columns(batch, k)
                for b in np.unique(block).tolist():
                    at = block == b
                    gap = np.isnan(x[at])
                    u = np.column_stack([np.where(gap, 0.0, x[at] - centre[b][:k]), gap, y[at] - centre[b][k], np.ones(at.sum())])
                    part = u.T @ u
                    sums[b] = sums[b] + part if b in sums else part
            yield from _sent(sums)

        size = 2 * k + 2
        moments = {b: flat.reshape(size, size) for b, flat in summed(self.rows.mapInArrow(multiply, SHARE)).items()}
        out: dict[int, FoldModel | Exception] = {}
        ill: list[int] = []
        stats = {}
        for f in self.folds:
            total = None
            for b in np.nonzero(self.blocks.member[:, f])[0]:
                if b in moments:
                    total = _joined(total, _filled(moments[b], medians[f] - centre[b][:k], centre[b] - shift, k))
            fold_id = self.blocks.ids[f]
            if total is None:
                out[fold_id] = ValueError("no training rows")
                continue
            n, mean, co = total
            sd = np.sqrt(np.maximum(np.diag(co)[:k] / n, 0))
            sd = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean[:k])), sd, 1.0)
            system = co[:k, :k] / np.outer(sd, sd) + alpha * np.eye(k)
            stats[f] = (mean, sd)
            if not k or np.linalg.cond(system) < ILL_CONDITIONED:
                weight = np.linalg.solve(system, co[:k, k] / sd) / sd
                out[fold_id] = FoldModel(fold_id, medians[f], shift[:k] + mean[:k], weight, float(shift[k] + mean[k]))
            else:
                ill.append(f)
        for f, triangle in self._triangles(ill, medians, stats).items():
            mean, sd = stats[f]
            r, target = triangle[:k, :k], triangle[:k, k]
            whole = np.linalg.qr(np.column_stack([np.vstack([r, np.sqrt(alpha) * np.eye(k)]), np.append(target, np.zeros(k))]), mode="r")
            fold_id = self.blocks.ids[f]
            try:
                weight = np.linalg.solve(whole[:k, :k], whole[:k, k]) / sd
                out[fold_id] = FoldModel(fold_id, medians[f], shift[:k] + mean[:k], weight, float(shift[k] + mean[k]))
            except np.linalg.LinAlgError as error:
                out[fold_id] = error
        return out

    def _triangles(self, ill: list[int], medians: np.ndarray, stats: dict) -> dict[int, np.ndarray]:
        """R of the QR of the standardized rows and target of the given folds; triangles are stacked and reduced in pairs."""
        k, shift, member = self.k, self.shift, self.blocks.member

        def reduce(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            both = np.linalg.qr(np.vstack([a.reshape(-1, k + 1), b.reshape(-1, k + 1)]), mode="r")
            return np.vstack([both, np.zeros((k + 1 - len(both), k + 1))]).ravel()

        def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                block, y, x = _columns(batch, k)
                for f in ill:
                    at = member[block, f]
                    if at.any():
                        mean, sd = stats[f]
                        filled = np.where(np.isnan(x[at]), medians[f], x[at]) - shift[:k] - mean[:k]
                        rows = np.column_stack([filled / sd, y[at] - shift[k] - mean[k]])
                        found[f] = reduce(found.get(f, np.zeros((k + 1) ** 2)), rows.ravel())
            yield from _sent(found)

        if not ill:
            return {}
        return {f: flat.reshape(k + 1, k + 1) for f, flat in merged(self.rows.mapInArrow(factor, SHARE), reduce).items()}


def _filled(u: np.ndarray, step: np.ndarray, base: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, co-moment) of a block's features with gaps filled, and target, from its sums: a gap adds `step` (the median
    less the block's centre), and `base` is the centre's distance from the common shift."""
    n = u[-1, -1]
    mean = u[:-1, -1] / n
    co = u[:-1, :-1] - n * np.outer(mean, mean)
    fill = np.zeros((k + 1, 2 * k + 1))
    fill[:k, :k], fill[:k, k : 2 * k], fill[k, 2 * k] = np.eye(k), np.diag(step), 1.0
    return n, base + fill @ mean, fill @ co @ fill.T


def _joined(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + np.outer(apart, apart) * a[0] * b[0] / n
