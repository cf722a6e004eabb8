"""The catalog's kernel on arrays: rows of whole tickers in order of date, NaN for null; a window ends at its row.

A window's value is put together from those of lengths that are powers of two, which all windows of a column share: means and
squared deviations by merging (so equal values have a deviation of exactly zero), extremes by overlapping halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .expr import EPSILON


def whole_tickers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by ticker, cut anew so that no ticker lies in two of them."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept:
            ticker = batch.column(0)
            first = 0
            if ticker[0].equals(kept[-1].column(0)[-1]):
                other = pc.not_equal(ticker, ticker[0])
                first = pc.index(other, True).as_py()
            if first < 0:
                kept.append(batch)
                continue
            yield pa.Table.from_batches([*kept, batch.slice(0, first)])
            batch, kept = batch.slice(first), []
        ticker = batch.column(0)
        last = pc.index(pc.equal(ticker, ticker[-1]), True).as_py()
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        kept = [batch.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


def gathered(tables: Iterator[pa.Table], rows: int = 8192) -> Iterator[pa.Table]:
    """Tables put together until they have some rows, since every operation costs a call."""
    held: list[pa.Table] = []
    for table in tables:
        held.append(table)
        if sum(t.num_rows for t in held) >= rows:
            yield pa.concat_tables(held)
            held = []
    if held:
        yield pa.concat_tables(held)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def places(first: np.ndarray) -> np.ndarray:
    """Each row's place within its ticker, from 0; `first` marks the tickers' first rows."""
    at = np.arange(len(first))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def codes(column) -> np.ndarray:
    """A number for each value of a column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.dictionary_encode(column).indices.to_numpy()


def back(x: np.ndarray, k: int) -> np.ndarray:
    """The values k rows before."""
    if not k:
        return x
    out = np.full(len(x), np.nan)
    if k < len(x):
        out[k:] = x[:-k]
    return out


def quotient(a, b) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return np.where(np.asarray(b) == 0, np.nan, np.divide(a, b))


class ArrayOps:
    """SparkOps for arrays. Columns that have no nulls of their own only in part take part as NaN; comparisons with them are false."""

    def __init__(self, columns: dict[str, np.ndarray], place: np.ndarray, left: np.ndarray):
        """place: each row's place within its ticker; left: the rows of the ticker that come after it."""
        self.columns, self.place, self.left = columns, place, left
        self._made: dict[tuple, list] = {}

    def c(self, name: str) -> np.ndarray:
        return self.columns[name]

    def _of(self, x) -> np.ndarray:
        return self.columns[x] if isinstance(x, str) else x

    def lit(self, x):
        return x

    def div(self, a, b) -> np.ndarray:
        return quotient(self._of(a), self._of(b))

    def lag(self, x, k: int) -> np.ndarray:
        return np.where(self.place >= k, back(self._of(x), k), np.nan)

    def lead(self, x, k: int) -> np.ndarray:
        x = self._of(x)
        out = np.full(len(x), np.nan)
        out[: max(0, len(x) - k)] = x[k:]
        return np.where(self.left >= k, out, np.nan)

    def _powers(self, x, kind: str, most: int) -> list:
        """The values over 1, 2, 4, ... rows, up to `most` rows."""
        made = self._made.setdefault((x, kind), []) if isinstance(x, str) else []
        if not made:
            start = np.asarray(self._of(x), float)
            made.append((start, np.where(np.isnan(start), np.nan, 0.0)) if kind == "moments" else start)
        while 1 << len(made) <= most:
            k, last = 1 << (len(made) - 1), made[-1]
            if kind == "moments":
                m, s = last
                apart = back(m, k) - m
                made.append((m + apart / 2, s + back(s, k) + apart * apart * (k / 2)))
            else:
                made.append((np.maximum if kind == "max" else np.minimum)(last, back(last, k)))
        return made

    def _whole(self, x: np.ndarray, w: int) -> np.ndarray:
        return np.where(self.place >= w - 1, x, np.nan)

    def _moments(self, x, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and sums of squared deviations of w rows."""
        key = (x, "moments", w)
        if isinstance(x, str) and key in self._made:
            return self._made[key]
        powers = self._powers(x, "moments", w)
        n, mean, square = 0, None, None
        for j in reversed(range(w.bit_length())):
            if w >> j & 1:
                m, s = (back(v, n) for v in powers[j])
                if n:
                    k = 1 << j
                    apart = m - mean
                    mean, square = mean + apart * (k / (n + k)), square + s + apart * apart * (n * k / (n + k))
                else:
                    mean, square = m, s
                n += 1 << j
        found = self._whole(mean, w), self._whole(square, w)
        if isinstance(x, str):
            self._made[key] = found
        return found

    def rmean(self, x, w: int) -> np.ndarray:
        return self._moments(x, w)[0]

    def rstd(self, x, w: int) -> np.ndarray:
        return np.sqrt(self._moments(x, w)[1] / w)

    def rsum(self, x, w: int) -> np.ndarray:
        return self._moments(x, w)[0] * w

    def _extreme(self, x, w: int, kind: str) -> np.ndarray:
        half = self._powers(x, kind, w)[w.bit_length() - 1]
        return self._whole((np.maximum if kind == "max" else np.minimum)(half, back(half, w - (1 << (w.bit_length() - 1)))), w)

    def rmax(self, x, w: int) -> np.ndarray:
        return self._extreme(x, w, "max")

    def rmin(self, x, w: int) -> np.ndarray:
        return self._extreme(x, w, "min")

    def rmedian(self, x, w: int) -> np.ndarray:
        x = np.asarray(self._of(x), float)
        out = np.full(len(x), np.nan)
        if len(x) >= w:
            views = np.lib.stride_tricks.sliding_window_view(x, w)
            at = np.nonzero(self.place[w - 1 :] >= w - 1)[0]
            for some in np.array_split(at, max(1, len(at) * w // 500_000)):
                middle = np.partition(views[some], [(w - 1) // 2, w // 2, w - 1], axis=1)
                value = middle[:, (w - 1) // 2] * 0.5 + middle[:, w // 2] * 0.5
                out[some + w - 1] = np.where(np.isnan(middle[:, w - 1]), np.nan, value)
        return out

    def zscore(self, x, w: int) -> np.ndarray:
        sd = self.rstd(x, w)
        with np.errstate(invalid="ignore"):
            return np.where(sd > EPSILON, quotient(self._of(x) - self.rmean(x, w), sd), np.nan)

    def case(self, *pairs, other=None) -> np.ndarray:
        out = np.nan if other is None else self._of(other)
        for cond, value in reversed(pairs):
            out = np.where(cond, self._of(value), out)
        return out

    def both(self, a, b):
        return a & b

    def greatest(self, *x) -> np.ndarray:
        return np.fmax.reduce([self._of(v) for v in x])

    def least(self, *x) -> np.ndarray:
        return np.fmin.reduce([self._of(v) for v in x])

    def abs(self, x) -> np.ndarray:
        return np.abs(x)

    def weekday(self, x) -> np.ndarray:
        return (self._of(x).astype("datetime64[D]").astype(np.int64) + 3) % 7

    def month(self, x) -> np.ndarray:
        return self._of(x).astype("datetime64[D]").astype("datetime64[M]").astype(np.int64) % 12 + 1
