"""Column helpers with one null rule: nothing divides by zero, no NaN or infinity enters a column."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F



def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


EPSILON = 1e-9


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


class SparkOps:
    """The kernel of rolling and per-row operations; formulas of the feature catalog are written against it."""

    def c(self, name: str) -> Column:
        return F.col(name)

    def lit(self, x) -> Column:
        return F.lit(x)

    def div(self, a, b) -> Column:
        return F.try_divide(col(a), col(b))

    def lag(self, x, k: int) -> Column:
        return F.lag(col(x), k).over(by_ticker())

    def lead(self, x, k: int) -> Column:
        return F.lead(col(x), k).over(by_ticker())

    def _rolling(self, f, x, w: int) -> Column:
        frame = by_ticker().rowsBetween(1 - w, 0)
        return F.when(F.count(col(x)).over(frame) >= w, f(col(x)).over(frame))

    def rmean(self, x, w: int) -> Column:
        return self._rolling(F.avg, x, w)

    def rstd(self, x, w: int) -> Column:
        return self._rolling(F.stddev_pop, x, w)

    def rmax(self, x, w: int) -> Column:
        return self._rolling(F.max, x, w)

    def rmin(self, x, w: int) -> Column:
        return self._rolling(F.min, x, w)

    def rsum(self, x, w: int) -> Column:
        return self._rolling(F.sum, x, w)

    def rmedian(self, x, w: int) -> Column:
        return self._rolling(lambda c: F.percentile(c, F.lit(0.5)), x, w)

    def zscore(self, x, w: int) -> Column:
        sd = self.rstd(x, w)
        return F.when(sd > EPSILON, (col(x) - self.rmean(x, w)) / sd)

    def bar(self) -> Column:
        return F.row_number().over(by_ticker())

    def since(self, x, w: int, high: bool) -> Column:
        """Rows since the newest extreme of the last w rows (fewer at the start)."""
        frame = by_ticker().rowsBetween(1 - w, 0)
        at = F.col("bar")
        newest = F.max_by(at, F.struct(col(x), at)).over(frame) if high else F.min_by(at, F.struct(col(x), -at)).over(frame)
        return at - newest

    def case(self, *pairs, other=None) -> Column:
        out = F.when(pairs[0][0], col(pairs[0][1]) if isinstance(pairs[0][1], str) else pairs[0][1])
        for cond, value in pairs[1:]:
            out = out.when(cond, col(value) if isinstance(value, str) else value)
        return out if other is None else out.otherwise(col(other) if isinstance(other, str) else other)

    def flag(self, cond) -> Column:
        return cond.cast("double")

    def both(self, a, b):
        return a & b

    def greatest(self, *x) -> Column:
        return F.greatest(*map(col, x))

    def least(self, *x) -> Column:
        return F.least(*map(col, x))

    def abs(self, x) -> Column:
        return F.abs(x)

    def ln(self, x) -> Column:
        return F.ln(x)

    def weekday(self, x) -> Column:
        return F.weekday(col(x))

    def month(self, x) -> Column:
        return F.month(col(x))

    def year(self, x) -> Column:
        return F.year(col(x))


def average_rank(x: str, *by: str) -> Column:
    """Rank among non-null values with ties averaged; null for null."""
    order = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    upto = F.count(x).over(order.rangeBetween(Window.unboundedPreceding, 0))
    return F.when(F.col(x).isNotNull(), (F.rank().over(order) + upto) / 2)


def percent_rank(x: str, *by: str) -> Column:
    return average_rank(x, *by) / F.count(x).over(Window.partitionBy(*by))


def row_rank(x: str, *by: str, descending: bool = False) -> Column:
    """1, 2, ... by x; equal values in the order of their tickers."""
    order = F.col(x).desc() if descending else F.col(x).asc()
    return F.row_number().over(Window.partitionBy(*by).orderBy(order, F.col("ticker").asc()))


def bucket(x: str, buckets: int, *by: str) -> Column:
    """1..buckets by row rank: floor((rank - 1) * buckets / n) + 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    found = F.floor((row_rank(x, *by) - 1) * F.lit(float(buckets)) / n) + 1
    return F.least(F.greatest(found, F.lit(1)), F.lit(buckets)).cast("int")


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation of the rows where both are present; null where either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.when(F.stddev_pop(a) * F.stddev_pop(b) > 1e-12, F.stddev_pop(a) * F.stddev_pop(b)))


def rounded(df, keys: list[str], digits: int = 6):
    """Doubles rounded, without negative zero, for comparison and export."""
    return df.select(*(F.col(c) if c in keys or t != "double" else (F.round(c, digits) + F.lit(0.0)).alias(c) for c, t in df.dtypes))
