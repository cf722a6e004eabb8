"""The baseline matrix of large tables: what panel.py and features.py say in Spark's windows, computed on arrays of whole tickers.

Order lines are dealt to tasks by ticker, once, and become bars, gates and labels there (`panel`); what concerns a date (classes
and cross-sectional ranks) is found by date, on few columns (`by_dates`); then the rows meet by ticker again and get the features
(`features`). So no row travels with its features, and no window is summed up row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import ArrayOps, changes, codes, gathered, places, quotient, whole_tickers
from . import catalog as C
from .panel import PanelConfig

PRICES = ["open", "high", "low", "close", "volume"]
#: Columns of the panel besides ticker and date, and those that only signals ask for.
FACTS = ["fwd_ret_5d", "label_valid_5d"]
MORE = ["model_eligible", "history_bars", "median_dollar_volume_60", "zero_volume_count_60"]
RANKED = [f"rank_{c}" for c in C.BASELINE_RANKS]
KINDS = {"ticker": "string", "date": "date", "label_valid_5d": "boolean", "model_eligible": "boolean", "history_bars": "int", "target_class_5d": "int", "day_of_week": "int", "month": "int"}
ARROW = {"string": pa.string(), "date": pa.date32(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}


def schema(names: list[str]) -> str:
    return ", ".join(f"{n} {KINDS.get(n, 'double')}" for n in names)


def _batch(found: dict, names: list[str]) -> pa.RecordBatch:
    """NaN becomes null."""
    arrays = []
    for n in names:
        x, kind = found[n], ARROW[KINDS.get(n, "double")]
        arrays.append(x.cast(kind) if isinstance(x, pa.Array) else pa.array(x.astype(float), kind, from_pandas=True) if kind == pa.float64() else pa.array(x, pa.int32()).cast(kind) if kind == pa.date32() else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(arrays, names)


def _plain(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    x = table.column(name)
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return _plain(table, name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _after(place: np.ndarray) -> np.ndarray:
    """The rows of the ticker after each row, from the rows' places."""
    return places(np.append(place[1:] == 0, True)[::-1])[::-1]


def evaluate(ops: ArrayOps, levels: list[C.Level], wanted: set[str] | None = None) -> None:
    """Adds the levels' columns to the kernel's."""
    for level in levels:
        made = {n: np.asarray(f(ops)) for n, f in level.items() if wanted is None or n in wanted or n[0] == "_"}
        ops.columns.update(made)


def lines_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, px, qty) of the order lines, those of a ticker in one task and in the order of day and full key."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    ticker = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0"))
    rows = lines.select(ticker.alias("ticker"), F.to_date("l_shipdate").alias("date"), *key).where("ticker IS NOT NULL AND date IS NOT NULL")
    rows = rows.repartition("ticker").sortWithinPartitions("ticker", "date", *key)
    return rows.select("ticker", "date", (1000 + F.col("l_extendedprice") / 100).cast("double").alias("px"), F.col("l_quantity").cast("double").alias("qty"))


def panel(lines: DataFrame, cfg: PanelConfig = PanelConfig(), more: bool = False) -> DataFrame:
    """lines_by_ticker() -> ticker, date, prices, fwd_ret_5d, label_valid_5d, the columns that are ranked by date, and with `more` those of MORE."""
    names = ["ticker", "date", *PRICES, *FACTS, *(MORE if more else []), *C.BASELINE_RANKS]
    h = cfg.horizon
    start, research = (np.datetime64(d, "D").astype(int) for d in (cfg.warmup_start, cfg.research_start))

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(whole_tickers(batches)):
            code, day = codes(table.column("ticker")), _plain(table, "date").cast(pa.int32()).to_numpy()
            px, qty = _numbers(table, "px"), _numbers(table, "qty")
            new = changes(code, day)
            at = np.nonzero(new)[0]
            ends = np.append(at[1:], len(new)) - 1
            volume = np.where(np.add.reduceat((~np.isnan(qty)).astype(int), at) > 0, np.trunc(np.add.reduceat(np.nan_to_num(qty), at)), np.nan)
            x = {"open": px[at], "high": np.fmax.reduceat(px, at), "low": np.fmin.reduceat(px, at), "close": px[ends], "volume": volume}
            x["dollar_volume"] = x["close"] * volume
            code, day = code[at], day[at]
            place = places(changes(code))
            ops = ArrayOps(x | {"_zero": np.where(np.isnan(volume), np.nan, volume == 0)}, place, _after(place))
            enough = (place >= cfg.min_history_bars) & (x["close"] >= cfg.price_min) & (ops.rsum("_zero", 20) == 0)
            traded = enough & (ops.rmedian("dollar_volume", 20) >= cfg.median_dollar_volume_min)
            facts = {"model_eligible": traded & (day >= research), "history_bars": place}
            if more:
                facts |= {"median_dollar_volume_60": ops.rmedian("dollar_volume", 60), "zero_volume_count_60": ops.rsum("_zero", 60)}
            used = np.nonzero(day >= start)[0]
            if not len(used):
                continue
            x, facts, code, day = {k: v[used] for k, v in x.items()}, {k: v[used] for k, v in facts.items()}, code[used], day[used]
            place = places(changes(code))
            ops = ArrayOps(x | {"date": day}, place, _after(place))
            ratio = ops.div("open", ops.lag("close", 1))
            gap = (ratio <= cfg.gap_low) | (ratio >= cfg.gap_high)
            ahead = np.zeros(len(gap), bool)
            for k in range(1, h + 1):
                ahead |= ops.lead(gap.astype(float), k) == 1
            x["fwd_ret_5d"] = quotient(ops.lead("close", h), ops.lead("open", 1)) - 1
            x["label_valid_5d"] = (day >= research) & facts["model_eligible"] & ~np.isnan(x["fwd_ret_5d"]) & ~ahead
            evaluate(ops, C.BASELINE, RANK_INPUTS)
            ticker = _plain(table, "ticker").take(pa.array(at[used]))
            yield _batch(ops.columns | x | facts | {"ticker": ticker, "date": day}, names)

    return lines.mapInArrow(bars, schema(names))


#: What the ranked columns are made of, beyond the helping columns.
RANK_INPUTS = {*C.BASELINE_RANKS, "ret_1d", "true_range_pct"}


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of the values that are no NaN, with ties averaged; NaN for NaN."""
    order = np.argsort(x, kind="stable")
    n = len(x) - int(np.isnan(x).sum())
    out = np.full(len(x), np.nan)
    if n:
        s = x[order[:n]]
        first = np.nonzero(changes(s))[0]
        size = np.diff(np.append(first, n))
        out[order[:n]] = np.repeat(first + (size + 1) / 2, size)
    return out


def by_dates(rows: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """panel() with the classes of the forward return and the ranks in place of the columns that are ranked. A date's rows (one per
    name) meet in one task."""
    names = [*(c for c in rows.columns if c not in C.BASELINE_RANKS), "target_class_5d", *RANKED]

    def judge(part: pa.Table) -> pa.Table:
        found = {c: _plain(part, c) for c in names if c in part.column_names}
        valid = _plain(part, "label_valid_5d").to_numpy(zero_copy_only=False).astype(bool)
        target = np.zeros(len(valid), int)
        mine = np.nonzero(valid)[0]
        k = int(len(mine) * cfg.quantile)
        if len(mine) >= 5 and k >= 1:
            some = pa.table({"y": np.round(_numbers(part, "fwd_ret_5d")[mine], 9), "t": _plain(part, "ticker").take(pa.array(mine))})
            order = mine[pc.sort_indices(some, sort_keys=[("y", "ascending"), ("t", "ascending")]).to_numpy()]
            target[order[:k]], target[order[-k:]] = -1, 1
        found["target_class_5d"] = target
        for c in C.BASELINE_RANKS:
            r = average_ranks(np.round(_numbers(part, c), 9))
            found[f"rank_{c}"] = r / max(1, int((~np.isnan(r)).sum()))
        return pa.Table.from_batches([_batch(found, names)])

    return rows.groupBy("date").applyInArrow(judge, schema(names))


def features(rows: DataFrame, wanted: list[str], keep_invalid: bool = False, also: tuple[str, ...] = (), only: DataFrame | None = None, every: DataFrame | None = None) -> DataFrame:
    """by_dates() -> date, ticker, fwd_ret_5d, target_class_5d, `also`, and the wanted features of the label-valid rows (or with
    `keep_invalid` of all). `only`(date): the dates whose rows are asked for; `every`(date): dates of which all rows are. Features
    see all."""
    names = ["date", "ticker", "fwd_ret_5d", "target_class_5d", *also, *wanted]
    given = list(dict.fromkeys(["ticker", "date", *PRICES, "fwd_ret_5d", "target_class_5d", "label_valid_5d", *also, *(w for w in wanted if w in RANKED)]))
    numbers = lambda df: None if df is None else np.array([r[0] for r in df.select(F.unix_date("date")).distinct().collect()], int)  # noqa: E731  one row a date
    days, whole = numbers(only), numbers(every)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(whole_tickers(batches)):
            day = _plain(table, "date").cast(pa.int32()).to_numpy()
            kept = np.ones(len(day), bool) if keep_invalid else _plain(table, "label_valid_5d").to_numpy(zero_copy_only=False).astype(bool)
            if whole is not None:
                kept = kept | np.isin(day, whole)
            if days is not None:
                kept = kept & np.isin(day, days)
            at = np.nonzero(kept)[0]
            if not len(at):
                continue
            place = places(changes(codes(table.column("ticker"))))
            x = {c: _numbers(table, c) for c in PRICES} | {"date": day}
            ops = ArrayOps(x | {"dollar_volume": x["close"] * x["volume"]}, place, _after(place))
            evaluate(ops, C.BASELINE)
            took = pa.array(at)
            yield _batch({n: ops.columns[n][at] if n in wanted and n not in RANKED or n == "date" else _plain(table, n).take(took) for n in names}, names)

    dealt = rows.select(*given).repartition("ticker").sortWithinPartitions("ticker", "date")
    return dealt.mapInArrow(build, schema(names))
