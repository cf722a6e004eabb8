"""Data-quality audits, and coverage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_volume(bars: DataFrame) -> DataFrame:
    df = bars.groupBy("ticker").agg(F.count_if(F.col("volume") == 0).alias("zero_rows"), F.count("*").alias("rows"))
    return df.where("zero_rows > 0").withColumn("zero_pct", F.col("zero_rows") / F.col("rows"))


def tradable_coverage(gated: DataFrame, key: str) -> DataFrame:
    return gated.groupBy(key).agg(F.count("*").alias("rows"), F.count_if("tradable").alias("tradable_rows"), F.avg(F.col("tradable").cast("double")).alias("coverage"))


def gap_impact(gaps: DataFrame, research: DataFrame) -> DataFrame:
    """Per year of the gaps (a null year is a group): how many lie in the research data, eligible or not."""
    status = research.select("ticker", "date", "model_eligible", F.lit(True).alias("_hit")).dropDuplicates(["ticker", "date"])
    df = gaps.join(status, ["ticker", "date"], "left")
    inside = F.col("_hit").isNotNull()
    return df.groupBy(F.year("date").alias("gap_year")).agg(F.count("*").alias("gaps"), F.count_if(inside).alias("in_research"), F.count_if(inside & F.col("model_eligible")).alias("eligible"), F.count_if(inside & ~F.col("model_eligible")).alias("not_eligible"))


def symbol_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tickers on both sides, only left, only right: one aggregation, no sets on the driver."""
    both = a.select("ticker", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select("ticker", F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.groupBy("ticker").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    l, r = F.col("l") == 1, F.col("r") == 1
    return per.agg(F.count_if(l & r).alias("both"), F.count_if(l & ~r).alias("only_left"), F.count_if(~l & r).alias("only_right"))


def blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _day(c: str) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")), F.lit("yyyy-MM-dd"))


def _fault(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


#: Fixed values of the security master: columns, which of them are dates and flags, and which may be empty.
MASTER_COLUMNS = ["permanent_id", "raw_ticker", "ticker", "security_type", "listing_date", "delisting_date", "ticker_start_date", "ticker_end_date", "exchange", "is_otc", "is_common_stock", "is_etf", "is_etn", "is_adr", "source", "source_asof_date"]
MASTER_DATES = ["listing_date", "delisting_date", "ticker_start_date", "ticker_end_date", "source_asof_date"]
MASTER_FLAGS = ["is_otc", "is_common_stock", "is_etf", "is_etn", "is_adr"]
MASTER_OPEN = ["delisting_date", "ticker_end_date"]
MASTER_IDENTITY = ["permanent_id", "ticker", "ticker_start_date"]
FLAG_WORDS = ["true", "1", "yes", "y", "false", "0", "no", "n"]


def audit_master(master: DataFrame) -> DataFrame:
    """One row over an all-string security master ('' is null): empty required values, bad dates and flags, duplicate identities,
    reversed intervals, delisted rows. A column that is absent counts as missing and has no other figures (null)."""
    there = set(master.columns)
    key = [c for c in MASTER_IDENTITY if c in there]
    copies = F.count(F.lit(1)).over(Window.partitionBy(*key)) if len(key) == 3 else F.lit(1)
    df = master.withColumn("_copies", copies)
    none = lambda name: F.lit(None).cast("long").alias(name)
    required = [c for c in MASTER_COLUMNS if c not in MASTER_OPEN + MASTER_FLAGS]
    bad_day = lambda c: _day(c).isNull() & (F.lit(c not in MASTER_OPEN) | ~blank(c))
    late = lambda a, b, name: _fault(_day(a) > _day(b), name) if {a, b} <= there else none(name)
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len([c for c in MASTER_COLUMNS if c not in there])).alias("missing_columns"),
        *(_fault(blank(c), f"empty_{c}") if c in there else none(f"empty_{c}") for c in required),
        *(_fault(bad_day(c), f"bad_date_{c}") if c in there else none(f"bad_date_{c}") for c in MASTER_DATES),
        *(_fault(~F.coalesce(F.lower(F.trim(c)), F.lit("")).isin(FLAG_WORDS), f"bad_flag_{c}") if c in there else none(f"bad_flag_{c}") for c in MASTER_FLAGS),
        _fault(F.col("_copies") > 1, "duplicate_identity"),
        late("listing_date", "delisting_date", "reversed_listing"), late("ticker_start_date", "ticker_end_date", "reversed_ticker"),
        _fault(~blank("delisting_date"), "delisted_rows") if "delisting_date" in there else none("delisted_rows"),
    )


#: Fixed values of corporate actions.
EVENT_COLUMNS = ["raw_ticker", "ticker", "event_date", "action_type", "source", "source_asof_date"]
EVENT_DATES = ["event_date", "source_asof_date", "ex_date", "record_date", "pay_date"]
EVENT_NUMBERS = ["cash_amount", "adjustment_factor"]
EVENT_TYPES = ["split", "cash_dividend", "stock_dividend", "distribution", "merger", "spinoff"]
POLICY_FIELDS = ["source", "source_asof_date", "ohlcv_source", "price_adjustment_policy", "volume_adjustment_policy", "split_adjustment_status", "dividend_adjustment_status", "distribution_adjustment_status", "official_documentation_reference"]


def audit_events(events: DataFrame) -> DataFrame:
    """One row over all-string corporate actions: empty required values, bad dates (required ones may not be empty), numbers that do
    not parse or are not positive, zero split ratios, unknown action types. Absent columns have null figures."""
    there = set(events.columns)
    none = lambda name: F.lit(None).cast("long").alias(name)
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    fault = lambda c, cond, name: _fault(cond(c), name) if c in there else none(name)
    return events.agg(
        F.count("*").alias("rows"),
        F.lit(len([c for c in EVENT_COLUMNS if c not in there])).alias("missing_columns"),
        *(fault(c, blank, f"empty_{c}") for c in EVENT_COLUMNS),
        *(fault(c, lambda c: _day(c).isNull() & (F.lit(c in EVENT_COLUMNS) | ~blank(c)), f"bad_date_{c}") for c in EVENT_DATES),
        *(fault(c, lambda c: ~blank(c) & F.coalesce(number(c) <= 0, F.lit(True)), f"bad_number_{c}") for c in EVENT_NUMBERS),
        fault("split_ratio", lambda c: F.trim(c) == "0", "zero_split_ratio"),
        fault("action_type", lambda c: ~F.coalesce(F.lower(F.trim(c)), F.lit("")).isin(EVENT_TYPES), "unknown_action_type"),
    )


def audit_blockers(counts: dict) -> list[str]:
    """The kinds of fault that an audit's row holds."""
    kinds = {"missing_columns": "missing_required_columns", "empty_": "empty_required_values", "bad_date_": "invalid_date_values", "bad_flag_": "invalid_boolean_values", "bad_number_": "invalid_numeric_values", "zero_split": "invalid_numeric_values", "duplicate": "duplicate_identity_rows", "reversed": "reversed_date_intervals", "unknown_action": "unsupported_action_types"}
    return sorted({kind for k, v in counts.items() if v for start, kind in kinds.items() if k.startswith(start)})


def audit_policy(policy: dict) -> list[str]:
    """What keeps an adjustment policy from use: missing and empty fields, a bad as-of date."""
    out = [f"missing:{f}" for f in POLICY_FIELDS if f not in policy] + [f"empty:{f}" for f in POLICY_FIELDS if f in policy and not str(policy[f]).strip()]
    try:
        dt.date.fromisoformat(str(policy.get("source_asof_date", "2000-01-01")))
    except ValueError:
        out.append("invalid_date:source_asof_date")
    return out
