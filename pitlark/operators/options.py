"""Option-chain snapshots: import schema, hard rules, links to candidates, coverage, and batches by manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The import schema by kind of column, the hand-made template's own names, the duplicate key, the manifest's columns.
TEXTS = ["underlying_ticker", "option_symbol", "call_put", "data_source", "data_delay_status"]
DAYS = ["snapshot_date", "expiration"]
TIMES = ["snapshot_timestamp", "quote_timestamp"]
NUMBERS = ["underlying_price", "DTE", "strike", "bid", "ask", "mid", "last", "volume", "open_interest", "implied_volatility", "delta", "gamma", "theta", "vega"]
CORE = ["snapshot_date", "underlying_ticker", "option_symbol", "expiration", "strike", "call_put", "bid", "ask", "data_source"]
SCHEMA = ["snapshot_date", "snapshot_timestamp", "underlying_ticker", "underlying_price", "option_symbol", "expiration", "DTE", "strike", "call_put", "bid", "ask", "mid", "last", "volume", "open_interest", "implied_volatility", "delta", "gamma", "theta", "vega", "data_source", "data_delay_status", "quote_timestamp"]
TEMPLATE = {"underlying": "underlying_ticker", "dte": "DTE", "option_type": "call_put", "source": "data_source"}
KEY = ["snapshot_date", "data_source", "underlying_ticker", "option_symbol", "expiration", "strike", "call_put"]
MANIFEST = ["file_path", "underlying", "snapshot_date", "snapshot_time", "source", "notes"]


def from_template(raw: DataFrame) -> DataFrame:
    """The hand-made template in the import schema's names: date and time make the timestamp, the contract its symbol if none is given."""
    if "underlying" not in raw.columns or "underlying_ticker" in raw.columns:
        return raw
    df = raw.withColumnsRenamed(TEMPLATE)
    if "option_symbol" not in df.columns:
        df = df.withColumn("option_symbol", F.concat_ws("_", "underlying_ticker", "expiration", "call_put", "strike"))
    if "snapshot_time" in df.columns:
        df = df.withColumn("snapshot_timestamp", F.when(F.trim("snapshot_time") != "", F.concat_ws(" ", "snapshot_date", "snapshot_time"))).drop("snapshot_time")
    return df


def normalize(raw: DataFrame, *keep: str) -> DataFrame:
    """All-string rows typed; optional columns that are absent are null, what does not parse is null. CALL and PUT become C and P;
    the middle price and the days to expiry are computed where they are absent."""
    df = from_template(raw)
    if lacks := [c for c in CORE if c not in df.columns]:
        raise ValueError(f"core columns are missing: {lacks}")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    kinds = {c: lambda c: text(c) for c in TEXTS} | {c: lambda c: F.try_to_timestamp(text(c), F.lit("yyyy-MM-dd")).cast("date") for c in DAYS}
    kinds |= {c: lambda c: F.expr(f"try_cast(nullif(trim(`{c}`), '') as timestamp)") for c in TIMES} | {c: lambda c: F.expr(f"try_cast(nullif(trim(`{c}`), '') as double)") for c in NUMBERS}
    types = {c: "string" for c in TEXTS} | {c: "timestamp" for c in TIMES} | {c: "double" for c in NUMBERS}
    out = df.select(*keep, *((kinds[c](c) if c in df.columns else F.lit(None).cast(types.get(c, "date"))).alias(c) for c in SCHEMA))
    call_put = F.upper("call_put")
    return out.withColumns({
        "underlying_ticker": F.upper("underlying_ticker"), "call_put": F.when(call_put == "CALL", "C").when(call_put == "PUT", "P").otherwise(call_put),
        "mid": F.coalesce("mid", (F.col("bid") + F.col("ask")) / 2), "DTE": F.coalesce("DTE", F.datediff("expiration", "snapshot_date").cast("double")),
    })


#: The hard rules, in order; a snapshot that breaks any is refused.
HARD_RULES = ["null_core", "call_put", "negative", "negative_volume", "crossed", "expired", "duplicate"]


def flagged(options: DataFrame, *by: str) -> DataFrame:
    """The options with a column per hard rule (broken_<rule>). A rule over a null is not broken."""
    df = options.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*by, *KEY)))
    null = F.lit(False)
    for c in CORE:
        null = null | F.col(c).isNull()
    rules = {
        "null_core": null, "call_put": ~F.col("call_put").isin("C", "P"), "negative": (F.col("bid") < 0) | (F.col("ask") < 0) | (F.col("strike") < 0),
        "negative_volume": F.coalesce(F.col("volume") < 0, F.lit(False)) | F.coalesce(F.col("open_interest") < 0, F.lit(False)), "crossed": F.col("ask") < F.col("bid"),
        "expired": F.col("expiration") <= F.col("snapshot_date"), "duplicate": F.col("_copies") > 1,
    }
    return df.withColumns({f"broken_{name}": F.coalesce(rules[name], F.lit(False)) for name in HARD_RULES}).drop("_copies")


def faults(options: DataFrame, *by: str) -> DataFrame:
    """How many rows break each hard rule (per `by`, else one row)."""
    return flagged(options, *by).groupBy(*by).agg(*(F.count_if(f"broken_{name}").alias(name) for name in HARD_RULES))


def import_facts() -> dict:
    """What is observed of flagged() options while they are written: rows, how many break each rule, missing optional values, days."""
    optional = [c for c in SCHEMA if c not in CORE]
    return {"rows": F.count(F.lit(1)), **{n: F.count_if(f"broken_{n}") for n in HARD_RULES}, **{f"missing_{c}": F.count_if(F.col(c).isNull()) for c in optional}, "first_snapshot_date": F.min("snapshot_date"), "last_snapshot_date": F.max("snapshot_date")}


def broken_rules(facts: dict) -> list[str]:
    return [f"{n}: {facts[n]} rows" for n in HARD_RULES if facts[n]] + ([] if facts["rows"] else ["no rows"])


def checked(options: DataFrame) -> DataFrame:
    """The options, if they break no rule."""
    bad = {k: v for k, v in faults(options).first().asDict().items() if v}
    if bad:
        raise ValueError(f"the option chain breaks rules: {bad}")
    return options


def link(options: DataFrame, candidates: DataFrame) -> DataFrame:
    """Options with their underlying's candidate (ticker, score_date, ...: one per ticker, else an error) and whether the dates match."""
    if candidates.groupBy("ticker").count().where("count > 1").limit(1).count():
        raise ValueError("a ticker has several candidates")
    df = options.join(candidates.withColumnRenamed("ticker", "underlying_ticker"), "underlying_ticker", "left")
    return df.withColumns({"is_candidate": F.col("score_date").isNotNull(), "snapshot_matches_score_date": F.coalesce(F.col("snapshot_date") == F.col("score_date"), F.lit(False))})


def coverage(linked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per candidate its snapshots, contracts, dates joined by '|', the latest, and whether any matches the score date."""
    per = linked.groupBy(F.col("underlying_ticker").alias("ticker")).agg(
        F.countDistinct("snapshot_date").alias("snapshots"), F.count("*").alias("contracts"), F.array_join(F.array_sort(F.collect_set(F.col("snapshot_date").cast("string"))), "|").alias("dates"),
        F.max("snapshot_date").alias("latest"), F.bool_or("snapshot_matches_score_date").alias("matches"),
    )
    return candidates.join(per, "ticker", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("snapshots", "contracts")} | {"matches": F.coalesce("matches", F.lit(False))})


def import_batch(raw: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All snapshots of a manifest in one job: (accepted options, one row per file with its status and reasons).

    raw: all-string option rows of every file with file_path. manifest: MANIFEST columns as text, paths unique. A file is refused
    when it has no rows, breaks a hard rule, or holds another underlying, date, source or time than its manifest row says.
    """
    if manifest.columns != MANIFEST:
        raise ValueError(f"manifest columns must be {MANIFEST}")
    if manifest.groupBy("file_path").count().where("count > 1 OR trim(coalesce(file_path, '')) = ''").limit(1).count():
        raise ValueError("manifest paths must be given and unique")
    options = normalize(raw, "file_path")
    clock = F.date_format("snapshot_timestamp", "HH:mm:ss")
    seen = options.groupBy("file_path").agg(F.count("*").alias("rows"), *(F.min(c).alias(f"lo_{n}") for n, c in _SEEN.items()), *(F.max(c).alias(f"hi_{n}") for n, c in _SEEN.items()), F.min(clock).alias("lo_time"), F.max(clock).alias("hi_time"))
    told = manifest.select(
        "file_path", F.upper(F.trim("underlying")).alias("underlying"), F.try_to_timestamp(F.trim("snapshot_date"), F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.trim("source").alias("source"),
        F.nullif(F.trim("snapshot_time"), F.lit("")).alias("given_time"), "notes",
    )
    told = told.withColumn("time", F.date_format(F.expr("try_cast(concat('2000-01-01 ', given_time) as timestamp)"), "HH:mm:ss"))
    judged = told.join(seen, "file_path", "left").join(faults(options, "file_path"), "file_path", "left")
    differs = lambda n: ~(F.col(f"lo_{n}").eqNullSafe(F.col(n)) & F.col(f"hi_{n}").eqNullSafe(F.col(n)))
    rules = [F.when(F.col("rows").isNull(), "no_rows"), *(F.when(F.col(c) > 0, c) for c in ("null_core", "call_put", "negative", "negative_volume", "crossed", "expired", "duplicate"))]
    rules += [F.when(F.col("rows").isNotNull() & differs(n), f"{n}_mismatch") for n in _SEEN] + [F.when(F.col("rows").isNotNull() & F.col("given_time").isNotNull() & (F.col("time").isNull() | differs("time")), "time_mismatch")]
    files = judged.withColumn("reasons", F.array_compact(F.array(*rules))).select("file_path", "underlying", F.col("date").alias("snapshot_date"), "source", "notes", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.size("reasons") == 0, "ok").otherwise("failed").alias("status"), "reasons")
    return options.join(files.where("status = 'ok'").select("file_path"), "file_path", "left_semi"), files


_SEEN = {"underlying": "underlying_ticker", "date": "snapshot_date", "source": "data_source"}


def batch_summary(good: DataFrame, files: DataFrame) -> DataFrame:
    """One row over an import: files by status, the rows of those that are taken, and how many of these lack each optional value."""
    told = files.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "ok").alias("ok_files"), F.count_if(F.col("status") != "ok").alias("failed_files"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("rows"))), F.lit(0)).alias("rows"))
    return told.crossJoin(good.agg(*(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in SCHEMA if c not in CORE)))  # one row each
