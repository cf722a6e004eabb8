"""Daily bars: from the order-line tables, and from raw text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of raw bar files, by the names in their header.
RAW_COLUMNS = ["ticker", "per", "date", "time", "open", "high", "low", "close", "vol", "openint"]


def bars_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and day of lineitem; first and last trade by the full key. One partial-aggregated shuffle."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    px = 1000 + F.col("l_extendedprice") / 100
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return (
        lines.groupBy(F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("ticker"), F.to_date("l_shipdate").alias("date"))
        .agg(F.min_by(px, key).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, key).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))
        .where("ticker IS NOT NULL AND date IS NOT NULL")
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line) of all raw bar files."""
    lines = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path)
    return lines.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.regexp_replace("value", "[\\r\\ufeff]", "").alias("line"))


def raw_headers(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, columns, missing) of each file: its header's names without their signs, and the columns that it lacks. One row
    a file; a header is a line that begins with a name in angle brackets."""
    heads = _lines(spark, path).where(F.col("line").startswith("<")).groupBy("source_file").agg(F.min("line").alias("line"))
    columns = F.transform(F.split("line", ","), lambda c: F.lower(F.regexp_replace(F.trim(c), "[<>]", "")))
    every = _lines(spark, path).select("source_file").distinct().join(heads, "source_file", "left").select("source_file", F.coalesce(columns, F.array().cast("array<string>")).alias("columns"))
    return every.withColumn("missing", F.array_except(F.array(*map(F.lit, RAW_COLUMNS)), "columns"))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, reason) of the files that lack a column: all their rows are rejected."""
    return raw_headers(spark, path).where(F.size("missing") > 0).select("source_file", F.concat(F.lit("missing_columns:"), F.array_join("missing", ",")).alias("reason"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All-string raw bar files with the file's name. A file's fields are named by its own header, whatever their order; files that
    lack a column are left out (rejected_files names them)."""
    heads = raw_headers(spark, path).where(F.size("missing") == 0).select("source_file", "columns")
    rows = _lines(spark, path).where(~F.col("line").startswith("<") & (F.trim("line") != "")).join(heads, "source_file")
    named = rows.withColumn("f", F.split("line", ","))
    return named.select(*(F.get("f", (F.array_position("columns", c) - 1).cast("int")).alias(c) for c in RAW_COLUMNS), "source_file")


def raw_text_of(bars: DataFrame) -> DataFrame:
    """Bars as raw text rows, each ticker a file."""
    s = lambda c: F.col(c).cast("string")
    return bars.select(F.concat("ticker", F.lit(".US")).alias("ticker"), F.lit("D").alias("per"), F.date_format("date", "yyyyMMdd").alias("date"), F.lit("000000").alias("time"), s("open").alias("open"), s("high").alias("high"), s("low").alias("low"), s("close").alias("close"), s("volume").alias("vol"), F.lit("0").alias("openint"), F.concat(F.lower("ticker"), F.lit(".us.txt")).alias("source_file"))


def clean_ticker(raw) -> F.Column:
    return F.regexp_replace(F.upper(F.trim(raw)), r"\.US$", "")


def market_of(raw) -> F.Column:
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(F.trim(raw), r"\.([^.]+)$", 1)), F.lit("")), F.lit("UNKNOWN"))


def safe_path_part(x) -> F.Column:
    return F.regexp_replace(F.upper(F.trim(x)), r"[^\p{L}\p{N}_-]", "_")


def time_value(x) -> F.Column:
    t = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"\.0$", "")
    return F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t)


#: The names of the rules, in order.
REASONS = ["bad_per", "bad_time", "bad_date", "bad_numeric_ohlc", "bad_numeric_volume", "bad_ohlc_positive", "bad_volume_negative", "bad_ohlc_consistency", "duplicate_ticker_date", "bad_numeric_openint"]


def validate(raw: DataFrame) -> DataFrame:
    """Raw rows with typed columns (p_*) and `reasons`: every rule a row breaks, in order. A rule whose value is null is
    broken. Duplicates are looked for within a source file, and all copies are rejected."""
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    df = raw.select(
        "*",
        clean_ticker(F.col("ticker")).alias("p_ticker"),
        F.try_to_timestamp(F.when(F.col("date").rlike(r"^\s*\d{8}\s*$"), F.trim("date")), F.lit("yyyyMMdd")).cast("date").alias("p_date"),
        *(number(c).alias(f"p_{c}") for c in ("open", "high", "low", "close", "vol", "openint")),
    )
    o, h, l, c, v = (F.col(f"p_{x}") for x in ("open", "high", "low", "close", "vol"))
    from pyspark.sql import Window

    copies = F.count(F.lit(1)).over(Window.partitionBy("source_file", "p_ticker", "p_date"))
    broken = {
        "bad_per": F.upper(F.trim("per")) != "D",
        "bad_time": time_value(F.col("time")) != "000000",
        "bad_date": F.col("p_date").isNull(),
        "bad_numeric_ohlc": o.isNull() | h.isNull() | l.isNull() | c.isNull(),
        "bad_numeric_volume": v.isNull(),
        "bad_ohlc_positive": F.coalesce((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0), F.lit(False)),
        "bad_volume_negative": F.coalesce(v < 0, F.lit(False)),
        "bad_ohlc_consistency": o.isNull() | h.isNull() | l.isNull() | c.isNull() | ~((h >= F.greatest(o, l, c)) & (l <= F.least(o, h, c))),
        "duplicate_ticker_date": F.col("p_date").isNotNull() & (copies > 1),
        "bad_numeric_openint": F.col("p_openint").isNull(),
    }
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(broken[r], F.lit(True)), F.lit(r)) for r in REASONS)))
    return df.withColumn("reasons", reasons)


def valid_bars(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") == 0).select(F.col("p_date").alias("date"), F.col("ticker").alias("raw_ticker"), F.col("p_ticker").alias("ticker"), *(F.col(f"p_{c}").alias(c) for c in ("open", "high", "low", "close")), F.col("p_vol").cast("long").alias("volume"), F.col("p_openint").cast("long").alias("openint"), "source_file", F.year("p_date").alias("year"))


def file_gaps(validated: DataFrame, low: float = 0.55, high: float = 1.8) -> DataFrame:
    """Of the valid rows of each file and ticker, those that open far from the valid close before, as a split would."""
    from pyspark.sql import Window

    before = F.lag("p_close").over(Window.partitionBy("source_file", "p_ticker").orderBy("p_date"))
    rows = validated.where(F.size("reasons") == 0).select("source_file", F.col("p_ticker").alias("ticker"), F.col("p_date").alias("date"), before.alias("prev_close"), F.col("p_open").alias("open"))
    ratio = F.try_divide("open", "prev_close")
    return rows.where((ratio <= low) | (ratio >= high)).withColumn("gap_pct", (ratio - 1) * 100)


def reject_details(validated: DataFrame) -> DataFrame:
    """One row per broken rule of a row: the file, the row's text and the reason."""
    return validated.where(F.size("reasons") > 0).select("source_file", *RAW_COLUMNS, F.explode("reasons").alias("reason"))


def zero_volume_warnings(validated: DataFrame) -> DataFrame:
    """Valid rows without volume."""
    return validated.where((F.size("reasons") == 0) & (F.col("p_vol") == 0)).select("source_file", "ticker", "date", F.lit("zero_volume_bar").alias("warning"))


def validation_summary(validated: DataFrame) -> DataFrame:
    """Per file: rows, valid and rejected rows, warnings, first and last valid date."""
    ok = F.size("reasons") == 0
    return validated.groupBy("source_file").agg(
        F.count("*").alias("rows"), F.count_if(ok).alias("valid_rows"), F.count_if(~ok).alias("rejected_rows"), F.count_if(ok & (F.col("p_vol") == 0)).alias("zero_volume_rows"),
        F.min(F.when(ok, F.col("p_date"))).alias("min_date"), F.max(F.when(ok, F.col("p_date"))).alias("max_date"),
    )


def reject_counts(validated: DataFrame) -> DataFrame:
    """Rows per broken rule (a row counts once for each)."""
    return validated.select(F.explode("reasons").alias("reason"), "date").groupBy("reason").agg(F.count("*").alias("rows"), F.countDistinct("date").alias("distinct_dates"))
