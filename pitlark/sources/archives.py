"""Archives, raw text files and listings as tables: members and their schemas, file manifests, strict exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bars as B
from .readers import LISTING_COLUMNS, LISTING_STATES, SAMPLE_LINES, register


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """One row per member of every ZIP archive below path, with its first lines if it is text, and the archive's digest. A range of
    an archive's directory is a task; a broken archive or member is one row with its failure."""
    found = register(spark).read.format("zip_members").load(path)
    digests = spark.read.format("file_facts").option("suffix", ".zip").load(path).select("path", F.col("sha256").alias("archive_sha256"))
    return found.join(digests, "path", "left").drop("path")


def inventory(members: DataFrame) -> DataFrame:
    """Members with their kind, symbol, delimiter, columns, first and last sampled date, rows, warnings and status."""
    path = F.translate("member", "\\", "/")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.upper(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))
    parent = F.upper(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    low = F.lower(path)
    kind = (
        F.when(path.endswith("/"), "directory").when((name == "DAT") & parent.rlike(r"^F\d+$"), "metastock_data")
        .when(name == "MASTER", "metastock_master").when(name == "EMASTER", "metastock_emaster")
        .when(low.endswith(".dop"), "metastock_dop").when(low.endswith(".dat"), "metastock_data")
        .when(low.endswith(".txt"), F.when(low.contains("/daily/"), "daily_ascii").when(low.contains("/hourly/"), "hourly_ascii").otherwise("unknown_ascii"))
        .otherwise("unknown")
    )
    header = F.trim(F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")))
    delimiter = F.lit("unknown")
    for d in (";", "|", "\t", ","):
        delimiter = F.when(header.contains(d), d).otherwise(delimiter)
    text = F.col("kind").endswith("_ascii") & F.col("line_count").isNotNull() & (F.col("line_count") > 0)
    df = members.select("*", kind.alias("kind"), header.alias("_header"), delimiter.alias("_delimiter"))
    df = df.withColumn("columns", F.when(text, F.transform(F.expr(r"split(_header, concat('\\Q', _delimiter, '\\E'))"), lambda c: F.lower(F.regexp_replace(F.trim(c), "^[<>]+|[<>]+$", ""))))
                       .when(F.col("kind") == "metastock_dop", F.transform(F.filter("lines", lambda x: x.contains(",")), lambda x: F.regexp_replace(F.substring_index(F.trim(x), ",", 1), '^"+|"+$', ""))))
    rows = F.filter(F.slice("lines", 2, SAMPLE_LINES), lambda x: F.trim(x) != "")
    cells = F.transform(rows, lambda x: F.split(x, F.expr(r"concat('\\Q', _delimiter, '\\E')")))
    value = lambda c: F.array_compact(F.transform(F.col("_cells"), lambda r: F.trim(F.try_element_at(r, F.array_position("columns", F.lit(c)).cast("int")))))
    there = lambda c: F.array_contains("columns", c)
    df = df.withColumn("_cells", F.when(text, cells))
    df = df.withColumns({"_dates": F.when(there("date"), value("date")), "_pers": F.when(there("per"), F.array_sort(F.array_distinct(value("per"))))})
    warning = F.array_compact(F.array(
        F.when(F.col("kind").isin("metastock_master", "metastock_emaster", "metastock_data"), "binary_format_not_parsed"), F.when(F.col("kind").isin("unknown") & F.col("failure").isNull(), "unknown_file_type"),
        F.when(F.col("kind").endswith("_ascii") & (F.col("encoding") == "binary"), "binary_file_skipped"), F.when(F.col("line_count") == 0, "empty_file"),
    ))
    return df.select(
        "archive", "archive_sha256", "member", "kind", F.upper(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"\.[^.]*$", "")).alias("symbol"), "size_bytes", "encoding", F.when(text, F.col("_delimiter")).alias("delimiter"), "columns",
        F.when(text, F.col("line_count") - 1).alias("rows"), F.try_element_at("_dates", F.lit(1)).alias("first_date"), F.try_element_at("_dates", F.lit(-1)).alias("last_date"),
        F.when(F.col("_pers") == F.array(F.lit("D")), "daily").when(F.col("_pers") == F.array(F.lit("60")), "hourly").when(text, "unknown").alias("period"),
        warning.alias("warnings"), "failure", F.when(F.col("failure").isNotNull(), "FAIL").when((F.size(warning) > 0) & ~F.col("kind").startswith("metastock"), "WARN").otherwise("PASS").alias("status"),
    )


def schema_profile(found: DataFrame) -> DataFrame:
    """Per archive and kind: members, symbols, distinct column lists, date span, failures and warnings."""
    return found.groupBy("archive", "archive_sha256", "kind").agg(
        F.count("*").alias("members"), F.countDistinct("symbol").alias("symbols"), F.sort_array(F.collect_set(F.array_join("columns", ","))).alias("schemas"), F.sum("rows").alias("rows"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.count_if(F.col("status") == "FAIL").alias("failures"), F.count_if(F.col("status") == "WARN").alias("warnings"),
    )


def archive_profile(found: DataFrame) -> DataFrame:
    """One row over all members of inventory(): how many of each kind, the first daily and hourly member with columns as reference
    schemas, the first field list of the other format, rows, symbols, span of dates, and what is there or missing."""
    order = F.struct("archive", "member")
    first = lambda kind: F.min_by(F.struct("columns", "delimiter", "encoding", F.col("member").alias("sample_file")), F.when((F.col("kind") == kind) & (F.size("columns") > 0), order))
    kinds = found.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("file_type_counts"))  # a row a kind
    one = found.agg(
        F.count("*").alias("total_inner_files"), F.sum("rows").alias("total_sampled_rows"), F.countDistinct(F.when(F.col("kind") == "daily_ascii", F.col("symbol"))).alias("unique_symbols_estimate"),
        F.min("first_date").alias("earliest"), F.max("last_date").alias("latest"), first("daily_ascii").alias("daily_schema"), first("hourly_ascii").alias("hourly_schema"), first("metastock_dop")["columns"].alias("metastock_dop_fields"),
        F.count_if(F.col("kind").isin("unknown", "unknown_ascii")).alias("unknown_files_count"), F.coalesce(F.bool_or(F.col("kind").startswith("metastock")), F.lit(False)).alias("metastock_present"), F.count_if(F.col("status") == "FAIL").alias("failures"),
    )
    return one.crossJoin(kinds)  # one row each


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per raw text file: size, SHA-256, rows without the header, raw and clean ticker, span of dates, status. One row per file, which
    is read once, in chunks, whatever its size."""
    df = register(spark).read.format("file_facts").option("suffix", ".txt").load(path)
    stem = F.upper(F.regexp_replace("source_file", r"\.[^.]*$", ""))
    ok = F.size("missing") == 0
    return df.select(
        "source_file", F.coalesce("first_ticker", F.lit("")).alias("raw_ticker"), F.coalesce(B.clean_ticker(F.col("first_ticker")), stem).alias("ticker"), "file_size_bytes", "row_count", "min_date", "max_date", "sha256",
        F.when(ok, "ok").otherwise("error").alias("parse_status"), F.when(ok, "").otherwise(F.concat(F.lit("missing columns: "), F.array_join("missing", ", "))).alias("error_message"),
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """One row: files, how many of them parse, and rows."""
    return manifest.agg(F.count("*").alias("files_scanned"), F.count_if(F.col("parse_status") == "ok").alias("parse_ok"), F.count_if(F.col("parse_status") == "error").alias("parse_error"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_total"))


def strict_export(raw: DataFrame) -> DataFrame:
    """Raw rows typed for the per-ticker export; a value that does not parse fails the job. Sorted inside a ticker's files."""
    up = F.upper(F.trim("ticker"))
    day = F.to_date(F.trim("date"), "yyyyMMdd")
    df = raw.select(
        up.alias("raw_ticker"), B.clean_ticker(F.col("ticker")).alias("ticker"), B.market_of(F.col("ticker")).alias("market"), F.trim("per").alias("per"), day.alias("date"), B.time_value(F.col("time")).alias("time"),
        *(F.trim(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), F.trim("vol").cast("double").alias("volume"), F.trim("openint").cast("double").alias("openint"), F.year(day).alias("year"), "source_file",
    )
    return df.withColumns({"market_year": F.concat_ws("-", "market", F.col("year").cast("string")), "ticker_path": B.safe_path_part(F.col("ticker"))})


def read_listing(spark: SparkSession, path: str, state: str, asof: str = "", source: str = "listing_status") -> DataFrame:
    """A listing-status CSV as text with its state, source and as-of date; rows blank in every column go, empty cells are ''."""
    if state not in LISTING_STATES:
        raise ValueError(f"state must be one of {LISTING_STATES}")
    df = spark.read.csv(path, header=True, inferSchema=False)
    if lacks := [c for c in LISTING_COLUMNS if c not in df.columns]:
        raise ValueError(f"columns are missing: {lacks}")
    df = df.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in LISTING_COLUMNS)).where(F.concat(*LISTING_COLUMNS) != "")
    return df.withColumns({"query_state": F.lit(state), "source": F.lit(source), "source_asof_date": F.lit(asof)})


def fetch_listing(spark: SparkSession, url: str, asof: str, source: str = "listing_status", **options: str) -> DataFrame:
    """The listing of each state over HTTP (see readers.Listing), as read_listing() gives it."""
    df = register(spark).read.format("listing_status").options(url=url, **options).load()
    return df.withColumns({"source": F.lit(source), "source_asof_date": F.lit(asof)})


def listing_export(listing: DataFrame) -> DataFrame:
    """The listing with the years of its dates (none where a date is blank or no date), by state, status, symbol and listing date."""
    year = lambda c: F.year(F.try_to_timestamp(F.when(~F.col(c).isin("", "null", "None"), F.col(c)), F.lit("yyyy-MM-dd"))).cast("int")
    return listing.withColumns({f"{c}_year": year(c) for c in ("ipoDate", "delistingDate", "source_asof_date")}).orderBy("query_state", "status", "symbol", "ipoDate", "delistingDate")


def listing_counts(listing: DataFrame) -> DataFrame:
    """(what, value, rows): rows by status and by queried state; a missing value is counted as such."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("status", "query_state"))))
    return listing.select(each.alias("e")).groupBy("e.what", "e.value").agg(F.count("*").alias("rows"))
