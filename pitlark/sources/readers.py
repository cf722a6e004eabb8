"""Python data sources: members of ZIP archives, facts of files of any size, and listings over HTTP.

A partition is a range of an archive's directory, some files, or one request. Files are opened where they lie by seeking, so a
task reads the ranges of its members alone; a file of any size passes through a buffer of fixed size. Secrets are named by
the options and read where they are used: no plan, log or error holds one.
"""

from __future__ import annotations

import csv
import datetime as dt
import hashlib
import io
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBER_SCHEMA = "archive string, path string, member string, size_bytes long, encoding string, lines array<string>, line_count long, failure string"
FACTS_SCHEMA = "path string, source_file string, file_size_bytes long, sha256 string, row_count long, first_ticker string, min_date date, max_date date, missing array<string>"
#: Data lines of a member that are looked at.
SAMPLE_LINES = 2000
#: Members of a partition; files of a partition, by number and bytes; bytes that are read at a time.
MEMBERS, FILES, FILE_BYTES, CHUNK = 256, 500, 128 << 20, 1 << 20


def found_files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files with a suffix at or below a path of any store that Arrow reaches, by path."""
    fs, base = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    info = fs.get_file_info(base)
    each = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((f"{scheme}{i.path}" if not scheme.startswith("file") else f"file://{i.path}", i.size) for i in each if i.type == pafs.FileType.File and i.path.lower().endswith(suffix))


def opened(path: str) -> pa.NativeFile:
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def encoding_of(head: bytes) -> str:
    for name in ("ascii", "utf-8"):
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if name == "utf-8" and e.start >= len(head) - 3:  # a character cut at the sample's end
                return name
    return "binary"


@dataclass
class MemberRange(InputPartition):
    """Members first to last of an archive's directory in the order of their names; without any, the archive as it fails."""

    path: str
    size: int
    first: int
    last: int
    failure: str | None = None


class ZipMembers(DataSource):
    """spark.read.format("zip_members").load(path): a row per member of every ZIP archive at or below the path."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options)


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.members = options["path"], int(options.get("members", MEMBERS))

    def partitions(self) -> list[MemberRange]:
        out = []
        for path, size in found_files(self.path, ".zip"):
            try:
                with opened(path) as file, zipfile.ZipFile(file) as archive:  # the directory only
                    n = len(archive.infolist())
                out += [MemberRange(path, size, a, min(n, a + self.members)) for a in range(0, n, self.members)]
            except (zipfile.BadZipFile, pa.ArrowInvalid) as error:  # Arrow's is that of a file too short for a directory
                out.append(MemberRange(path, size, 0, 0, f"BadZipFile: {error}"))
            except OSError as error:
                out.append(MemberRange(path, size, 0, 0, f"{type(error).__name__}: {error}"))
        return out

    def read(self, partition: MemberRange) -> Iterator[tuple]:
        name = partition.path.rsplit("/", 1)[-1]
        if partition.failure:
            yield name, partition.path, name, partition.size, None, [], None, partition.failure
            return
        with opened(partition.path) as file, zipfile.ZipFile(file) as archive:
            for info in sorted(archive.infolist(), key=lambda i: i.filename)[partition.first : partition.last]:
                kind, lines, count, failure = None, [], None, None
                if info.filename.lower().endswith((".txt", ".dop")):
                    try:
                        with archive.open(info) as member:
                            kind = encoding_of(member.read(8192))
                        if kind != "binary":
                            with archive.open(info) as member:  # line by line: a long member is never held whole
                                count = 0
                                for line in io.TextIOWrapper(member, kind, errors="replace"):
                                    count += 1
                                    if count <= SAMPLE_LINES + 1:
                                        lines.append(line.rstrip("\r\n"))
                    except Exception as error:  # whatever a broken member raises, it is one row
                        failure = f"{type(error).__name__}: {error}"
                yield name, partition.path, info.filename, info.file_size, kind, lines, count, failure


@dataclass
class FileGroup(InputPartition):
    paths: list[tuple[str, int]]


class FileFacts(DataSource):
    """spark.read.format("file_facts").option("suffix", ".txt").load(path): digest, lines and (of raw bars) first ticker and span of
    dates of every file at or below the path, each read once and never held whole."""

    @classmethod
    def name(cls) -> str:
        return "file_facts"

    def schema(self) -> str:
        return FACTS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FactsReader(self.options)


class _FactsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.chunk = options["path"], options.get("suffix", ""), int(options.get("chunk", CHUNK))

    def partitions(self) -> list[FileGroup]:
        groups: list[FileGroup] = []
        size = 0
        for path, length in found_files(self.path, self.suffix):
            if not groups or len(groups[-1].paths) >= FILES or size + length > FILE_BYTES:
                groups.append(FileGroup([]))
                size = 0
            groups[-1].paths.append((path, length))
            size += length
        return groups

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        for path, length in partition.paths:
            with opened(path) as file:
                facts = file_facts(iter(lambda: file.read(self.chunk), b""))
            yield path, path.rsplit("/", 1)[-1], length, *facts


class Lines:
    """What is said of a file's lines, as they come: their number without the header, the first ticker, the span of dates."""

    def __init__(self):
        self.count, self.header, self.ticker, self.days = 0, None, None, set()
        self.least = self.most = None

    def add(self, line: bytes) -> None:
        self.count += 1
        text = line.strip(b"\r\n\t ")
        if not text:
            return
        cells = text.split(b",")
        if self.header is None:
            names = [c.strip().strip(b"<>").lower() for c in cells]
            self.header = {n: names.index(n) for n in (b"ticker", b"date") if n in names}
            return
        if len(self.header) < 2:
            return
        at, day = self.header[b"ticker"], self.header[b"date"]
        if self.ticker is None and len(cells) > at:
            self.ticker = cells[at].strip().decode("latin-1").upper()
        if len(cells) > day:
            self.days.add(cells[day].strip())
            if len(self.days) > 4096:
                self.span()

    def span(self) -> None:
        """Takes the days gathered so far into the span."""
        for raw in self.days:
            if len(raw) == 8 and raw.isdigit():
                try:
                    found = dt.datetime.strptime(raw.decode(), "%Y%m%d").date()
                except ValueError:
                    continue
                self.least = min(self.least or found, found)
                self.most = max(self.most or found, found)
        self.days.clear()


def file_facts(chunks: Iterator[bytes]) -> tuple:
    """(sha256, rows without the header, first ticker, first and last date, columns missing) of a file that comes in chunks. Of a
    line longer than a chunk only the beginning is looked at."""
    digest, lines, rest, skipping = hashlib.sha256(), Lines(), b"", False
    for chunk in chunks:
        digest.update(chunk)
        *whole, last = (rest + chunk).split(b"\n") if not skipping else chunk.split(b"\n")
        if skipping and whole:
            whole, skipping = whole[1:], False  # the end of the long line
        for line in whole:
            lines.add(line)
        rest = b"" if skipping else last
        if len(rest) > len(chunk):
            lines.add(rest)
            rest, skipping = b"", True
    if rest:
        lines.add(rest)
    lines.span()
    missing = [n for n in ("ticker", "date") if n.encode() not in (lines.header or {})]
    return digest.hexdigest(), max(lines.count - 1, 0), lines.ticker, lines.least, lines.most, missing


# Fixed values of a listing-status file.
LISTING_COLUMNS = ["symbol", "name", "exchange", "assetType", "ipoDate", "delistingDate", "status"]
LISTING_STATES = ("active", "delisted")


@dataclass
class ListingRequest(InputPartition):
    state: str
    wait: float


class Listing(DataSource):
    """spark.read.format("listing_status").options(url=..., key_env=... or key_file=..., ...).load(): a partition per state.

    url is the address of the service; the request's parameters are function, state, date (option `date`) and apikey. The key is
    read from the environment variable or the file of that name on the machine that sends the request. Further options:
    states (by comma), pause (seconds between the requests' beginnings), tries, backoff (seconds, doubled each time), timeout.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_status"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in [*LISTING_COLUMNS, "query_state"])

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        if "apikey" in urllib.parse.urlsplit(options["url"]).query.lower() or not (options.get("key_env") or options.get("key_file")):
            raise ValueError("name the key by key_env or key_file; it may not stand in the options")
        states = [s.strip().lower() for s in options.get("states", ",".join(LISTING_STATES)).split(",")]
        if wrong := [s for s in states if s not in LISTING_STATES]:
            raise ValueError(f"state must be one of {LISTING_STATES}, not {wrong}")
        self.options, self.states = dict(options), states
        if self.options.get("date"):
            dt.date.fromisoformat(self.options["date"])

    def partitions(self) -> list[ListingRequest]:
        return [ListingRequest(s, i * float(self.options.get("pause", 15))) for i, s in enumerate(self.states)]

    def read(self, partition: ListingRequest) -> Iterator[tuple]:
        time.sleep(partition.wait)
        for row in listing_rows(self._fetched(partition.state)):
            yield *row, partition.state

    def _fetched(self, state: str) -> str:
        o = self.options
        if o.get("key_env"):
            key = os.environ.get(o["key_env"], "")
        else:
            with open(o["key_file"], encoding="utf-8") as file:
                key = file.read().strip()
        if not key:
            raise ValueError("the key that the options name is empty")
        asked = {"function": "LISTING_STATUS", "state": state, **({"date": o["date"]} if o.get("date") else {}), "apikey": key}
        request = urllib.request.Request(f"{o['url']}?{urllib.parse.urlencode(asked)}", headers={"User-Agent": "pitlark-listing"})
        tries, said = int(o.get("tries", 4)), ""
        for k in range(tries):
            if k:
                time.sleep(float(o.get("backoff", 1)) * 2 ** (k - 1))
            try:
                with urllib.request.urlopen(request, timeout=float(o.get("timeout", 60))) as response:
                    return response.read().decode("utf-8-sig")
            except urllib.error.HTTPError as error:
                said = f"HTTP {error.code}"
                if error.code < 500 and error.code != 429:
                    break
            except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
                said = type(getattr(error, "reason", error)).__name__
        # no cause is chained: it would hold the address with the key
        raise RuntimeError(f"the listing of {state} symbols could not be read: {said}") from None


def listing_rows(text: str) -> list[list[str]]:
    """The rows of a listing-status CSV, trimmed, without those that are blank in every column."""
    reader = csv.DictReader(io.StringIO(text))
    if lacks := [c for c in LISTING_COLUMNS if c not in (reader.fieldnames or [])]:
        raise ValueError(f"the listing is no CSV of the kind; columns are missing: {', '.join(lacks)}")
    rows = [[(r.get(c) or "").strip() for c in LISTING_COLUMNS] for r in reader]
    return [r for r in rows if any(r)]


def register(spark: SparkSession) -> SparkSession:
    for source in (ZipMembers, FileFacts, Listing):
        spark.dataSource.register(source)
    return spark
