"""Repeated passages by a compacted de Bruijn graph of word windows.

A window (50 words of one document) is an edge of the graph. Every window has an anchor, the 12 words in it with the least
hash, so equal windows have equal anchors; consecutive windows with one anchor form a path, a row of the table instead
of a row per window (one for every twenty words or so). What repeats is found on paths:

- Nodes (anchors) that only one document has go. What is left is a small part of the corpus without copies.
- A node with a single path does not branch: its windows stand wherever the path stands. Paths that always follow each
  other (each has one successor, and both stand equally often) compact into one long span, named by its first path.
- At branching nodes the windows of each distinct path are looked at one by one, once a path and not once a copy.

A span or window is told by its source coordinates, the smallest document that has it and the word it begins at. The
source's words are read there, and a document's own words must have their digest before anything is removed. Groups of
copies meet in aggregations with partial sums and in joins that Spark can split; no two documents are paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW, ANCHOR = 50, 12
#: Words that are looked at together; a longer text is looked at alone.
CHUNK_WORDS = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, np.uint64)
    for b in range(bits):  # the second half of 2^(b + 1) powers is the first, times base^(2^b)
        out[1 << b : 2 << b] = out[: 1 << b] * np.uint64(pow(base, 1 << b, 1 << 64))
    return out


class Sequences:
    """Two independent 64-bit hashes of any stretch of words, by prefix sums."""

    def __init__(self, words: list[bytes]):
        coded = pa.array(words, pa.binary()).dictionary_encode()
        digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
        both = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        at, bits = coded.indices.to_numpy(zero_copy_only=False), max(1, len(words).bit_length())
        self.n, self.back = len(words), _powers(_INVERSE, bits)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(both[at, k] * _powers(_BASE, bits)[: len(words)], dtype=np.uint64)]) for k in (0, 1)]

    def of(self, k: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """Hash k of words [start, start + size) for each start."""
        sums = self.sums[k]
        return _mix((sums[starts + size] - sums[starts]) * self.back[starts])


def least_at(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` consecutive values stands (the leftmost of equal ones)."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = values[: len(values) - step], values[step:]
        second = right < left
        values = np.where(second, right, left)
        at = np.where(second, at[step:], at[: len(at) - step])
        size += step
    return at


def paths_of(words: list[bytes], ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """words of several texts one after the other, each text up to ends[i]. Per path: its text, start in it, number of
    windows, anchor's hash, own hash, and the hash of the path that follows in the text (0: none)."""
    starts = np.concatenate([[0], ends[:-1]])
    room = np.maximum(ends - starts - window + 1, 0)
    if not room.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = Sequences(words)
    every = np.arange(len(words) - anchor + 1)
    values = hashes.of(0, every, anchor)
    anchors = least_at(values, window - anchor + 1)
    doc = np.repeat(np.arange(len(ends)), room)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + starts[doc]  # where each window begins
    mine = anchors[first]
    cut = np.concatenate([[0], np.nonzero(np.diff(mine))[0] + 1])
    n = np.diff(np.concatenate([cut, [len(mine)]]))
    doc, first, mine = doc[cut], first[cut], mine[cut]
    path = _mix(hashes.of(1, first, n + window - 1) + n.astype(np.uint64)).view(np.int64)
    following = np.where(np.append(doc[1:] == doc[:-1], False), np.append(path[1:], 0), 0)
    return doc, first - starts[doc], n, values[mine].view(np.int64), path, following


def graph_paths(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs(doc_id, text) -> (node, path, doc_id, start, n, follows): the paths of every text with a doc_id."""

    def emit(ids: list, words: list, ends: list) -> pa.RecordBatch:
        doc, start, n, node, path, follows = paths_of(words, np.array(ends), window, anchor)
        columns = [node, path, np.array(ids, np.int64)[doc], start, n, follows]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "path", "doc_id", "start", "n", "follows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, ends = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = text.as_py().split() if text.is_valid else []
                if len(found) >= window:
                    ids.append(doc_id)
                    words += found
                    ends.append(len(words))
                if len(words) >= CHUNK_WORDS:
                    yield emit(ids, words, ends)
                    ids, words, ends = [], [], []
            if ids:
                yield emit(ids, words, ends)

    there = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("binary"))
    return there.mapInArrow(run, "node long, path long, doc_id long, start long, n long, follows long")


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


#: What is read at source coordinates: of a span (j = -1) the digest of its words, of a path its windows' hashes.
SOURCES = "node long, path long, source long, last long, n long, j long, w1 long, w2 long, digest binary"


def read_sources(asked: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """asked(source, node, path, last, start, own, n, whole) -> SOURCES, from the words of the source documents."""
    wanted = asked.groupBy("source").agg(F.collect_list(F.struct("node", "path", "last", "start", "own", "n", "whole")).alias("wanted"))
    met = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(wanted, F.col("doc_id") == F.col("source")).select("source", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*((x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in SOURCES.split(", ")))
        for batch in batches:
            for i in range(batch.num_rows):
                words, source = (batch.column(1)[i].as_py() or b"").split(), batch.column(0)[i].as_py()
                want, hashes, parts = batch.column(2)[i].as_py(), Sequences(words), []
                # of several texts with this id, the one that has the path there
                want = [w for w in want if w["start"] + w["own"] + window - 1 <= len(words)]
                if not want:
                    continue
                start, own = (np.array([w[k] for w in want]) for k in ("start", "own"))
                path = _mix(hashes.of(1, start, own + window - 1) + own.astype(np.uint64)).view(np.int64)
                for w, found in zip(want, path.tolist()):
                    if found != w["path"]:
                        continue
                    a, n = w["start"], w["n"]
                    if w["whole"]:
                        if a + n + window - 1 <= len(words):
                            parts.append((np.array([-1]), np.zeros(1, np.int64), np.zeros(1, np.int64), w, _digest(words[a : a + n + window - 1])))
                    else:
                        at = np.arange(a, a + n)
                        parts.append((np.arange(n), *(hashes.of(k, at, window).view(np.int64) for k in (0, 1)), w, None))
                if not parts:
                    continue
                sizes = [len(p[0]) for p in parts]
                same = lambda k: np.repeat(np.array([p[3][k] for p in parts], np.int64), sizes)
                digest = pa.array([p[4] for p in parts for _ in p[0]], pa.binary())
                columns = [same("node"), same("path"), np.full(sum(sizes), source), same("last"), same("n"), *(np.concatenate([p[k] for p in parts]) for k in range(3))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), digest], list(names))

    return met.mapInArrow(run, SOURCES)


def spans_of(paths: DataFrame) -> DataFrame:
    """Distinct paths that do not branch, compacted: (source, start, node, path, own, n, last) of each longest span, `own` being
    the windows of its first path. A source's paths follow each other in it, so a span is a stretch of the source."""
    along = Window.partitionBy("source").orderBy("start", "node", "path")  # paths of one document
    before = lambda c: F.lag(c).over(along)
    linked = (before("least_follows") == F.col("path")) & (before("most_follows") == F.col("path")) & (before("copies") == F.col("copies")) & (before(F.col("start") + F.col("n")) == F.col("start"))
    chained = paths.withColumn("chain", F.sum(F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).over(along))
    head = lambda c: F.min_by(c, "start").alias("own" if c == "n" else c)
    return chained.groupBy("source", "chain").agg(F.min("start").alias("start"), head("node"), head("path"), head("n"), F.sum("n").alias("total"), F.max("last").alias("last")).select("source", "start", "node", "path", "own", F.col("total").alias("n"), "last")


def repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, spots): what of each document stands in one with a smaller id: structs of start, n (windows),
    path, mask (the windows, 0: all of them) and digest (of the words of all of them, where mask is 0)."""
    rows = materialize(graph_paths(docs, window, anchor))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("path").alias("p"), F.max("path").alias("q"))
    nodes = materialize(nodes.where("a < b").select("node", (F.col("p") != F.col("q")).alias("branching")))
    some = materialize(rows.join(nodes, "node"))
    paths = some.groupBy("node", "path", "branching").agg(
        F.min(F.struct("doc_id", "start")).alias("at"), F.max("doc_id").alias("last"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("follows").alias("least_follows"), F.max("follows").alias("most_follows"),
    )
    paths = materialize(paths.select("*", F.col("at.doc_id").alias("source"), F.col("at.start").alias("start")).drop("at"))
    spans = spans_of(paths.where(~F.col("branching"))).withColumn("whole", F.lit(True))
    mixed = paths.where("branching").select("source", "start", "node", "path", F.col("n").alias("own"), "n", "last", F.lit(False).alias("whole"))
    told = materialize(read_sources(spans.unionByName(mixed), docs, window))
    each = told.where("j >= 0")
    firsts = materialize(each.groupBy("w1", "w2").agg(F.min("source").alias("first"), F.count("*").alias("c"), F.max("last").alias("latest")).where("first < latest").drop("c", "latest"))
    windows = each.join(firsts, ["w1", "w2"]).where("first < last").groupBy("node", "path").agg(F.first("n").alias("n"), F.collect_list(F.struct("j", "first")).alias("windows"))
    whole = told.where("j < 0").select("node", "path", "n", "source", "digest", F.lit(None).cast("array<struct<j:long,first:long>>").alias("windows"))
    plan = materialize(whole.unionByName(windows.select("node", "path", "n", F.lit(None).cast("long").alias("source"), F.lit(None).cast("binary").alias("digest"), "windows")))
    later = F.filter("windows", lambda w: w["first"] < F.col("doc_id"))
    mask = F.aggregate(later, F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), w["j"].cast("int"))))
    hits = some.select("node", "path", "doc_id", "start").join(plan, ["node", "path"]).withColumn("mask", F.coalesce(mask, F.lit(0).cast("long")))
    hits = hits.where(F.coalesce(F.col("doc_id") > F.col("source"), F.lit(False)) | (F.col("mask") != 0))
    return hits.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "path", "mask", "digest")).alias("spots"))


def removed_words(words: list[bytes], spots: list[dict], window: int) -> np.ndarray:
    """Which words go; spots that another text of the same doc_id has are told by their hashes and left out."""
    n = len(words)
    edge = np.zeros(n + 1, np.int64)
    spots = [s for s in spots if s["start"] + s["n"] + window - 1 <= n]
    if spots:
        hashes = Sequences(words)
        start, size = (np.array([s[k] for s in spots]) for k in ("start", "n"))
        path = _mix(hashes.of(1, start, size + window - 1) + size.astype(np.uint64)).view(np.int64).tolist()
        for s, found in zip(spots, path):
            a, b = s["start"], s["start"] + s["n"] + window - 1
            if s["mask"] and found == s["path"]:
                at = [a + j for j in range(s["n"]) if s["mask"] >> j & 1]
                np.add.at(edge, at, 1)
                np.add.at(edge, [i + window for i in at], -1)
            elif not s["mask"] and _digest(words[a:b]) == s["digest"]:
                edge[a] += 1
                edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


def drop_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_removed, kept (the words left, joined by one space), a row per row.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of `window` words that covers it also begins in a
    document with a smaller doc_id; windows are judged on the input. Null, empty and short texts have no window and
    stay. Rows with one doc_id are one document with several texts: none is removed for the other's sake, each is judged
    by itself. Rows without a doc_id are left as they are and are no one's source. Whole texts of any length; an empty
    table gives no rows.
    """
    if not 1 <= anchor <= window <= anchor + 62:
        raise ValueError("a path's windows must fit in the bits of a long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeated_passages(slim, window, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some, out = batch.slice(lo, 256), []
                for i in range(some.num_rows):
                    words, spots = (some.column(1)[i].as_py() or b"").split(), some.column(2)[i].as_py()
                    gone = removed_words(words, spots, window) if spots else np.zeros(len(words), bool)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                    out.append((len(words), int(gone.sum()), b" ".join(kept)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept"])

    met = slim.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.col("text").cast("binary"), "spots")
    out = met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.decode("kept", "UTF-8"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def sql_substring_dedup() -> str:
    """Plain SQL: every window of every document by its words; no anchors, paths or spans."""
    return f"""
WITH split AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS MATERIALIZED (SELECT row, doc_id, i, md5(array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ')) AS h FROM (SELECT row, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS MATERIALIZED (SELECT DISTINCT row, unnest(range(i, i + {WINDOW})) AS place FROM windows JOIN firsts USING (h) WHERE first < doc_id),
counted AS (SELECT row, list(place) AS places FROM gone GROUP BY row),
kept AS (SELECT k.row, string_agg(word, ' ' ORDER BY place) AS text FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split) k LEFT JOIN gone USING (row, place) WHERE gone.row IS NULL GROUP BY k.row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM split LEFT JOIN counted USING (row) LEFT JOIN kept USING (row)"""
