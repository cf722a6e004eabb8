"""Periodic runs of words by a suffix automaton with ordered end-position sets.

A run is a stretch of words that repeats with its smallest period at least `min_exponent` times over, and that no
neighbouring word extends. Every state of the suffix automaton of the words is a set of substrings that end at the same
places. Going from long states to short ones, each state's ordered set of end positions is merged into its suffix link's,
the smaller into the larger. Two positions that become neighbours in a state of length l, at a distance d of at most l,
are a square: the l words before either are the same, so the stretch up to the second has period d. Of the squares of a run
exactly one cannot be moved on by a word on either side, and it is the run. With a state at least twice as long as the
distance no position in between can hide a run, so none is missed.

A run of `min_length` words holds short sequences of words that come again within a third of the text. Only the stretches
that are made of such sequences get an automaton; a run lies in one of them as a whole. They are found for many texts at
once, by sorted hashes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .substrings import Sequences

MIN_LENGTH, MIN_EXPONENT = 24, 3
CHUNK_WORDS = 1 << 18


class SuffixAutomaton:
    """States by number, 0 being the root: the length of the longest substring and the suffix link; own[i] is the state of the
    prefix that ends at word i."""

    def __init__(self, word_codes: list[int]):
        length, link, after = [0], [-1], [{}]
        own: list[int] = []
        last = 0
        for c in word_codes:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            after.append({})
            own.append(new)
            p = last
            while p >= 0 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p >= 0:
                q = after[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    after.append(after[q].copy())
                    link[q] = link[new] = clone
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = clone
                        p = link[p]
            last = new
        self.length, self.link, self.own = length, link, own


def runs_of(codes: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text of word codes, by start, then period."""
    least = -(-min_length * (min_exponent - 1) // min_exponent)  # a run's state has its length less its period
    n = len(codes)
    if n < min_length:
        return []
    automaton = SuffixAutomaton(codes)
    length, link = automaton.length, automaton.link
    # positions are kept negative, so that a prefix, which comes before what its state has so far, is appended
    places: dict[int, list[int]] = {s: [-i] for i, s in enumerate(automaton.own) if length[s] >= least}
    found = set()

    def square(i: int, j: int, size: int) -> None:
        d, start = j - i, i - size + 1
        if d <= size and size + d >= max(min_length, min_exponent * d):
            if (start == 0 or codes[start - 1] != codes[start - 1 + d]) and (j + 1 == n or codes[j + 1] != codes[j + 1 - d]):
                found.add((start, size + d, d))

    fresh: dict[int, list[int]] = {}
    for state in sorted((s for s in range(1, len(length)) if length[s] >= least), key=length.__getitem__, reverse=True):
        mine, parent, size = places.pop(state), link[state], length[state]
        for x in fresh.pop(state, ()):  # the set is complete now, so neighbours have nothing in between
            at = bisect_left(mine, x)
            if at:  # a place further on in the text
                square(-x, -mine[at - 1], size)
            if at + 1 < len(mine):
                square(-mine[at + 1], -x, size)
        if length[parent] < least:
            continue
        theirs = places.get(parent)
        if theirs is None:
            places[parent] = mine
            continue
        if len(mine) > len(theirs):
            mine, theirs = theirs, mine
            places[parent] = theirs
        for x in mine:
            theirs.insert(bisect_left(theirs, x), x)
        fresh.setdefault(parent, []).extend(mine)
    return sorted(found, key=lambda r: (r[0], r[2]))


def hopeful_stretches(words: list[bytes], ends: np.ndarray, least: int, exponent: int) -> list[list[tuple[int, int]]]:
    """Per text (words of several, each up to ends[i]) the stretches, from and to, of words that lie in a sequence of `least`
    words which comes again in the text within its length over `exponent`."""
    starts = np.concatenate([[0], ends[:-1]])
    out: list[list[tuple[int, int]]] = [[] for _ in ends]
    room = np.maximum(ends - starts - least + 1, 0)
    if not room.sum():
        return out
    doc = np.repeat(np.arange(len(ends)), room)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + starts[doc]
    keys = Sequences(words).of(0, first, least) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys, kind="stable")
    a, b = order[:-1], order[1:]
    again = (keys[a] == keys[b]) & (doc[a] == doc[b]) & ((b - a) * exponent <= (ends - starts)[doc[a]])
    marked = np.unique(np.concatenate([first[a[again]], first[b[again]]]))
    if len(marked):
        text = np.searchsorted(ends, marked, "right")
        cut = np.nonzero((np.diff(marked) > least) | (np.diff(text) > 0))[0]  # the next sequence begins beyond the end of this one
        lo, hi = marked[np.concatenate([[0], cut + 1])], marked[np.concatenate([cut, [len(marked) - 1]])] + least
        for i, x, y in zip(text[np.concatenate([[0], cut + 1])].tolist(), lo.tolist(), hi.tolist()):
            out[i].append((x, y))
    return out


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


#: What the operator gives for a document; start to exponent_milli are of the run with the greatest length / period.
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed; a row per row.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0. A run has its smallest period, at least `min_length` words
    and `min_exponent` periods, and cannot be extended. The one with the greatest exact length / period is given apart (of equal
    ones the smallest start, then period; four nulls without a run). `collapsed` is the text without the words that any run
    contains after its first period, joined by one space. Null, empty and blank texts have no words. Repeated rows and ids
    are answered each, null ids too; an empty table gives no rows. `edit` changes a document's words before they are
    looked at. Memory grows with the longest text; no text meets another.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two words and two periods")
    least = -(-min_length * (min_exponent - 1) // min_exponent)
    names = "doc_id n_runs start length period exponent_milli runs collapsed".split()
    run_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
    types = [pa.int64()] * 6 + [run_type, pa.binary()]

    def emit(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        stretches, out = hopeful_stretches([w for t in texts for w in t], ends, least, min_exponent), []
        for doc_id, words, end, mine in zip(ids, texts, ends.tolist(), stretches):
            before, runs, code = end - len(words), [], {}
            for lo, hi in mine:
                codes = [code.setdefault(w, len(code)) for w in words[lo - before : hi - before]]
                runs += [(lo - before + a, n, q) for a, n, q in runs_of(codes, min_length, min_exponent)]
            best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            kept = words if not runs else [w for w, k in zip(words, collapsed(len(words), runs).tolist()) if k]
            facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            out.append((doc_id, len(runs), *facts, [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(kept)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()
                words = edit(doc_id, words) if edit else words
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
                if size >= CHUNK_WORDS:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield emit(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, RUNS)


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document made periodic from some word on, by a hash of the id (a null id: of the empty text)."""
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=looped)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    said = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.encode(said, "UTF-8"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def sql_periodic_runs() -> str:
    """Plain SQL: stretches of words that equal the word q before them, for every q; no automaton and no hashes of sequences."""
    return f"""
WITH bytewise AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), b) ORDER BY b) AS t FROM range(256) AS r(b)),
split AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
hashed AS (SELECT row, doc_id, words, len(words) AS n, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM split, bytewise),
drawn AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, h // 10 AS g FROM hashed),
texts AS MATERIALIZED (SELECT row, doc_id, n, list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) AS words FROM drawn),
placed AS MATERIALIZED (SELECT row, n, unnest(range(n)) AS i, unnest(words) AS w FROM texts),
same AS (SELECT x.row, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.row = y.row AND x.w = y.w AND x.i < y.i AND (y.i - x.i) * {MIN_EXPONENT} <= x.n),
islands AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM same) GROUP BY row, q, island HAVING count(*) + q >= greatest({MIN_LENGTH}, {MIN_EXPONENT} * q)),
runs AS MATERIALIZED (SELECT row, start, length, q AS period FROM islands s WHERE NOT EXISTS (SELECT 1 FROM islands p WHERE p.row = s.row AND p.q < s.q AND p.start <= s.start AND p.start + p.length >= s.start + s.length)),
said AS (SELECT row, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY row),
best AS (SELECT a.* FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.row = a.row AND (b.length * a.period > a.length * b.period OR (b.length * a.period = a.length * b.period AND (b.start, b.period) < (a.start, a.period))))),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS text FROM placed LEFT JOIN gone USING (row, i) WHERE gone.row IS NULL GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN said USING (row) LEFT JOIN best USING (row) LEFT JOIN kept USING (row)"""
