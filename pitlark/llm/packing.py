"""Best-fit-decreasing packing of tokenized documents, with a segment tree over remaining capacities.

Packing is global: the driver packs the histogram of lengths (one row per length), not the documents. Pieces of one
length are alike, so best fit fills them in runs: a run is a range of numbers among the pieces of its length and a range of
bins. A piece's number is its task's first number of that length (a running sum over tasks) plus its place in the task.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SEQUENCE = 1024
END_ID = 2
#: Distinct pre-tokens a worker remembers.
MEMO = 1_000_000
#: Documents tokenized at once.
STEP = 500
SPECIAL = "<|endoftext|>"


class BestFit:
    """Bins of `size`; add() puts an item in the open bin with the least room that holds it, or in a new one.

    The leaves of the segment tree are the remaining capacities 0..size; an inner node counts the ranges of open bins
    below it. Each range costs one descent and two updates, O(log size), however many bins are open.
    """

    def __init__(self, size: int):
        self.size, self.bins = size, 0
        self.width = 1 << size.bit_length()
        self.tree = [0] * (2 * self.width)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _count(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.tree[i] += by
            i >>= 1

    def _tightest(self, need: int) -> int | None:
        i = need + self.width
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None

    def _open(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.at[room].append((first, bins))
            self._count(room, 1)

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1..size."""
        return self.add_many(length, 1)[0][:2]

    def add_many(self, length: int, count: int) -> list[tuple[int, int, int, int]]:
        """Runs (first bin, offset, items a bin, items) of `count` items of one length, as if each was added in turn.

        A bin that took an item is the tightest as long as it holds another one, so bins of one room fill one by one.
        """
        runs = []
        while count:
            room = self._tightest(length)
            each = (room or self.size) // length
            bins = -(-count // each)
            if room is None:
                first, room = self.bins, self.size
                self.bins += bins
            else:
                first, there = self.at[room].pop()
                self._count(room, -1)
                bins = min(bins, there)
                self._open(room, first + bins, there - bins)
            items = min(count, bins * each)
            full, rest = divmod(items, each)
            self._open(room - each * length, first, full)
            if rest:
                self._open(room - rest * length, first + full, 1)
            runs.append((first, self.size - room, each, items))
            count -= items
        return runs


def packed_runs(counts: dict[int, int], size: int = SEQUENCE) -> tuple[int, dict[int, np.ndarray]]:
    """Pieces by length -> bins, and each length's runs: columns first number, first bin, offset, items a bin."""
    fit, out = BestFit(size), {}
    for length in sorted(counts, reverse=True):
        runs = np.array(fit.add_many(length, counts[length]), np.int64)
        out[length] = np.column_stack([np.cumsum(runs[:, 3]) - runs[:, 3], runs[:, :3]])
    return fit.bins, out


def pieces_of(length: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: the first one takes what does not fill a sequence."""
    first = length % size or min(length, size)
    return [(0, first), *((s, size) for s in range(first, length, size))]


#: The vocabulary's pre-token pattern in the faster `re` dialect: the same for texts without the characters of ODD, whose
#: class (digit, letter, space) the two dialects see differently.
FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    wide = regex.compile(r"[\p{No}\p{Nl}\x1c-\x1f\x85]").search
    narrow = re.compile(r"[\x1c-\x1f]").search
    odd = lambda t: (narrow if t.isascii() else wide)(t)
    return Tokenizer.from_file(public_tokenizers.path(name)), regex.compile(public_tokenizers.PATTERN), odd, {}


def token_bytes(texts: list[str | None], name: str) -> list[bytes]:
    """Each text's token ids as little-endian uint32, ending with END_ID.

    A byte-level BPE never merges across pre-tokens, so ids are remembered by pre-token; new ones go through the
    tokenizer. A text with the special token's string goes through it whole.
    """
    tok, exact, odd, memo = _tokenizer(name)
    end = END_ID.to_bytes(4, "little")
    texts = [t or "" for t in texts]
    parts = [[] if SPECIAL in t else (exact if odd(t) else FAST).findall(t) for t in texts]
    every = set().union(*parts)
    fresh = list(every.difference(memo))
    if fresh and len(memo) + len(fresh) > MEMO:
        memo.clear()
        fresh = list(every)
    for p, e in zip(fresh, tok.encode_batch_fast(fresh, add_special_tokens=False)):
        memo[p] = array("I", e.ids).tobytes()
    whole = lambda t: array("I", tok.encode(t, add_special_tokens=False).ids).tobytes()
    return [(whole(t) if SPECIAL in t else b"".join(map(memo.__getitem__, p))) + end for t, p in zip(texts, parts)]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = SEQUENCE, payload: Column | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, piece, start, length, ids (binary, little-endian uint32), sequence_id, offset.

    The pieces, or of their ids only `payload` (a named column over `ids`), are written once to the shared folder; they
    are not shuffled while the tasks' counts by length are small enough to broadcast. All are packed together, best fit
    decreasing: the number of sequences does not depend on partitions or order. Only documents longer than `size` are
    cut. A null or empty text is a document of one token (its end); repeated rows are packed each; an empty table gives
    no rows; a null doc_id stays null. sequence_id numbers the sequences from 0.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        gc.disable()  # millions of small lists and no cycles
        for part in (b.slice(lo, STEP) for b in batches for lo in range(0, b.num_rows, STEP)):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), token_bytes(part.column(1).to_pylist(), tokenizer)):
                for k, (s, n) in enumerate(pieces_of(len(ids) // 4, size)):
                    rows.append((doc_id, k, s, n, ids[4 * s : 4 * (s + n)], task, seen[n]))
                    seen[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids", "task", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        gc.enable()

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, task int, place long")
    pieces = materialize(pieces.select("doc_id", "piece", "start", "length", F.col("ids") if payload is None else payload, "task", "place"))
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = spark.sparkContext.broadcast(packed_runs(total, size)[1])
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(firsts, ["task", "length"]).select(*pieces.columns[:5], (F.col("first") + F.col("place")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.nonzero(np.diff(length[order]))[0] + 1):
                if len(at):
                    n = int(length[at[0]])
                    mine = runs.value[n]
                    first, bin_, start, each = mine[np.searchsorted(mine[:, 0], number[at], "right") - 1].T
                    sequence[at] = bin_ + (number[at] - first) // each
                    offset[at] = start + (number[at] - first) % each * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema[:5])
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), payload=F.crc32("ids").alias("ids_crc32"))
