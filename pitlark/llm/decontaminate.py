"""Benchmark decontamination: latent semantic retrieval of TF-IDF passages, then word-order and answer checks.

Words are hashed to TERMS columns. The corpus' passages (PASSAGE words of one text) are the rows of a TF-IDF matrix with
squared idf and unit rows; a distributed randomised SVD (range finder with one power step, one pass) gives its leading
right singular directions. Texts are cut into overlapping windows of lengths that step with the items' own; a window is a candidate
for an item where the cosine of their images in that space reaches MIN_COSINE. Terms whose own images nearly agree (they
stand in the same passages all over the corpus, as synonyms do) count as one word from there on: a candidate stays if the
longest common subsequence of item and passage, equal or so related words matching, holds SURE_COMMON of the item, or
MIN_COMMON of it with MIN_ANSWER of its answer.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import summed
from .common import materialize, table

#: Columns of the matrix, its passages' words, and the directions kept.
TERMS, PASSAGE, RANK = 1 << 16, 64, 48
MIN_COSINE = 0.65
MIN_COMMON, SURE_COMMON, MIN_ANSWER = 0.6, 0.8, 0.8
#: Cosine of two terms' images from which they count as one word, and the passages each must stand in.
MIN_RELATED, MIN_SEEN = 0.8, 8
#: Window lengths: an item is compared at the shortest that holds it, a longer one in overlapping pieces of the longest.
WINDOWS = (12, 16, 20, 24, 28, 32, 40, 48, 56, 64)
GRAIN = 4
#: Words around a window that its order check reads too: windows start at every first or second grain.
SLACK = 2 * GRAIN
#: Items shorter than this have no passage of their own; they must appear word for word.
SHORT_ITEM = 8
#: Items that one pass holds in each task; a larger benchmark takes several passes of the search, but one SVD.
BLOCK_ITEMS = 5_000
#: Words, and pairs, of one array operation; they bound its memory and change no result.
WORDS_AT_ONCE, WINDOWS_AT_ONCE, PAIRS_AT_ONCE = 60_000, 2_048, 20_000
#: Tasks a core that sum over the corpus, and terms of one row of their sums.
TASKS_A_CORE, BLOCK_TERMS = 4, 256
#: Terms are told apart by so many numbers when an item's words are counted in a window, and when their order is looked at.
KINDS, HASHED = 256, 1_024
_TABLE = bytes(32 if (c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128) else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def numbers_of(words: list[bytes]) -> np.ndarray:
    """32-bit numbers of words; a table of those seen before is slower than the checksum."""
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def common_words(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a sequence of `length` words and `words`, by bit rows: masks gives the
    places of the sequence that a word matches (one integer addition per word)."""
    full = (1 << length) - 1
    row = full
    for w in words:
        hit = row & masks.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def common_bounds(tables: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The same of many pairs at once: tables[rows[i]] gives the places of at most 64 that a word of words[i] matches."""
    flat, base = tables.ravel(), rows * tables.shape[1]
    left = np.full(len(rows), ~np.uint64(0))
    for column in np.ascontiguousarray(words.T):
        hit = left & flat.take(base + column)
        left = (left + hit) | (left ^ hit)
    return np.bitwise_count(~left).astype(np.int64)


def masks_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def answer_of(text: str) -> str:
    """What follows the last question mark, else the last sentence."""
    tail = text.rpartition("?")[2].strip()
    if "?" in text and tail:
        return tail
    parts = [s for s in re.split(r"(?<=[.!])\s+", text.strip()) if words_of(s)]
    return parts[-1] if parts else text


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray

    @classmethod
    def of(cls, item_id: int, text: str) -> Item:
        words, answer = numbers_of(words_of(text)), numbers_of(words_of(answer_of(text)))
        return cls(item_id, words, answer if len(answer) else words)


def _pieces(words: np.ndarray) -> list[np.ndarray]:
    """The item, or overlapping pieces of one longer than the longest window."""
    w = WINDOWS[-1]
    if len(words) <= w:
        return [words]
    return [words[s : s + w] for s in [*range(0, len(words) - w, w // 2), len(words) - w]]


TOKENS = "doc_id long, words binary"


def tokenized(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, words (32-bit numbers); the texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            found = [numbers_of(words_of(t)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(term of each word, its passage) of stretches of a task's texts."""
    for batch in batches:
        parts, size = [], 0
        for words in batch.column("words"):
            parts.append(np.frombuffer(words.as_buffer(), "<u4") % TERMS)
            size += len(parts[-1])
            if size >= 4 * WORDS_AT_ONCE:
                yield _passages(parts)
                parts, size = [], 0
        if size:
            yield _passages(parts)


def _passages(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(parts).astype(np.int64), np.cumsum(at % PASSAGE == 0) - 1


def _few_tasks(tokens: DataFrame) -> DataFrame:
    """The words in a few tasks a core: each task's sums have the matrix' width, however few rows it reads."""
    return tokens.select("words").coalesce(TASKS_A_CORE * tokens.sparkSession.sparkContext.defaultParallelism)


def passage_counts(tokens: DataFrame) -> tuple[int, np.ndarray]:
    """Number of corpus passages, and of those with each term; summed over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TERMS + 1, np.int64)
        for term, passage in _stretches(batches):
            counts[-1] += passage[-1] + 1
            cells = np.sort(passage * TERMS + term)
            counts[:-1] += np.bincount(cells[np.diff(cells, prepend=-1) > 0] % TERMS, minlength=TERMS)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([counts.astype(float).tobytes()])], ["key", "data"])

    found = summed(_few_tasks(tokens).mapInArrow(run, "key long, data binary")).get(0, np.zeros(TERMS + 1))
    return int(found[-1]), found[:-1].astype(np.int64)


def term_weights(n: int, counts: np.ndarray) -> np.ndarray:
    return np.log((n + 1) / np.maximum(counts, 1)) ** 2


def image_shares(tokens: DataFrame, weight: np.ndarray, rank: int) -> DataFrame:
    """block, share: each task's share of A^T (A G), by blocks of terms. A's entry is its term's weight over its passage's norm, so
    weights are multiplied in before and after, not at each word. A stretch's words are summed passage by passage, then,
    sorted once, term by term."""
    shared = tokens.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        g = (np.random.default_rng(7).standard_normal((rank, TERMS)) * weight).astype(np.float32)
        total = np.zeros((rank, TERMS))
        for term, passage in _stretches(batches):
            first = np.flatnonzero(np.diff(passage, prepend=-1))
            squared = np.maximum(np.add.reduceat(weight[term] ** 2, first), 1e-18)
            order = np.argsort(term.astype(np.uint16), kind="stable")
            at, places = np.flatnonzero(np.diff(term[order], prepend=-1)), passage[order]
            terms, x = term[order[at]], np.empty(len(term), np.float32)
            for j in range(rank):
                y = (np.add.reduceat(g[j].take(term, out=x, mode="clip"), first) / squared).astype(np.float32)
                total[j, terms] += np.add.reduceat(y.take(places, out=x, mode="clip"), at)
        share = (total * weight).T.astype(np.float32)
        for b in range(0, TERMS, BLOCK_TERMS):
            if share[b : b + BLOCK_TERMS].any():
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([share[b : b + BLOCK_TERMS].tobytes()])], ["block", "share"])

    return _few_tasks(tokens).mapInArrow(run, "block long, share binary")


def latent_space(tokens: DataFrame, weight: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """What a word adds to a passage's image (TERMS x rank), its weight times the leading right singular directions V of the
    corpus passages; and the terms' own unit images, V times the singular values.

    z = A^T (A G) for a Gaussian G, one pass over all passages; a few tasks a core add up their shares, and the shares are
    dealt by blocks of terms and added as they stream in, so no task holds more than its blocks' sums. z is
    about V S^2 W for singular values S.
    """
    block, kind = BLOCK_TERMS, "block long, share binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[b] = sums.get(b, 0.0) + np.frombuffer(found.as_buffer(), np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.float32).tobytes() for v in sums.values()])], ["block", "share"])

    shares = image_shares(tokens, weight, rank).repartition("block").mapInArrow(add, kind)
    z = np.zeros((TERMS, rank))
    for r in shares.collect():  # TERMS x rank numbers
        z[r["block"] : r["block"] + block] = np.frombuffer(r["share"], np.float32).reshape(-1, rank)
    # left singular vectors and values of z, from the rank x rank products
    squared, right = np.linalg.eigh(z.T @ z)
    s = np.sqrt(np.maximum(squared, 0))
    kept = s > 1e-3 * max(s[-1], 1e-30)
    v = z @ np.where(kept, right / np.where(kept, s, 1), 0)
    return (v * weight[:, None]).astype(np.float32), _unit(v * np.sqrt(s)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


class Retrieval:
    """The items' side of a search, held by each task: the terms' images, the items' images and words, and `one`: the term
    that a term counts as, itself or the item's term that it is related to."""

    def __init__(self, items: list[Item], images: np.ndarray, terms: np.ndarray, counts: np.ndarray, min_cosine: float = MIN_COSINE):
        self.items, self.min_cosine = items, min_cosine
        self.images = np.vstack([images, np.zeros((1, images.shape[1]), np.float32)])  # TERMS: no word
        self.short: dict[int, list[int]] = {}
        pieces = []
        for k, item in enumerate(items):
            if len(item.words) < SHORT_ITEM:
                self.short.setdefault(int(item.words[0]), []).append(k)
            else:
                pieces += [(k, p % TERMS) for p in _pieces(item.words)]
        self.one = self._related(np.unique(np.concatenate([i.words for i in items]) % TERMS), terms, counts)
        self.masks = [(masks_of(self.one[i.words % TERMS]), masks_of(self.one[i.answer % TERMS])) for i in items]
        self.at, self.places = {}, {}
        for low, w in zip((0, *WINDOWS), WINDOWS):
            found = [(k, p) for k, p in pieces if low < len(p) <= w]
            if found:
                image = _unit(np.stack([images[p].sum(0) for _, p in found]))
                bits = np.zeros((len(found), KINDS), bool)
                for row, (_, p) in zip(bits, found):
                    row[self.one[p] % KINDS] = True
                lengths = np.array([len(p) for _, p in found])
                # so many of the bits a window must share: a bit stands for one place, or for all that its item has too many
                least = np.ceil(MIN_COMMON * lengths).astype(int) - (lengths - bits.sum(1))
                self.at[w] = (np.array([k for k, _ in found]), lengths, [masks_of(self.one[p]) for _, p in found], image, _packed(bits), least)
                self.places[w] = tables = np.zeros((len(found), HASHED + 1), np.uint64)
                for row, (_, p) in zip(tables, found):
                    np.bitwise_or.at(row, self.one[p] % HASHED, np.uint64(1) << np.arange(len(p), dtype=np.uint64))

    @staticmethod
    def _related(terms: np.ndarray, unit: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A term stands for itself, or for the item's term whose image is nearest if that is near enough; both stand in
        MIN_SEEN passages at least. Of related items' terms the first stands for the others."""
        one = np.arange(TERMS + 1)
        known = np.nonzero(counts >= MIN_SEEN)[0]
        terms = terms[counts[terms] >= MIN_SEEN]
        best = np.full(TERMS, MIN_RELATED, np.float32)
        heads: dict[int, int] = {}
        for lo in range(0, len(terms), 64):  # 64 x TERMS numbers at once
            some = terms[lo : lo + 64]
            cosine = unit[some] @ unit[known].T
            for i, j in zip(*np.nonzero(cosine >= MIN_RELATED)):
                a, b = int(some[i]), int(known[j])
                if a != b and cosine[i, j] >= best[b] and (b not in heads or a < b):
                    best[b], heads[b] = cosine[i, j], a
        mine = set(terms.tolist())
        for b, a in heads.items():
            if b not in mine or a < b:
                while a in heads and heads[a] < a and a in mine:
                    a = heads[a]
                one[b] = a
        return one

    def candidates(self, parts: list[tuple[int, int, np.ndarray]], ordered: bool = False) -> Iterator[tuple]:
        """parts: (text, first word's place, words), stretches of texts. -> (text, item, (window length, piece of its class),
        cosine, window's first word) of the windows whose cosine reaches the bound and that hold enough of the item's words for
        the order check: a bound on the common subsequence, hashed terms counted, never too few. If `ordered`, of items of one piece
        only those that hold enough of hashed terms in order, a closer bound: where most terms count as few, nearly all windows
        hold an item's."""
        gap = WINDOWS[-1] // GRAIN  # grains without words after each stretch, so that windows end with it
        grains = [-(-len(w) // GRAIN) + gap for _, _, w in parts]
        first = np.cumsum([0, *grains])
        words = np.full(2 * SLACK + first[-1] * GRAIN, TERMS, np.int64)
        for (_, _, w), f in zip(parts, first):
            words[SLACK + f * GRAIN : SLACK + f * GRAIN + len(w)] = w % TERMS
        one = words[SLACK : SLACK + first[-1] * GRAIN].reshape(-1, GRAIN).T
        sums = {1: self.images.take(one[0], 0)}
        for column in one[1:]:
            sums[1] += self.images.take(column, 0)
        for k in (2, 4, 8, 16):
            sums[k] = sums[k // 2][: -(k // 2)] + sums[k // 2][k // 2 :]
        inside = np.concatenate([np.arange(n) < n - gap for n in grains])
        part = np.repeat(np.arange(len(parts)), grains)
        one = self.one[words]
        hashed = np.where(words < TERMS, one % HASHED, HASHED)
        kinds = np.where(words < TERMS, one % KINDS, KINDS)
        for w, (owners, lengths, _, image, bits, least) in self.at.items():
            pieces = np.array([len(self.items[k].words) > w for k in owners])
            wide, x, at = w // GRAIN, None, 0
            n, step = len(part) - wide, 1 if w < 28 else 2
            for k in (16, 8, 4, 2, 1):  # a window is the sum of windows of 1, 2, 4, ... grains
                if wide & k:
                    more = sums[k][at : at + n : step]
                    x, at = more if x is None else x + more, at + k
            need = self.min_cosine * np.sqrt(np.einsum("ij,ij->i", x, x)) + 1e-6
            need[~inside[:n:step]] = np.inf
            reach = np.arange(w + 2 * SLACK)
            for lo in range(0, len(x), WINDOWS_AT_ONCE):
                dot = x[lo : lo + WINDOWS_AT_ONCE] @ image.T
                row, piece = np.divmod(np.flatnonzero(dot >= need[lo : lo + WINDOWS_AT_ONCE, None]), len(owners))
                if not len(row):
                    continue
                windows, row_ = np.unique(row, return_inverse=True)
                start = (windows + lo) * step
                near = (start * GRAIN)[:, None] + reach
                held = np.zeros((len(windows), KINDS + 1), bool)
                held.ravel()[np.arange(0, held.size, KINDS + 1)[:, None] + kinds[near]] = True
                held = _packed(held[:, :KINDS])
                for k in range(0, len(row), PAIRS_AT_ONCE):
                    a, p = row_[k : k + PAIRS_AT_ONCE], piece[k : k + PAIRS_AT_ONCE]
                    count = np.bitwise_count(held[a] & bits[p]).sum(1, dtype=np.int64)
                    enough = np.nonzero(count >= least[p])[0]
                    if ordered and len(enough):
                        common = common_bounds(self.places[w], p[enough], hashed[near[a[enough]]]) / lengths[p[enough]]
                        enough = enough[(common >= MIN_COMMON) | pieces[p[enough]]]
                    for i in enough:
                        s, j = start[a[i]], int(p[i])
                        q = part[s]
                        cosine = dot[row[k + i], j] * self.min_cosine / need[row[k + i] + lo]
                        yield parts[q][0], int(owners[j]), (w, j), float(min(cosine, 1.0)), int(parts[q][1] + (s - first[q]) * GRAIN)

    def verified(self, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple]:
        """(text's place, item's place) -> cosine, common share, answer share, first word; the best passage of each."""
        found: dict[tuple[int, int], tuple] = {}

        def note(d: int, k: int, cosine: float, common: float, answer: float, at: int) -> None:
            old = found.get((d, k))
            if old is None or (common, cosine, -at) > (old[1], old[0], -old[3]):
                found[d, k] = (cosine, common, answer, at)

        if self.short:
            heads = np.array(sorted(self.short), np.uint32)
            for d, words in enumerate(texts):
                for at in np.nonzero(np.isin(words, heads))[0].tolist():
                    for k in self.short[int(words[at])]:
                        mine = self.items[k].words
                        if np.array_equal(words[at : at + len(mine)], mine):
                            note(d, k, 1.0, 1.0, 1.0, at)
        for stretch in self._stretched(texts):
            for d, k, (w, p), cosine, start in self.candidates(stretch, ordered=True):
                item, (whole, answers) = self.items[k], self.masks[k]
                size = len(item.words)
                lo, hi = max(0, start - SLACK), start + w + SLACK
                region = self.one[texts[d][lo:hi] % TERMS].tolist()
                sure = 0.0
                if size > w:  # a piece: the piece alone, or the whole item around it
                    piece = int(self.at[w][1][p])
                    sure = common_words(self.at[w][2][p], piece, region) / piece
                    region = self.one[texts[d][max(0, lo - size) : hi + size] % TERMS].tolist()
                common = max(sure if sure >= SURE_COMMON else 0.0, common_words(whole, size, region) / size)
                if common < MIN_COMMON:
                    continue
                answer = common_words(answers, len(item.answer), region) / len(item.answer)
                if common >= SURE_COMMON or answer >= MIN_ANSWER:
                    note(d, k, cosine, common, answer, lo)
        return found

    @staticmethod
    def _stretched(texts: list[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Texts in lists of bounded size; a long one in stretches that overlap by the longest window and the words around it."""
        out, size, wide, over = [], 0, WORDS_AT_ONCE, WINDOWS[-1] + 2 * SLACK
        for d, words in enumerate(texts):
            for at in range(0, max(1, len(words) - over), wide - over):
                part = words[at : at + wide]
                if len(part):
                    out.append((d, at, part))
                    size += len(part)
                if size >= wide:
                    yield out
                    out, size = [], 0
        if out:
            yield out


LEAKS = "doc_id long, item_id long, cosine double, common_share double, answer_share double, first_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE, rank: int = RANK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> one row per row of docs and leaked item.

    A leak: at least SURE_COMMON of the item's words (or of a piece of WINDOWS[-1] words of a longer item) stand in order in
    a passage of the document, or MIN_COMMON of them with MIN_ANSWER of its answer, related terms counting as equal; the
    passage was retrieved by its cosine in the latent space. Items of fewer than SHORT_ITEM words must stand word for word. Items with null, empty or
    wordless text match nothing; null or empty documents have no leaks; repeated rows of documents give repeated rows,
    repeated items one row each; empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = -(-items.count() // block_items)
    out = spark.createDataFrame([], LEAKS)
    if not blocks:
        return out
    tokens = materialize(tokenized(docs))
    n, counts = passage_counts(tokens)
    images, terms = latent_space(tokens, term_weights(n, counts), rank)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        known = [Item.of(r["item_id"], r["text"]) for r in part.toLocalIterator() if words_of(r["text"])]
        if known:
            found = search(tokens, Retrieval(known, images, terms, counts, min_cosine))
            out = found if blocks == 1 else out.unionByName(found)
    return out


def search(tokens: DataFrame, finder: Retrieval) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast(finder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared.value
        gc.disable()  # many small objects and no cycles
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            found = finder.verified([np.frombuffer(w.as_buffer(), "<u4") for w in batch.column("words")])
            if found:
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], finder.items[k].item_id, *v) for (d, k), v in sorted(found.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c) if i > 1 else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows))], [x.split()[0] for x in LEAKS.split(", ")])
        gc.enable()

    return tokens.mapInArrow(run, LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a leak; rows with a null doc_id are judged by nothing and stay."""
    leaked = materialize(find_leaks(docs, benchmark).select("doc_id").where("doc_id IS NOT NULL").distinct())  # of known size: few are broadcast
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).withColumns({c: F.round(c, 6) for c in ("cosine", "common_share", "answer_share")})
