"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint's 64 bits are cut into 32 segments of two bits; a segment's bit count is a coordinate. The Manhattan
distance of two such vectors is a lower bound of their Hamming distance. Of the two halves of the vector (16
coordinates each), links within 3 bits differ by at most 1 in one half, so the range join runs on a unit grid of each
half: every point stands in its own cell and is replicated to the cells one step up; equal cells meet in an equi-join.
Survivors are verified with the exact number of differing bits. Spark splits hot cells (skew join).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, connected_components, materialize, table

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint; 0 for a null, empty or blank text. bytes.split() and bytes.lower() are ASCII only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), 0
    block: list[int] = []
    for shingle in shingles:
        block.append(digest(shingle, SEED))
        if len(block) == 1 << 16:
            total, count, block = total + _bits(block), count + len(block), []
    if block:
        total, count = total + _bits(block), count + len(block)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big", signed=True)


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (long) of each row of docs(doc_id, text); whole texts, rows kept one to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _half(fp: Column, k: int) -> Column:
    """The 16 two-bit popcounts of a half, packed in 32 bits."""
    half = fp.bitwiseAND(0xFFFFFFFF) if k == 0 else F.shiftrightunsigned(fp, 32)
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(0x55555555)


def _steps(key: Column) -> Column:
    """The key itself and each key with one coordinate raised by one."""
    up = [F.when(key.bitwiseAND(3 << 2 * j) < (2 << 2 * j), key + (1 << 2 * j)) for j in range(16)]
    return F.array_compact(F.array(key, *up))


def near_pairs(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """points(rep, fp) with distinct fp -> links (src, dst) of reps whose fps differ in 1 to max_bits (at most 3) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the half grids are exact up to 3 bits")
    cells = points.select("rep", "fp", F.explode(F.array(*(F.struct(F.lit(k).alias("half"), _half(F.col("fp"), k).alias("cell")) for k in (0, 1)))).alias("at"))
    cells = cells.select("rep", "fp", "at.half", "at.cell")
    reach = cells.select(F.col("rep").alias("rep_a"), F.col("fp").alias("fp_a"), F.col("cell").alias("own"), "half", F.explode(_steps(F.col("cell"))).alias("cell"))
    met = reach.join(cells, ["half", "cell"])
    apart = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp")))
    met = met.where((apart <= max_bits) & ((F.col("own") != F.col("cell")) | (F.col("fp_a") < F.col("fp"))))
    return met.select(F.col("rep_a").alias("src"), F.col("rep").alias("dst")).distinct()


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, fp, component_id (smallest doc_id reachable by links, itself included).

    Equal fingerprints form one point first, so copies never meet pairwise. Null or blank texts have fingerprint 0 and
    link like any other; fewer words than a shingle make one shingle; an empty table gives no rows; repeated rows are
    kept; a null doc_id keeps its row and takes the component of its fingerprint (null if it has no other id).
    """
    prints = materialize(fingerprints(docs, words))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    labels = connected_components(near_pairs(points.where("rep IS NOT NULL"), max_bits))
    classes = points.join(labels, points["rep"] == labels["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


#: The pipeline's stage: words of a shingle, the share of shingles from which texts are one, and words of a passage and its least.
STAGE_WORDS, MIN_SIMILARITY = 5, 0.8
PASSAGE_WORDS, LEAST_WORDS = 24, 12
#: The first search leaves texts of so many different shingles whose fingerprints differ in more bits to the second: of two
#: such texts that share 0.8, some ten bits differ, and more than 28 with a chance below one in ten million.
MANY_SHINGLES, MAX_APART = 64, 28
#: Texts of fewer different shingles have too few passages that an edit leaves alone; they meet by shingles.
SHORT = 128
#: Texts whose shingles are counted, and shingles told as frequent: both only order the shingles.
SAMPLE_TEXTS, FREQUENT = 20_000, 1 << 17
#: Bands of sizes where two texts of the second search meet, to a factor of e.
BANDS = 20


def shingle_set(text: str | None, words: int = STAGE_WORDS) -> set[bytes]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < words:
        return {b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(words)))))


def similarity(a: str | None, b: str | None, words: int = STAGE_WORDS) -> float:
    """Jaccard similarity of the texts' shingles; two wordless texts are alike."""
    x, y = shingle_set(a, words), shingle_set(b, words)
    return len(x & y) / len(x | y) if x or y else 1.0


def passages(text: str | None) -> list[int]:
    """Hashes of the passages that a text's own words cut it into: a passage ends where two words' hash says so, every
    PASSAGE_WORDS on average, so an edit changes the passage it is in and leaves the others. Shorter ones than LEAST_WORDS
    are left out, unless the text has no other."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    codes = np.fromiter(map(zlib.crc32, found), np.uint32, len(found)).astype(np.uint64)
    ends = np.nonzero((codes[:-1] * np.uint64(31) + codes[1:]) % np.uint64(PASSAGE_WORDS) == 0)[0] + 2
    cuts = sorted({0, *ends.tolist(), len(found)})
    out = {_signed(b" ".join(found[i:j])) for i, j in zip(cuts, cuts[1:]) if j - i >= LEAST_WORDS}
    return sorted(out or {_signed(b" ".join(found))})


def _signed(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(data, SEED), "big", signed=True)


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that most texts have, ascending, and how often each was counted: at most FREQUENT of them, counted
    in a sample of at most about SAMPLE_TEXTS of docs(h, text). They only order a text's shingles, the rare ones first: a
    sample that misses some makes the search slower and loses no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_codes((t or "").encode("utf-8", "surrogatepass").lower().split(), words) for t in batch.column(0).to_pylist()]
            if found:
                codes, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(times)], ["code", "times"])

    counted = bounded_sample(docs, "h", SAMPLE_TEXTS).select("text").mapInArrow(run, "code long, times long").groupBy("code").agg(F.sum("times").alias("times"))
    most = counted.where("times > 1").orderBy(F.desc("times"), "code").limit(FREQUENT).toArrow()
    codes, times = most.column(0).to_numpy().view(np.uint64), most.column(1).to_numpy()
    order = np.argsort(codes)
    return codes[order], times[order]


def shingle_codes(found: list[bytes], words: int) -> np.ndarray:
    """Hashes of a text's different shingles, ascending."""
    if not found:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64))


def code_print(codes: np.ndarray) -> int:
    """Fingerprint of a text's different shingles, each counted once."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(codes), 1 << 16):
        total += np.unpackbits(codes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(codes)).tobytes(), "big", signed=True)


def prefix_of(codes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], share: float) -> np.ndarray:
    """The rarest shingles of a text, so many that two texts with `share` of their shingles in common have one of these in
    common. Any order that is the same for all texts will do."""
    known, times = frequent
    rank = np.zeros(len(codes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        rank = np.where(known[at] == codes, times[at], 0)
    return codes[np.lexsort((codes, rank))[: len(codes) - math.ceil(share * len(codes) - 1e-6) + 1]]


def _described(docs: DataFrame, words: int, share: float) -> DataFrame:
    """docs(doc_id, h, text) -> doc_id, h, same (hash of the set of shingles), fp and n (of the different shingles), prefix,
    passages (of texts that are not short)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                codes = shingle_codes((text or "").encode("utf-8", "surrogatepass").lower().split(), words)
                n = len(codes)
                prefix = prefix_of(codes, frequent, share).view(np.int64) if n else []
                rows.append((_signed(codes.tobytes()), code_print(codes), n, prefix, passages(text) if n >= SHORT or not n else []))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds))], ["doc_id", "h", "same", "fp", "n", "prefix", "passages"])

    return docs.mapInArrow(run, "doc_id long, h long, same long, fp long, n long, prefix array<long>, passages array<long>")


def _compared(pairs: DataFrame, points: DataFrame, slim: DataFrame, words: int, share: float) -> DataFrame:
    """pairs(a, b) of points -> those whose texts' similarity is at least share."""
    pairs = materialize(pairs)
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("same")).distinct().join(points.select("same", F.col("rep").alias("doc_id"), "h"), "same"))
    texts = materialize(slim.join(wanted, ["doc_id", "h"]).groupBy("doc_id", "h", "same").agg(F.first("text").alias("text")))
    both = pairs.join(texts.select(F.col("same").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("same").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(x, y, words) >= share for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))


def meetings(points: DataFrame, components: DataFrame, share: float) -> DataFrame:
    """(a, b) of points in different components(node, component) whose first common shingle may be where that of two texts
    with `share` of their shingles in common must be; one row for each key at which they meet.

    All prefixes are in one order, so before its first common shingle a text has only shingles that the other lacks. Sizes
    x <= y need share / (1 + share) * (x + y) common shingles; a text of size n whose first common one is at place p has at
    most n - p, so it takes only partners of size reach = (n - p) * (1 + share) / share - n or less. So a key is of use to the
    smaller text early in its prefix only, and there a group's own shingles, rare as they are beside those that others
    share with it, stand first. Of keys that the same points hold one is enough: the one that comes first in one of them
    does so in all. Sizes are told by bands, and of a cell's largest component no two points meet.
    """
    members = materialize(points.select("same", "n").join(components, F.col("same") == F.col("node"), "left").select("same", "n", F.coalesce("component", "same").alias("component")))
    spots = points.select("same", F.posexplode("prefix").alias("pos", "key"))
    shared = materialize(spots.join(spots.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key", "left_semi").join(members, "same"))
    holders = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("same")).alias("u"), F.bit_xor(F.xxhash64(F.lit("holders"), "same")).alias("v")]
    keys = shared.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.min(F.struct("same", "pos")).alias("at"), *holders).where("p < q")
    keys = keys.groupBy("at.same", "c", "u", "v").agg(F.min_by("key", "at.pos").alias("key")).select("key")
    band = lambda n: F.floor(F.log(n) * BANDS).cast("int")
    reach = (F.col("n") - F.col("pos")) * ((1 + share) / share) - F.col("n") + 1e-6
    found = shared.join(keys, "key", "left_semi").select("key", "same", "n", "component", reach.alias("reach"))
    sizes = F.when(F.col("reach") >= share * F.col("n"), F.sequence(band(share * F.col("n") - 1e-6), band(F.least("n", "reach"))))
    sides = F.concat(F.when(F.col("reach") >= F.col("n"), F.array(F.struct(F.lit(True).alias("small"), band(F.col("n")).alias("band")))).otherwise(F.array()), F.transform(sizes, lambda k: F.struct(F.lit(False).alias("small"), k.alias("band"))))
    found = materialize(found.select("*", F.explode(sides).alias("at")).select("key", "at.band", "at.small", "same", "n", "component", "reach"))
    cells = found.groupBy("key", "band", "component").agg(F.count("*").alias("c"), F.max("small").alias("small"), F.min("small").alias("only"))
    cells = cells.groupBy("key", "band").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts"), F.max("small").alias("some"), F.min("only").alias("all"))
    found = found.join(cells.where("parts > 1 and some and not all").select("key", "band", "main"), ["key", "band"])
    main = F.col("component") == F.col("main")
    small = found.where("small").select("key", "band", F.explode(F.when(main, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("main"), "same", "n", "component", "reach")
    large = found.where("not small").select("key", "band", main.alias("main"), "same", "n", "component", "reach")
    at = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "band", "main")]
    order = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.same") < F.col("y.same"))
    fit = (F.col("y.n") <= F.col("x.reach")) & (F.col("x.n") <= F.col("y.reach")) & (F.col("x.n") >= share * F.col("y.n") - 1e-6)
    met = small.alias("x").join(large.alias("y"), at[0] & at[1] & at[2] & order & fit & (F.col("x.component") != F.col("y.component")))
    return met.select(F.col("x.same").alias("a"), F.col("y.same").alias("b"))


def drop_near_duplicates(docs: DataFrame, words: int = STAGE_WORDS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """docs without all but one document of each group of near-duplicates: the one with the smallest doc_id stays.

    Near-duplicates have at least `min_similarity` of their five-word shingles in common, checked on the texts, or are
    connected by such. A first search finds most groups: the links of the fingerprint range join (3 bits), and each text with
    two others of those that share a passage (short texts: a shingle of their prefixes) with it, that of most copies and that
    of the smallest doc_id, so no group is expanded into pairs. What it leaves apart is searched in full (`meetings`), so
    the groups are those of all pairs. Texts of equal shingles (null and blank ones, too) are one point, whatever their ids:
    of several texts with one doc_id each is judged by itself. Rows without a doc_id stay (nothing can be said of them). Of
    rows that repeat a kept text and its doc_id all stay: they are the same document. Columns of any names and an empty table
    are taken.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = materialize(_described(slim, words, min_similarity))
    points = rows.where("doc_id IS NOT NULL").groupBy("same").agg(F.min(F.struct("doc_id", "h")).alias("at"), *(F.first(c).alias(c) for c in ("fp", "n", "prefix", "passages")), F.count("*").alias("copies"))
    points = materialize(points.select("same", F.col("at.doc_id").alias("rep"), F.col("at.h").alias("h"), "fp", "n", "prefix", "passages", "copies"))
    me = F.struct("same", "fp", "n")
    keys = F.when(F.col("n") * min_similarity < SHORT, F.concat("prefix", "passages")).otherwise(F.col("passages"))
    spots = points.select(F.explode(keys).alias("key"), me.alias("me"), "rep", "copies")
    # what others were copied from has most copies or the smallest id, and is the partner for all of its passages
    common = F.array(F.min_by("me", F.struct(-F.col("copies"), F.xxhash64("me.same"))), F.min_by("me", F.struct("rep", "me.same")))
    hubs = spots.groupBy("key").agg(F.array_distinct(common).alias("hubs"), F.count("*").alias("c")).where("c > 1").select("key", F.explode("hubs").alias("hub"))
    spots = spots.select("key", "me")
    prints = points.groupBy("fp").agg(F.min_by(me, "same").alias("hub"))
    least, most = F.least("me.n", "hub.n"), F.greatest("me.n", "hub.n")
    near = (F.bit_count(F.col("me.fp").bitwiseXOR(F.col("hub.fp"))) <= MAX_APART) | (least < MANY_SHINGLES)
    met = spots.join(hubs, "key").where((F.col("me.same") != F.col("hub.same")) & near & (least >= min_similarity * most)).select(F.col("me.same").alias("a"), F.col("hub.same").alias("b"))
    alike = points.select("fp", "same").join(prints, "fp").where("same <> hub.same").select(F.col("same").alias("a"), F.col("hub.same").alias("b"))
    close = near_pairs(prints.select(F.col("hub.same").alias("rep"), "fp")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = met.unionByName(alike).unionByName(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _compared(pairs, points, slim, words, min_similarity)
    first = materialize(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    named = first.select(F.col("node"), F.col("component").alias("to"))
    more = _compared(meetings(points, first, min_similarity).distinct(), points, slim, words, min_similarity)
    for end in ("a", "b"):
        more = more.join(named, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("to", end)).drop("node", "to")
    joined = connected_components(more.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("was"), F.col("component").alias("now"))
    groups = points.select("same", "rep").join(first, F.col("same") == F.col("node"), "left").select("same", "rep", F.coalesce("component", "same").alias("component"))
    groups = materialize(groups.join(joined, F.col("component") == F.col("was"), "left").select("same", "rep", F.coalesce("now", "component").alias("component")))
    kept = materialize(groups.groupBy("component").agg(F.min("rep").alias("kept")))
    classes = groups.join(kept, "component").select("same", "kept")
    marks = rows.join(classes, "same").where("doc_id <> kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    gone = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_h"))
    return docs.join(marks, gone, "left_anti").select(docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
