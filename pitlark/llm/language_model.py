"""Language-model scores from a weighted backoff automaton.

States are the contexts of 0 to ORDER - 1 words that the training texts hold at least MIN_COUNT times (and the start of a
text). A state has an arc for each word that follows it MIN_COUNT times or more, weighted with the word's smoothed
probability there, and a failure arc to the state without its first word, weighted with the mass that its arcs leave; the
root has an arc for every word. One pass from left to right carries the state: where it has no arc for the next word,
failure arcs are taken until a state has one, and their weights are added up with the arc's. Probabilities are
interpolated with absolute discounts by count (modified Kneser-Ney's), so those of each state sum to 1.

Neither the counts nor the automaton are ever in one place. The corpus is cut into batches of whole documents; every
batch counts locally and asks for totals of just its own keys. Requests travel by ranges of 64-bit key hashes, are summed
there, and each batch gets its totals back in the order asked; with many batches requests of FAN batches are merged on the
way and answers take the same way back, so that the rows sent grow with the batches alone. One such exchange for
the words, one for each longer order and one for the left-over mass give every batch the slice of the automaton that its
own texts can reach. An n-gram is asked for only where its two shorter halves are frequent enough; any other occurs once,
and is counted as such.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remainder, table

HELD_OUT = 10
#: Tokens after which a batch ends (with its document), and keys a shard should hold.
BATCH_TOKENS, SHARD_KEYS = 1_200_000, 1 << 21
#: Words of the longest n-gram; n-grams of two words or more that are seen less often in training are no arcs.
ORDER, MIN_COUNT = 3, 2
#: Discounts are multiples of 1 / PARTS, so that sums of them are whole numbers.
PARTS = 256
#: Ranges that one row of requests is cut into, and batches whose requests are merged, on each step of an exchange.
FAN = 64
END = xxhash.xxh64_intdigest(b"end", 1)


def _pack(a: np.ndarray) -> bytes:
    """Compressed: bytes of like weight stand together."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return zstandard.compress(raw, 1)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    raw, width = zstandard.decompress(blob), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel() if raw else np.empty(0, kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, "<u8"), dtype=np.uint64)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


TOKENS = "batch long, ids binary, null_ids binary, held binary, sizes binary, tokens binary, vocabulary binary, n_words long"


def tokenize(docs: DataFrame, modulus: int = HELD_OUT, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """docs(doc_id, text) -> batches of whole documents: token numbers into the batch's sorted word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        seen, ids, held, parts, size = _Vocabulary(), [], [], [], 0
        seen[None] = 0  # the end token
        for batch in batches:
            for doc_id, text, out in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(None)
                parts.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(out)
                size += len(words)
                if size >= batch_tokens:
                    yield _batch_row(number, seen, ids, held, parts)
                    number, size = number + 1, 0
                    seen, ids, held, parts = _Vocabulary(), [], [], []
                    seen[None] = 0
        if ids:
            yield _batch_row(number, seen, ids, held, parts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (remainder("doc_id", modulus) == 0).alias("held")).mapInArrow(run, TOKENS)


def _batch_row(number: int, seen: dict, ids: list, held: list, parts: list) -> pa.RecordBatch:
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((END if w is None else digest(w) for w in seen), np.uint64, len(seen))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    row = {
        "batch": number,
        "ids": _pack(np.array([i or 0 for i in ids], np.int64)),
        "null_ids": _pack(np.array([i is None for i in ids], np.uint8)),
        "held": _pack(np.array(held, np.uint8)),
        "sizes": _pack(np.array([len(p) for p in parts], np.int64)),
        "tokens": _pack(rank[np.concatenate(parts)]),
        "vocabulary": _pack_sorted(hashes[order]),
        "n_words": len(order),
    }
    return pa.RecordBatch.from_pylist([row])


@dataclass
class Batch:
    ids: np.ndarray
    null_ids: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    vocabulary: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Batch:
        u = _unpack
        return cls(u(row["ids"], "<i8"), u(row["null_ids"], "u1").astype(bool), u(row["held"], "u1").astype(bool), u(row["sizes"], "<i8"), u(row["tokens"], "<i4"), _unpack_sorted(row["vocabulary"]))

    @property
    def learned(self) -> np.ndarray:
        """Per token: is its document one to learn from?"""
        return np.repeat(~self.held, self.sizes)

    def grams(self, known: list[np.ndarray]) -> Iterator[Grams]:
        """The n-grams of one word, of two, ...: up to one word more than there are totals (`known`, by order) for."""
        starts = np.cumsum(self.sizes) - self.sizes
        first = np.zeros(len(self.tokens), bool)
        first[starts] = True
        place = self.tokens.astype(np.int64)
        key = word = self.vocabulary[self.tokens]
        shift = lambda x, fill: np.where(first, fill, np.concatenate([x[:1], x[:-1]]))
        start = np.int64(np.searchsorted(self.vocabulary, np.uint64(END)))
        before = shift(place, start)
        yield Grams(self.vocabulary, place, np.zeros(0, np.int64), 0)
        for n, total in enumerate(known, 2):
            kept = np.concatenate([total >= MIN_COUNT, [False]])  # place -1: no n-gram
            able = kept[place] & kept[before]
            at = np.nonzero(able)[0]
            last = shift(key, np.uint64(END) if n == 2 else np.uint64(0))
            with np.errstate(over="ignore"):
                key = _mix(_mix(last) + word)
            keys, found = np.unique(key[at], return_inverse=True)
            context = np.empty(len(keys), np.int64)
            context[found] = before[at]
            # what has an infrequent half occurs once; contexts that would begin before the text are none
            single = int((~able & self.learned & (before >= 0)).sum()) if n == 2 else int((~able & self.learned & self._long(first, n)).sum())
            place = np.full(len(self.tokens), -1, np.int64)
            place[at] = found
            before = shift(place, -1)
            yield Grams(keys, place, context, single)

    @staticmethod
    def _long(first: np.ndarray, n: int) -> np.ndarray:
        """Tokens with n - 1 words before them in their text, its start counted as one."""
        out = np.ones(len(first), bool)
        for k in range(n - 2):
            out[np.minimum(np.nonzero(first)[0] + k, len(first) - 1)] = False
        return out


@dataclass
class Grams:
    """The distinct n-grams of a batch, in the order of their keys; per token the place of the one that ends there (-1:
    none); per n-gram the place of its context among the shorter ones; occurrences to learn from that are certainly single."""

    keys: np.ndarray
    place: np.ndarray
    context: np.ndarray
    single: int


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


REQUEST = "parent long, range long, batch long, keys binary, values binary, single long"
_REQUEST = pa.schema([("parent", pa.int64()), ("range", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("single", pa.int64())])


def _requests(batch: int, keys: np.ndarray, values: np.ndarray, shift: int, parent: int = 0, single: int = 0) -> pa.Table:
    """Rows of one batch's sorted keys, cut by the FAN values of the bits above `shift`; one row at least."""
    range_ = ((keys >> np.uint64(shift)) & np.uint64(FAN - 1)).astype(np.int64)
    cuts = np.concatenate([[0], np.nonzero(np.diff(range_))[0] + 1, [len(keys)]])
    rows = [
        {"parent": parent, "range": int(range_[i]) if j > i else 0, "batch": batch, "keys": _pack_sorted(keys[i:j]), "values": _pack(values[i:j]), "single": 0 if i else single}
        for i, j in zip(cuts[:-1], cuts[1:]) if j > i or not len(keys)
    ]
    return pa.Table.from_pylist(rows, _REQUEST)


TOTALS = "parent long, range long, batch long, totals binary, n1 long, n2 long, n3 long, n4 long, distinct long, total double"


def _merged(part: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys = [_unpack_sorted(b) for b in part.column("keys").to_pylist()]
    values = np.concatenate([_unpack(b, "<i8") for b in part.column("values").to_pylist()])
    every, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return keys, every, first, inverse, np.bincount(inverse, values.astype(np.float64), len(every)).astype(np.int64)  # exact below 2^53


def exchange(requests: DataFrame, batches: int, steps: int, speaker: bool = True, least: int = 0, depth: int = 1) -> DataFrame:
    """Sums the values of each key over all batches and answers every request in its order.

    With `speaker`: answered as 2 * total + 1 for the batch that speaks for the key (the first) and 2 * total for
    the others; totals below `least` are answered as 0. Without: plain sums. A key comes once per batch, so a
    frequent key is no larger than a rare one that every batch has. With more than one step, the ranges of FAN batches are
    merged, go on as one batch each, cut finer, and what is answered to them is dealt out again.
    """
    names = [x.split()[0] for x in TOTALS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.float64()]

    def table_of(rows: list[list]) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def answer(part: pa.Table) -> pa.Table:
        part = part.sort_by("batch")
        keys, every, first, inverse, sums = _merged(part)
        stats = [int((sums == k).sum()) for k in (1, 2, 3, 4)] + [int((sums > 0).sum()), float(sums.sum())]
        stats[0] += sum(part.column("single").to_pylist())
        found = sums[inverse]
        if speaker:
            found = 2 * np.where(found >= least, found, 0)
            found[first] += 1
        return dealt(part, keys, found, stats)

    def dealt(part: pa.Table, keys: list[np.ndarray], found: np.ndarray, stats: list) -> pa.Table:
        at, rows = 0, []
        for k, row in enumerate(part.select(["parent", "range", "batch"]).to_pylist()):
            rows.append([row["parent"], row["range"], row["batch"], _pack(found[at : at + len(keys[k])]), *(stats if not k else [0] * 6)])
            at += len(keys[k])
        return table_of(rows)

    bits = FAN.bit_length() - 1
    groups = ["parent", "range"]
    if steps == 1:
        return materialize(requests.groupBy(*groups).applyInArrow(answer, TOTALS))

    # a group of batches and a range: merged, it is one batch of the next step, whose ranges lie within this one
    def merge(part: pa.Table) -> pa.Table:
        part = part.sort_by("batch")
        row = part.slice(0, 1).to_pylist()[0]
        _, every, _, _, sums = _merged(part)
        return _requests(row["group"], every, sums, 64 - (depth + 1) * bits, row["parent"] * FAN + row["range"], sum(part.column("single").to_pylist()))

    def spread(part: pa.Table, given: pa.Table) -> pa.Table:
        part = part.sort_by("batch")
        keys, every, first, inverse, _ = _merged(part)
        ordered = given.sort_by("range")
        told = np.concatenate([np.zeros(0, np.int64), *(_unpack(b, "<i8") for b in ordered.column("totals").to_pylist())])
        found = told[inverse]
        if speaker:
            found = found & ~np.int64(1)
            found[first] |= told & 1
        stats = [sum(given.column(n).to_pylist()) for n in names[4:]]
        return dealt(part, keys, found, stats)

    merged = max(1, math.ceil(batches / FAN))
    grouped = requests.withColumn("group", F.pmod(F.xxhash64("batch"), F.lit(merged)))
    inner = exchange(grouped.groupBy("group", *groups).applyInArrow(merge, REQUEST), merged, steps - 1, speaker, least, depth + 1)
    # an inner batch is known by its number (the group) and its parent (this parent and range)
    back = inner.withColumns({"group": F.col("batch"), "upper": F.floor(F.col("parent") / FAN).cast("long"), "middle": F.pmod("parent", F.lit(FAN)).cast("long")})
    met = grouped.groupBy("group", *groups).cogroup(back.groupBy("group", "upper", "middle"))
    return materialize(met.applyInArrow(lambda p, g: spread(p.drop_columns("group"), g.drop_columns(["group", "upper", "middle"])), TOTALS))


def _joined(answers: pa.Table, step: str) -> np.ndarray:
    part = answers.filter(pc.equal(answers.column("step"), step)).sort_by("range")
    return np.concatenate([np.empty(0, np.int64), *(_unpack(b, "<i8") for b in part.column("totals").to_pylist())])


@dataclass
class Automaton:
    """The slice of the model that one batch reaches, by the length n of what is read: 1 at the root, n at a state of n - 1 words.

    arcs[n - 1]: per n-gram the log10 probability of its last word in the state of the others (NaN: no such arc);
    fails[n - 1]: per n-gram, as a state, the log10 weight of its failure arc.
    """

    arcs: list[np.ndarray]
    fails: list[np.ndarray]

    def run(self, places: list[np.ndarray], starts: np.ndarray, start: int) -> np.ndarray:
        """log10 probability of each token of texts that begin at `starts`, read from left to right. places[n - 1]: per token
        its n-gram (-1: none). All tokens are read at once: the state after a token is the longest of its n-grams that has an
        arc and is a state, whatever was carried into it; `start` is the word that stands for a text's start."""
        n_tokens, order = len(places[0]), len(places)
        arc = [a[p] if len(a) else np.full(n_tokens, np.nan) for a, p in zip(self.arcs, places)]
        for a, p in zip(arc, places):
            a[p < 0] = np.nan
        # the state carried into each token: how many words it has, and which
        words = np.zeros(n_tokens, np.int64)
        for n in range(1, order):
            words = np.where(~np.isnan(arc[n - 1]), n, words)
        carried = np.concatenate([[0], words[:-1]])
        carried[starts] = 1
        held = [np.concatenate([[start], p[:-1]]) for p in places]
        held[0][starts] = start
        out = np.zeros(n_tokens)
        reading = np.ones(n_tokens, bool)
        for n in range(order, 0, -1):  # n - 1 words in the state
            at = reading & (carried == n - 1)
            hit = at & ~np.isnan(arc[n - 1])
            out[hit] += arc[n - 1][hit]
            reading &= ~hit
            miss = at & ~hit
            if n > 1:
                out[miss] += self.fails[n - 2][held[n - 2][miss]]
                carried = np.where(miss, n - 2, carried)
        return out


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts 0, 1, 2, 3 and more: modified Kneser-Ney, from the counts of counts 1 to 4, in PARTS of one."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [0.0] + [k - (k + 1) * y * b / a if a and b else 0.75 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.round([min(max(d, 0.05 * k), 0.98 * k) * PARTS for k, d in enumerate(raw)]) / PARTS


def lm_scores(docs: DataFrame, modulus: int = HELD_OUT, order: int = ORDER, batch_tokens: int = BATCH_TOKENS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; whole texts.

    Learns from documents whose crc32(doc_id as text) mod `modulus` is not 0, scores all. Null, empty and blank texts
    are one end token; repeated rows count and are scored each; a null doc_id counts as the empty text's remainder (held
    out); an empty table gives no rows; with nothing to learn from every token has probability 1 / (V + 1) = 1.
    """
    # one shuffle by batch serves the later passes
    spread = tokenize(docs, modulus, batch_tokens).repartition("batch").persist()
    n_batches, n_words = (x or 0 for x in spread.agg(F.count("*"), F.sum("n_words")).first())
    # so many steps that a range of the last one holds about shard_keys keys
    steps = max(1, math.ceil(math.log(max(2.0, 4 * n_words / shard_keys), FAN)))
    shift = 64 - FAN.bit_length() + 1

    def ask_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                b = Batch.of(row)
                yield from _requests(row["batch"], b.vocabulary, np.bincount(b.tokens[b.learned], minlength=len(b.vocabulary)), shift).to_batches()

    totals = exchange(spread.mapInArrow(ask_words, REQUEST), n_batches, steps)
    n, v = (totals.agg(F.sum("total"), F.sum("distinct")).first() or (0, 0))[:2]
    n, v = float(n or 0), int(v or 0)
    answer = lambda found, step: found.select(F.lit(step).alias("step"), "batch", "range", "totals")
    answers = answer(totals, "1")
    cuts = []

    def told(given: pa.Table, k: int) -> list[np.ndarray]:
        return [_joined(given, str(j)) for j in range(1, k + 1)]

    def asking(k: int):
        def ask(rows: pa.Table, given: pa.Table) -> pa.Table:
            row = rows.to_pylist()[0]
            b = Batch.of(row)
            *_, grams = b.grams([x >> 1 for x in told(given, k - 1)])
            use = (grams.place >= 0) & b.learned
            return _requests(row["batch"], grams.keys, np.bincount(grams.place[use], minlength=len(grams.keys)), shift, single=grams.single)

        return ask

    for k in range(2, order + 1):
        totals = exchange(spread.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(asking(k), REQUEST), n_batches, steps, least=MIN_COUNT)
        cuts.append(discounts([int(x or 0) for x in totals.agg(*(F.sum(f"n{j}") for j in (1, 2, 3, 4))).first()]))
        answers = answers.unionByName(answer(totals, str(k)))

    def states(b: Batch, given: pa.Table) -> tuple[list[Grams], list[np.ndarray], list[np.ndarray]]:
        """The n-grams by order, their totals, and which of them this batch speaks for."""
        found = told(given, order)
        return list(b.grams([x >> 1 for x in found[:-1]])), [x >> 1 for x in found], [x & 1 == 1 for x in found]

    def sorted_states(grams: list[Grams], totals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The keys of all states in order, the order, and which n-grams are states."""
        kept = [t >= MIN_COUNT for t in totals[:-1]]
        keys = np.concatenate([g.keys[m] for g, m in zip(grams, kept)])
        by = np.argsort(keys)
        return keys[by], by, kept

    def ask_mass(rows: pa.Table, given: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        grams, totals, mine = states(Batch.of(row), given)
        keys, by, kept = sorted_states(grams, totals)
        used = []
        for k in range(1, order):
            arc = mine[k] & (totals[k] >= MIN_COUNT)
            left = PARTS * (totals[k] - cuts[k - 1][np.minimum(totals[k], 3)])
            used.append(np.bincount(grams[k].context[arc], left[arc], len(totals[k - 1]))[kept[k - 1]])
        return _requests(row["batch"], keys, np.round(np.concatenate(used)[by]).astype(np.int64), shift)

    mass = exchange(spread.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(ask_mass, REQUEST), n_batches, steps, speaker=False)
    answers = answers.unionByName(answer(mass, "mass"))

    def score(rows: pa.Table, given: pa.Table) -> pa.Table:
        b = Batch.of(rows.to_pylist()[0])
        grams, totals, _ = states(b, given)
        keys, by, kept = sorted_states(grams, totals)
        used = np.empty(len(keys))
        used[by] = _joined(given, "mass") / PARTS
        chance = (totals[0] + 0.1) / (n + 0.1 * (v + 1))
        arcs, fails = [np.log10(chance)], []
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(1, order):
                size, states_ = int(kept[k - 1].sum()), kept[k - 1]
                rest = np.ones(len(states_))
                rest[states_] = np.where(totals[k - 1][states_] > 0, 1 - used[:size] / np.maximum(totals[k - 1][states_], 1), 1.0)
                used = used[size:]
                fails.append(np.log10(np.maximum(rest, 1e-12)))
                # the same word after the context without its first word: the n-gram one shorter that ends at the same token
                shorter = np.empty(len(totals[k]), np.int64)
                at = grams[k].place >= 0
                shorter[grams[k].place[at]] = grams[k - 1].place[at]
                context = grams[k].context
                chance = (totals[k] - cuts[k - 1][np.minimum(totals[k], 3)]) / totals[k - 1][context] + rest[context] * chance[shorter]
                arcs.append(np.where(totals[k] >= MIN_COUNT, np.log10(chance), np.nan))
        starts = np.cumsum(b.sizes) - b.sizes
        per_token = Automaton(arcs, fails).run([g.place for g in grams], starts, int(np.searchsorted(b.vocabulary, np.uint64(END))))
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table(
            {
                "doc_id": pa.array(b.ids, pa.int64(), mask=b.null_ids),
                "held_out": pa.array(b.held),
                "n_tokens": pa.array(b.sizes, pa.int64()),
                "n_known": pa.array(add((totals[0][b.tokens] > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(b.ids), int(n)), pa.int64()),
                "base_score": pa.array(add(arcs[0][b.tokens]), pa.float64()),
                "score": pa.array(add(per_token), pa.float64()),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = materialize(spread.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema))
    spread.unpersist()
    return out


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
