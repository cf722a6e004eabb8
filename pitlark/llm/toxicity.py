"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters: words of a fixed lexicon, patterns, and words and word beginnings mined from labelled rows as near-certain
signs; each votes toxic or abstains, and one more votes clean where all abstain. The label model gives each voter a
rate of firing on either class and a share of its evidence that correlated voters do not already give. EM over the vote
patterns of all documents to learn from estimates rates, correlations and the class balance: patterns are counted and kept
in Spark, and each round's tasks add up the expected votes and pairs of votes of either class. A logistic regression on
hashed text then learns the posterior labels of a bounded sample, and scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import summed
from .common import bounded_repeats, bounded_sample, materialize, remainder, table

HELD_OUT = 5
#: The score of every document where no label can be learnt from.
UNLABELLED = 0.1
#: Labelled rows to fit on, at most about so many: toxic and clean.
SAMPLE_ROWS = (3_000, 5_000)
BUCKETS = 1 << 18
#: Mined voters at most, and the hashed features the classifier looks at.
MINED, SELECTED = 80, 4096
#: Insults of common use.
LEXICON = ["asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
PATTERNS = {
    "insulted": rb"\byou(?: are|'re)? (?:an? |such an? |so )?(?:" + "|".join(LEXICON).encode() + rb")\b",
    "masked": rb"\b[a-z]+[*@$]{2,}[a-z]+\b",
    "threat": rb"\b(?:kill|hurt|destroy) (?:you|yourself|them all)\b",
}
_TABLE = bytes(32 if (c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128) else c for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def keys_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings of three to eight bytes (marked with *)."""
    return [word, *(word[:n] + b"*" for n in (3, 4, 5, 6, 7, 8) if len(word) > n)]


def mine(texts: list[set[bytes]], labels: list[int], most: int = MINED) -> list[bytes]:
    """Words and beginnings that near-certainly mean toxic, each new one covering toxic texts that few before it do."""
    toxic, clean = Counter(), Counter()
    where: dict[bytes, set[int]] = {}
    bad = [i for i, y in enumerate(labels) if y]
    for i in bad:
        for k in {k for w in texts[i] for k in keys_of(w)}:
            toxic[k] += 1
            where.setdefault(k, set()).add(i)
    for i, y in enumerate(labels):
        if not y:
            clean.update(k for k in {k for w in texts[i] for k in keys_of(w)} if k in toxic)
    n1, n0 = max(1, len(bad)), max(1, len(labels) - len(bad))
    sure = {k: c for k, c in toxic.items() if c >= max(3, 0.004 * n1) and (c / n1) > 40 * (clean[k] + 0.25) / n0 and clean[k] <= 0.02 * c}
    covered, out = Counter(), []
    # each pick: the key that covers most toxic texts seen less than three times so far
    while sure and len(out) < most:
        gain = {k: sum(covered[i] < 3 for i in where[k]) for k in sure}
        best = max(gain, key=lambda k: (gain[k], not k.endswith(b"*"), len(k), k))
        if gain[best] < max(2, 0.002 * n1):
            break
        out.append(best)
        covered.update(where[best])
        del sure[best]
    return out


class Voters:
    """votes(text): the numbers of the voters that say toxic."""

    def __init__(self, mined: list[bytes]):
        self.names = [w.encode() for w in LEXICON] + [m for m in mined if m.decode("utf-8", "replace") not in LEXICON] + [f"<{p}>".encode() for p in PATTERNS]
        self.of = {k: i for i, k in enumerate(self.names)}
        self.patterns = [(self.of[f"<{p}>".encode()], re.compile(r)) for p, r in PATTERNS.items()]
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def votes(self, text: str | None, words: set[bytes]) -> frozenset[int]:
        memo, of, out = self.memo, self.of, set()
        if len(memo) > 300_000:
            memo.clear()
        for w in words:
            hit = memo.get(w)
            if hit is None:
                memo[w] = hit = tuple(of[k] for k in keys_of(w) if k in of)
            out.update(hit)
        low = (text or "").lower().encode("utf-8", "surrogatepass")
        if out or b"*" in low or b"kill" in low or b"hurt" in low or b"destroy" in low:
            out.update(i for i, p in self.patterns if p.search(low))
        return frozenset(out)


@dataclass
class LabelModel:
    """rates[y, j]: probability that voter j fires on class y; share[j]: how much of its evidence is its own;
    silence[y]: probability that none fires. Abstaining is no evidence (toxic texts are of many kinds), unless all do."""

    rates: np.ndarray
    share: np.ndarray
    balance: float
    silence: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        # the strongest vote counts whole, others by the share of their evidence that is their own
        each = votes * np.log(self.rates[1] / self.rates[0])
        top = each.max(1)
        z = np.log(self.balance / (1 - self.balance)) + each @ self.share + top * (1 - self.share[each.argmax(1)])
        z = z + (votes.sum(1) == 0) * np.log(self.silence[1] / self.silence[0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def expected(votes: np.ndarray, counts: np.ndarray, model: LabelModel) -> np.ndarray:
    """What a round needs of some vote patterns (rows of 0/1 with their document counts), flat: per class the documents, those
    without a vote, the votes, and the pairs of votes."""
    post = model.posterior(votes)
    quiet = votes.sum(1) == 0
    out = []
    for w in (counts * (1 - post), counts * post):
        out += [[w.sum(), w[quiet].sum()], w @ votes, ((votes * w[:, None]).T @ votes).ravel()]
    return np.concatenate(out)


def refitted(sums: np.ndarray, voters: int) -> LabelModel:
    """The label model of expected sums.

    Correlation of two voters: how much more often they agree within a class than independent ones would (the larger
    of the two classes' correlations). A voter's evidence is divided by one plus its correlations with the others.
    """
    m = voters
    clean, toxic = sums[: len(sums) // 2], sums[len(sums) // 2 :]
    n0, n1 = clean[0], toxic[0]
    prior = np.clip((clean[2 : 2 + m] + toxic[2 : 2 + m]) / max(n0 + n1, 1), 1e-6, 0.5)
    r1 = (toxic[2 : 2 + m] + 2 * np.maximum(prior, 0.01)) / (n1 + 2)
    r0 = (clean[2 : 2 + m] + 0.5 * np.minimum(prior, 0.001)) / (n0 + 0.5)
    # voters only ever argue for toxic: a voter cannot fire more on clean text
    r1 = np.clip(np.maximum(r1, 1.5 * r0), 1e-7, 0.995)
    own = np.zeros((m, m))
    for part, n in ((toxic, n1), (clean, n0)):
        mean, pairs = part[2 : 2 + m] / max(n, 1e-9), part[2 + m :].reshape(m, m) / max(n, 1e-9)
        sd = np.sqrt(np.maximum(mean - mean**2, 1e-9))
        own = np.maximum(own, np.where(np.minimum.outer(mean, mean) * n > 5, (pairs - np.outer(mean, mean)) / np.outer(sd, sd), 0))
    np.fill_diagonal(own, 0)
    share = 1 / (1 + np.where(own > 0.3, own, 0).sum(1))
    balance = float(np.clip(n1 / max(n0 + n1, 1e-9), 0.002, 0.6))
    silence = np.array([(part[1] + a) / (part[0] + 1) for part, a in ((clean, 0.9), (toxic, 0.1))])
    return LabelModel(np.stack([np.clip(r0, 1e-8, 0.99), r1]), share, balance, silence)


def fit_label_model(patterns: DataFrame, start: LabelModel, rounds: int = 30) -> LabelModel:
    """EM over all vote patterns, patterns(votes: numbers joined by commas, n). No pattern is left out and none leaves Spark."""
    voters, model = start.rates.shape[1], start
    for _ in range(rounds):

        def add(batches: Iterator[pa.RecordBatch], model: LabelModel = model) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in (b.slice(lo, 5_000) for b in batches for lo in range(0, b.num_rows, 5_000)):
                votes = np.zeros((batch.num_rows, voters))
                for i, v in enumerate(batch.column(0).to_pylist()):
                    votes[i, [int(x) for x in v.split(",") if x]] = 1
                total = total + expected(votes, batch.column(1).to_numpy().astype(float), model)
            if not isinstance(total, float):
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()])], ["key", "data"])

        sums = summed(patterns.select("votes", "n").mapInArrow(add, "key long, data binary"))
        if not sums:
            return model
        before, model = model, refitted(sums[0], voters)
        if np.abs(np.log(model.rates / before.rates)).max() < 1e-3 and np.abs(model.share - before.share).max() < 1e-3:
            break
    return model


@dataclass
class Classifier:
    weights: dict[int, float]
    bias: float


def buckets_of(word: bytes, buckets: int = BUCKETS) -> list[int]:
    return [zlib.crc32(k) % buckets for k in keys_of(word)]


def fit_classifier(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, ridge: float = 2e-5, rounds: int = 600) -> Classifier:
    """Logistic regression on presence of hashed keys, with soft targets and row weights; the SELECTED buckets that differ most between
    the classes take part. rows: each document's sorted distinct buckets."""
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, t in zip(rows, target):
        pos[r] += t
        neg[r] += 1 - t
    n1, n0 = max(target.sum(), 1e-9), max((1 - target).sum(), 1e-9)
    p1, p0 = max(weight @ target, 1e-9), max(weight @ (1 - target), 1e-9)
    gap = np.abs(pos / n1 - neg / n0) / np.sqrt((pos + neg + 2) / (n1 + n0))
    gap[(pos + neg) < 3] = 0
    chosen = np.sort(np.argsort(-gap, kind="stable")[:SELECTED])
    chosen = chosen[gap[chosen] > 0]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    hits = [place[r][place[r] >= 0] for r in rows]
    flat = np.concatenate(hits) if hits else np.empty(0, int)
    doc = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    d = len(chosen)
    p = np.zeros(d + 1)
    p[d] = np.log(p1 / p0)
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(doc, p[flat], len(rows)) + p[d]
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight / max(weight.sum(), 1e-9)
        grad = np.append(np.bincount(flat, e[doc], d) + ridge * p[:d], e.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Classifier({int(b): float(w) for b, w in zip(chosen, p) if abs(w) > 1e-3}, float(p[d]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: tuple[int, int] = SAMPLE_ROWS) -> Classifier:
    """docs(doc_id, text), labels(doc_id, toxic) of the documents to learn from; without any, every score is UNLABELLED."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = bounded_sample(known.where("toxic > 0"), "doc_id", sample_rows[0]).unionByName(bounded_sample(known.where("toxic <= 0"), "doc_id", sample_rows[1]))
    there = {r["bad"]: r["count"] for r in known.groupBy((F.col("toxic") > 0).alias("bad")).count().collect()}
    # a doc_id that repeats brings its first few rows only, so the bound on labelled rows holds for documents
    sample = bounded_repeats(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b" ".join(sorted(words_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(1), batch.column(2)], ["doc_id", "words", "text", "toxic"])

    rows = sorted(((r["doc_id"], r["words"], r["text"], r["toxic"]) for r in sample.mapInArrow(cut, "doc_id long, words binary, text string, toxic int").toLocalIterator()), key=lambda r: (r[0], r[1]))
    if not rows:  # nothing to learn from
        return Classifier({}, float(np.log(UNLABELLED / (1 - UNLABELLED))))
    one: dict[bytes, bytes] = {}
    texts = [{one.setdefault(w, w) for w in bytes(r[1]).split()} for r in rows]
    truth = np.array([min(1, max(0, r[3])) for r in rows], float)
    voters = Voters(mine(texts, truth.astype(int).tolist()))
    # every document to learn from votes; patterns are few, and are counted before they travel
    names = voters.names
    mined = [k for k in names[len(LEXICON) :] if not k.startswith(b"<")]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine_ = Voters(mined)
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen[",".join(map(str, sorted(mine_.votes(t, words_of(t)))))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    patterns = materialize(docs.select("text").mapInArrow(vote, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")))
    sample_votes = np.zeros((len(rows), len(names)))
    for i, (r, w) in enumerate(zip(rows, texts)):
        sample_votes[i, list(voters.votes(r[2], w))] = 1
    n1, n0 = max(1.0, truth.sum()), max(1.0, (1 - truth).sum())
    weight = np.where(truth > 0, there.get(True, 0) / n1, there.get(False, 0) / n0)
    base = float(np.clip(there.get(True, 0) / max(1, sum(there.values())), 0.005, 0.5))
    start = LabelModel(np.stack([((1 - truth) @ sample_votes + 0.05) / (n0 + 5), (truth @ sample_votes + 0.5) / (n1 + 5)]), np.ones(len(names)), base, np.array([0.9, 0.1]))
    model = fit_label_model(patterns, start)
    target = model.posterior(sample_votes)
    buckets = [np.unique(np.array([b for w in ws for b in buckets_of(w)], np.int64)) for ws in texts]
    return fit_classifier(buckets, target, weight)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, score (0 to 1; null and empty texts get the bias alone); rows one to one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value.weights, shared.value.bias
        memo: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                hit: set[int] = set()
                for w in words_of(t):
                    b = memo.get(w)
                    if b is None:
                        if len(memo) > 400_000:
                            memo.clear()
                        memo[w] = b = tuple(x for x in buckets_of(w) if x in weights)
                    if b:
                        hit.update(b)
                out.append(bias + sum(weights[b] for b in sorted(hit)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -40, 40))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = HELD_OUT, sample_rows: tuple[int, int] = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, toxic, ...) -> doc_id, held_out, score, predicted.

    Learns from rows whose crc32(doc_id as text) mod `modulus` is not 0. A null doc_id is held out. Repeated rows are
    scored each; several labels of a document count as the highest; an empty table gives no rows; without a labelled
    document to learn from, every score is UNLABELLED.
    """
    learn = remainder("doc_id", modulus) != 0
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(learn), labels.select("doc_id", "toxic").where(learn), sample_rows)
    out = score(docs, model)
    return out.select("doc_id", (remainder("doc_id", modulus) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
