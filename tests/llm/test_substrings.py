"""Substring dedup against brute force over all windows, and against SQL."""

import tracemalloc

import duckdb
import numpy as np
import pytest

from pitlark.llm import substrings

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, node string, path string, spots string"


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y", None) for r in rows], COLUMNS)
    return sorted((tuple(r) for r in substrings.drop_repeats(df, **how).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


@pytest.mark.parametrize(("window", "anchor", "vocabulary"), [(50, 12, 4000), (8, 3, 6), (5, 5, 3), (6, 1, 2)])
def test_against_brute_force(spark, window, anchor, vocabulary):
    """Shared passages in unlike texts, edited and exact copies, and (small vocabularies) texts that repeat within themselves."""
    rng = np.random.default_rng(window)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, vocabulary, n)]
    passages = [draw(window + int(rng.integers(0, 2 * window))) for _ in range(4)]
    rows = []
    for i in range(60):
        text = draw(int(rng.integers(0, 4 * window)))
        for p in rng.integers(0, 4, int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = passages[p][int(rng.integers(0, 3)) :]
        rows.append((int(i * 7 % 60), "\t ".join(text)))
    for k in range(40):  # copies, some with a word changed
        text = (rows[k % 5][1] or "").split()
        if k % 2 and text:
            text[int(rng.integers(0, len(text)))] = "edit"
        rows.append((100 + k, " ".join(text)))
    rows += [(200, None), (201, ""), (202, " \n "), (None, rows[0][1]), (203, rows[0][1]), (203, rows[1][1]), (203, rows[0][1]), (3, rows[2][1]), (204, "é" * 30 + " " + rows[1][1])]
    assert found(spark, rows, window=window, anchor=anchor) == brute(rows, window)


def test_empty_table_and_long_text(spark):
    assert found(spark, []) == []
    text = " ".join(f"w{k}" for k in range(600_000))
    got = found(spark, [(1, text), (2, "start " + text + " end")])
    assert got == [(1, 600_000, 0, text), (2, 600_002, 600_000, "start end")]


def test_paths_cover_every_window_once():
    rng = np.random.default_rng(2)
    texts = [[b"%d" % k for k in rng.integers(0, 9, n)] for n in (0, 49, 50, 51, 400)]
    ends = np.cumsum([len(t) for t in texts])
    doc, start, n, *_ = substrings.paths_of([w for t in texts for w in t], ends, 50, 12)
    covered = sorted((d, s + j) for d, s, m in zip(doc.tolist(), start.tolist(), n.tolist()) for j in range(m))
    assert covered == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)]


def test_agrees_with_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine = substrings.op13_substring_dedup(spark, SF)
    want = db.execute(substrings.sql_substring_dedup())
    assert [d[0] for d in want.description] == mine.columns
    assert sorted(want.fetchall()) == sorted(map(tuple, mine.collect()))


def test_words_looked_at_together_take_little_memory():
    """A task's arrays over one chunk of words stay below 64 MB, as several tasks share an executor's memory."""
    words = [b"w%d" % (k * 7919 % 30011) for k in range(substrings.CHUNK_WORDS)]
    ends = np.arange(256, len(words) + 1, 256)
    substrings._powers.cache_clear()
    tracemalloc.start()
    substrings.paths_of(words, ends, substrings.WINDOW, substrings.ANCHOR)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
