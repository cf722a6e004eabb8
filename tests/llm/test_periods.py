"""Periodic runs against brute force over all periods, and against SQL."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest

from pitlark.llm import periods

SF = "/root/testdata/sf0.001"


def brute(codes, min_length, min_exponent):
    n, out = len(codes), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and codes[j] == codes[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                out.append((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(((a, m, q) for a, m, q in out if not any(p < q and b <= a and b + k >= a + m for b, k, p in out)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (6, 3), (2, 2), (9, 4)])
def test_runs_against_brute_force(min_length, min_exponent):
    rng = np.random.default_rng(min_length)
    for k in range(400):
        n, size = int(rng.integers(0, 120)), int(rng.integers(1, 5))
        codes = rng.integers(0, size, n).tolist()
        for _ in range(int(rng.integers(0, 3))):  # a part again and again, at times inside another
            if n > 4:
                a = int(rng.integers(0, n - 2))
                p = int(rng.integers(1, max(2, (n - a) // 2)))
                b = int(rng.integers(a + p, n))
                codes[a:b] = [codes[a + (i - a) % p] for i in range(a, b)]
        assert periods.runs_of(codes, min_length, min_exponent) == brute(codes, min_length, min_exponent), codes
        # and the stretches that get an automaton hold every run as a whole
        least = -(-min_length * (min_exponent - 1) // min_exponent)
        (stretches,) = periods.hopeful_stretches([b"%d" % c for c in codes], np.array([n]), least, min_exponent)
        assert all(any(lo <= a and a + m <= hi for lo, hi in stretches) for a, m, _ in brute(codes, min_length, min_exponent))


def test_operator_on_texts(spark):
    rng = np.random.default_rng(1)
    loop = [f"w{k}" for k in rng.integers(0, 50, 9)]
    rows = [(1, "\n".join(["a", "b"] + loop * 4 + loop[:3] + ["c"])), (2, "same " * 40_000), (3, None), (4, ""), (5, " \t"), (None, "x y " * 12), (1, "x y " * 11 + "x"), (6, "p q r s " * 5 + "p q r s"), (7, " ".join(loop * 5 + ["z"] + ["k"] * 30))]
    rows += [(10 + k, " ".join(f"w{x}" for x in rng.integers(0, 3, 300))) for k in range(20)]
    schema = "doc_id long, text string, runs string, start string, collapsed string"
    out = periods.periodic_runs(spark.createDataFrame([(*r, "x", "y", None) for r in rows], schema)).collect()
    assert len(out) == len(rows)
    for (i, text), got in zip(sorted(rows, key=str), sorted(out, key=lambda r: str((r["doc_id"], next(t for d, t in rows if d == r["doc_id"]))))):
        if sum(d == i for d, _ in rows) > 1 or i == 2:
            continue
        words = (text or "").split()
        runs = brute(words, 24, 3)
        assert [tuple(r) for r in got["runs"]] == runs and got["n_runs"] == len(runs)
        gone = {k for a, m, q in runs for k in range(a + q, a + m)}
        assert bytes(got["collapsed"]).decode() == " ".join(w for k, w in enumerate(words) if k not in gone)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        assert (got["start"], got["length"], got["period"], got["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    by = {r["doc_id"]: r for r in out}
    assert (by[2]["n_runs"], by[2]["length"], by[2]["period"], bytes(by[2]["collapsed"])) == (1, 40_000, 1, b"same")
    assert sorted(r["length"] or 0 for r in out if r["doc_id"] == 1) == [0, 39] and by[None]["period"] == 2 and by[7]["period"] == 1
    assert periods.periodic_runs(spark.createDataFrame([], schema)).count() == 0


def test_texts_side_by_side_do_not_touch():
    words = [b"a"] * 20 + [b"a"] * 20
    assert periods.hopeful_stretches(words, np.array([20, 40]), 16, 3) == [[(0, 20)], [(20, 40)]]


def test_agrees_with_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine = periods.op12_periodic_runs(spark, SF)
    want = db.execute(periods.sql_periodic_runs())
    assert [d[0] for d in want.description] == mine.columns
    rows = sorted(map(tuple, mine.collect()))
    assert sorted(want.fetchall()) == rows and sum(r[1] for r in rows) > 5
