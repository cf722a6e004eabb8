"""Vector codes against SQL, against a plain Python version, and on odd vectors."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from pitlark.llm import codes

SF = "/root/testdata/sf0.01"


def plain(rows, parts, entries, rounds):
    """Rows of (vec_id, label, vector) in lists of Python integers; slow and short."""
    good = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = -(-max(len(v) for _, _, v in good) // parts)
    ints = [[int(math.floor(x * 1024)) if abs(x) < 1e300 else int(x) * 1024 for x in v] + [0] * (parts * width - len(v)) for _, _, v in good]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, good[i][2]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    at = near()
    errors = [sum(far(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, at)]
    total = lambda label: sum(e for e, g in zip(errors, good) if g[1] == label)
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    top = lambda x: min(x, 2**63 - 1)
    return sorted(((g[0], "".join(f"{x:02x}" for x in a), top(e), top(total(g[1])), sha) for g, a, e in zip(good, at, errors)), key=str)


def found(spark, rows, **how):
    df = codes.vector_codes(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>, code string, data string"), **how)
    return sorted((tuple(r) for r in df.drop("label").collect()), key=str)


def with_extra(rows):
    return [(*r, "x", None) for r in rows]


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e200])
def test_against_plain_python(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(i, f"l{i % 3}" if i % 7 else None, (spread * rng.standard_normal(8)).tolist()) for i in range(60)]
    rows += [(70, "l1", rows[3][2]), (3, "l2", rows[5][2]), (3, "l2", rows[5][2]), (None, "l1", rows[9][2]), (71, None, [spread, 2.0]), (72, "l9", []), (73, "l1", None), (74, "l1", [math.nan] * 8), (75, "l1", [None] * 8), (76, "l1", [math.inf] + [0.0] * 7)]
    assert found(spark, with_extra(rows), entries=9, rounds=3) == plain(rows, 4, 9, 3)


def test_few_rows_ties_and_none(spark):
    rows = [(2, None, [0.0, 0.0, 1.0, 1.0]), (1, "a", [0.0] * 4), (5, "a", [-0.0001] * 4)]
    assert found(spark, with_extra(rows)) == plain(rows, 4, 256, 4)
    assert found(spark, with_extra([(1, "a", None)])) == [] and found(spark, []) == []
    odd = [(i, "a", [float(i), 1.0, 2.0, 3.0, 4.0]) for i in range(6)]  # five components in four parts
    assert found(spark, with_extra(odd), entries=2) == plain(odd, 4, 2, 4)


def test_partitions_change_nothing(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    one = sorted(map(tuple, codes.vector_codes(vectors.coalesce(1)).collect()))
    assert one == sorted(map(tuple, codes.vector_codes(vectors.repartition(17)).collect()))


def test_agrees_with_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    mine = codes.op11_vector_codes(spark, SF)
    want = db.execute(codes.sql_vector_codes())
    assert [d[0] for d in want.description] == mine.columns
    assert sorted(want.fetchall()) == sorted(map(tuple, mine.collect()))
