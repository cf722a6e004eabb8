import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pitlark.llm import packing as K

NAME = "byte_bpe_50k.json"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab '\n\t²́\x1d　é9_<|>", max_size=40)), min_size=1, max_size=8))
def test_ids_equal_the_tokenizer_over_whole_texts(texts):
    tok = K._tokenizer(NAME)[0]
    for text, got in zip(texts, K.token_bytes(texts, NAME)):
        assert np.frombuffer(got, "<u4").tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, K.END_ID]


@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_against_brute_force(lengths):
    fit, rooms = K.BestFit(20), []
    for n in sorted(lengths, reverse=True):
        found, offset = fit.add(n)
        best = min((r for r in rooms if r >= n), default=None)
        if best is None:
            assert found == len(rooms) and offset == 0
            rooms.append(20 - n)
        else:
            assert rooms[found] == best and offset == 20 - best
            rooms[found] -= n
    assert fit.bins == len(rooms)


def test_pack(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "x"), (None, "word " * 3000, "x"), (4, "tail " * 1500, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(2)
    out = K.pack(docs).toPandas()
    assert (out.groupby("sequence_id")["length"].sum() <= K.SEQUENCE).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert sorted(out[out["doc_id"].isin([1, 2, 3])]["length"]) == [1, 1, 4, 4]
    whole = K.token_bytes(["tail " * 1500], NAME)[0]
    mine = out[out["doc_id"] == 4].sort_values("piece")
    assert b"".join(mine["ids"]) == whole and mine["length"].tolist()[1:] == [1024] * (len(mine) - 1)
    assert mine["start"].tolist() == [0, *np.cumsum(mine["length"])[:-1]]
    assert zlib.crc32(b"".join(mine["ids"])) == zlib.crc32(whole)
    assert K.pack(spark.createDataFrame([], docs.schema)).count() == 0


def test_pack_is_near_the_bound(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('word ', cast(1 + abs(hash(id)) % 900 as int)) text").coalesce(2)
    out = K.pack(docs).toPandas()
    assert out["sequence_id"].nunique() <= out["length"].sum() / 1024 * 1.01 + 3


@given(st.lists(st.integers(1, 40), max_size=80))
def test_runs_equal_best_fit_item_by_item(lengths):
    fit = K.BestFit(40)
    one = [(n, *fit.add(n)) for n in sorted(lengths, reverse=True)]
    bins, runs = K.packed_runs({n: lengths.count(n) for n in lengths}, 40)
    many = [(n, b + j // q, o + j % q * n) for n, r in runs.items() for (lo, b, o, q), hi in zip(r, [*r[1:, 0], lengths.count(n)]) for j in range(hi - lo)]
    assert bins == fit.bins and len(many) == len(one)
    assert sorted(n for n, _, _ in many) == sorted(lengths)
    spans = {b: sorted((o, n) for n, c, o in many if c == b) for b in range(bins)}
    assert all([o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 40 for s in spans.values())


def test_sequences_do_not_depend_on_partitions_or_order(spark):
    docs = spark.range(1500).selectExpr("id doc_id", "repeat('word ', cast(1 + abs(hash(id)) % 900 as int)) text")
    apart = docs.repartitionByRange(8, "text")  # like lengths stand together
    out = [K.pack(d).toPandas() for d in (docs.coalesce(1), apart)]
    fit = K.BestFit(K.SEQUENCE)
    for n in sorted(out[0]["length"], reverse=True):
        fit.add(n)
    for o in out:
        assert o["sequence_id"].nunique() == fit.bins and len(o) == len(out[0])
        for _, g in o.sort_values("offset").groupby("sequence_id"):
            assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= K.SEQUENCE
