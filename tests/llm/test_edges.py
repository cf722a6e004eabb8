"""Nulls, empty tables, repeated rows and clashing column names for every operator, and the pipeline against brute force."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitlark.llm import queries as registered
from pitlark.llm import decontaminate, language_model, licenses, packing, pages, pii, quality, simhash, toxicity, vectors

#: Names that the operators use themselves.
CLASH = "component_id string, fp string, rep string, tails string, score string, template string, share string, spans string, ids string, length string, node string, n_tokens string, host string, blocks string, mark string, rating string, item_id string"
EXTRA = ["x"] * 17
SCHEMA = f"doc_id long, text string, {CLASH}"
ROWS = [(1, "plain words of a text", *EXTRA), (1, "plain words of a text", *EXTRA), (2, None, *EXTRA), (3, "", *EXTRA), (None, " \n\t", *EXTRA), (4, "word " * 40_000, *EXTRA), (5, "é" * 50_000, *[None] * 17)]


def _labels(spark, name):
    return spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], f"doc_id long, {name} int")


def _one_to_one(spark):
    return {
        "pii": pii.pseudonymize,
        "toxicity": lambda d: toxicity.toxicity_scores(d, _labels(spark, "toxic")),
        "simhash": simhash.simhash_components,
        "language_model": language_model.lm_scores,
        "quality": lambda d: quality.grade(d, quality.train(d.select("doc_id", "text"), _labels(spark, "rating"))),
    }


@pytest.mark.parametrize("name", ["pii", "toxicity", "simhash", "language_model", "quality"])
def test_rows_stay_one_to_one(spark, name):
    operator = _one_to_one(spark)[name]
    out = operator(spark.createDataFrame(ROWS, SCHEMA)).select("doc_id").collect()
    assert sorted((r[0] or 0) for r in out) == sorted((r[0] or 0) for r in ROWS)
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_operators_take_clashing_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    bench = spark.createDataFrame([(7, "plain words of a text", "x"), (None, "other", "x")], "item_id long, text string, doc_id string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 7)] * 2
    assert sorted((r[0] or 0) for r in decontaminate.drop_leaks(docs, bench).select("doc_id").collect()) == [0, 2, 3, 4, 5]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert licenses.scan_licenses(docs).count() == 0
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    packed = packing.pack(docs).toPandas()
    assert packed["length"].sum() == sum(len(b) // 4 for b in packing.token_bytes([r[1] for r in ROWS], "byte_bpe_50k.json"))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 2
    html = docs.selectExpr("doc_id page_id", "text url", "text html", *[c.split()[0] for c in CLASH.split(", ")])
    assert pages.main_text(html).count() == len(ROWS) and pages.main_text(html.limit(0)).count() == 0
    vecs = docs.selectExpr("doc_id vec_id", "if(text is null, null, array(1.0D, 2.0D)) embedding", *[c.split()[0] for c in CLASH.split(", ")])
    assert vectors.embedding_components(vecs).count() == len(ROWS) and vectors.embedding_components(vecs.limit(0)).count() == 0


def test_every_sql_is_sql():
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    found = registered.oracle_sql()
    assert set(found) <= set(registered.queries())
    for name, text in found.items():
        try:
            db.execute(f"EXPLAIN {text}")
        except duckdb.Error as error:
            pytest.fail(f"{name}: {error}")


def test_a_cluster_needs_its_own_key():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="pii.key"):
        pii.session_key(Session())
    Context.master = "local[2]"
    assert pii.session_key(Session()) == pii.KEY


def test_a_cluster_without_a_key_gets_one_drawn_for_the_application(spark, monkeypatch):
    """Both queries ran into an error there."""

    class Context:
        def __init__(self, master, name):
            self.master, self.applicationId = master, name

    class Session:
        def __init__(self, master, name, key=None):
            self.sparkContext, self.conf, self.read = Context(master, name), type("Conf", (), {"get": lambda _, k, default=None: key or default})(), spark.read

    monkeypatch.setattr(pii, "_DRAWN", {})
    sf = "/root/testdata/sf0.001"
    with pytest.warns(UserWarning, match="pii.key"):
        first = pii.op3_pii(Session("spark://host:7077", "a"), sf)
    keys = [pii.query_key(Session("spark://host:7077", "a")), pii._DRAWN["a"]]
    assert keys[0] == keys[1] != pii.KEY and len(keys[0]) == 32
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = first.collect()
    assert sum(r["n_values"] for r in rows) > 0 and all(pii.rewrite(r["text"], keys[0], back=True)[0] == texts[r["doc_id"]] for r in rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.personal_data(Session("spark://host:7077", "a"), docs, sf).collect()} == {(r["doc_id"], r["text"]) for r in rows}
    with pytest.warns(UserWarning, match="pii.key"):
        assert pii.query_key(Session("yarn", "b")) != keys[0]
    assert pii.query_key(Session("yarn", "b", "mine")) == b"mine" and pii.query_key(Session("local[2]", "c")) == pii.KEY


def test_month_names_with_letters_outside_ascii_are_no_dates():
    """The long s equals an s where case is ignored, but begins no month's name: that ended the task with an error."""
    for text in ("on Augu\u017ft 5, 2024", "5 \u017feptember 2024"):
        assert pii.rewrite(text) == (text, [])
    assert len(pii.rewrite("on AUGUST 5, 2024 and 5 sept 2024, 5 Sep 2024")[1]) == 2


def test_pipeline_takes_odd_documents(spark):
    """Null ids and texts, repeated rows, columns with clashing names, and an empty table, through all stages."""
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(1, "plain words of a text"), (1, "plain words of a text"), (None, "words without an id"), (2, None), (3, ""), (2, "another text of that id")]
    extra = given.limit(20).withColumns({"h": F.lit(1), "same": F.lit("x"), "kept": F.lit(None).cast("string"), "spans": F.lit(2)})
    docs = extra.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == some.columns, name
            now = spark.createDataFrame(out.collect(), out.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    model = quality.quality_model(spark, sf)
    words = quality._Words(len(model.weights))
    good = [i for i, t in docs.items() if model.tails(np.array([quality.features(t, words)]))[0, 0] >= 0.5]
    assert 0 < len(good) < len(docs)
    sets = {i: simhash.shingle_set(docs[i]) for i in good}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    label, before = {i: i for i in good}, None
    while label != before:
        before = dict(label)
        for a in good:
            label[a] = min(label[b] for b in good if alike(a, b))
    single = [i for i in good if label[i] == i]
    items = [(r["item_id"], decontaminate.words_of(r["text"])) for r in bench.collect()]
    verbatim = {i for i in single for _, w in items if w and b" " + b" ".join(w) + b" " in b" " + b" ".join(decontaminate.words_of(docs[i])) + b" "}
    out = corpus_pipeline.run(spark, sf).toPandas()
    final = set(out["doc_id"])
    assert final <= set(single) and not final & verbatim
    for i in list(final)[:40]:
        whole = packing.token_bytes([pii.rewrite(docs[i])[0]], "byte_bpe_50k.json")[0]
        mine = out[out["doc_id"] == i].sort_values("piece")
        assert mine["length"].sum() * 4 == len(whole)
        at = [*mine["start"], len(whole) // 4]
        assert [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at, at[1:])] == mine["ids_crc32"].tolist()
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(spark.createDataFrame([(i, docs[i]) for i in single], "doc_id long, text string"), bench).collect()}
    assert final == set(single) - leaked and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
