"""Embedding near-duplicates: an exact metric range join with pivots.

Unit vectors with cosine >= c are within r = sqrt(2 - 2c). Every vector belongs to the cell of its nearest pivot; by
the triangle inequality a partner of x in cell j needs d(x, p_j) <= d(x, own pivot) + 2r, so x is replicated, as a
guest, only to such cells j below its own (each pair of cells meets once). Cells are cut into chunks of a fixed number
of rows, and every (home chunk, home chunk) and (home chunk, guest chunk) joins alone, by blocked matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, table

MIN_COSINE = 0.9
#: Rows of a home chunk, which is also the number of rows there is a pivot for; rows of a guest chunk; most pivots.
HOME_ROWS, GUEST_ROWS, MAX_PIVOTS = 4096, 32768, 2048
_SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    # a power of two keeps squares in range and changes no direction
    x = x / np.exp2(np.floor(np.log2(np.abs(x).max(1, keepdims=True))))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> rep (smallest id), copies, vec: one row per distinct vector that can link."""
    values = F.col("embedding").cast("array<double>")
    good = F.coalesce(
        (F.size(values) > 0)
        & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(values, lambda v: v != 0),
        F.lit(False),
    )
    return vectors.select("vec_id", values.alias("vec")).where(good).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def link_groups(vectors: DataFrame, min_cosine: float = MIN_COSINE, home_rows: int = HOME_ROWS, guest_rows: int = GUEST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors with rep, copies, vec; per rep its number of linked other rows and links (rep, low) that span)."""
    spark = vectors.sparkSession
    groups = materialize(distinct_vectors(vectors).where("rep IS NOT NULL"))
    sizes = {r["dim"]: r["n"] for r in groups.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    pivots = {}
    for dim, n in sizes.items():
        k = min(MAX_PIVOTS, max(1, math.ceil(n / home_rows)))
        rows = groups.where(F.size("vec") == dim).orderBy(F.xxhash64(F.lit("pivot"), "rep"), "rep").limit(k).select("vec").collect()
        pivots[dim] = _unit(np.array([r[0] for r in rows], np.float64))
    reach = 2 * math.sqrt(max(0.0, 2 - 2 * min_cosine)) + _SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            flat, sizes_here = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(2).value_lengths().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes_here)[:-1]]) if len(sizes_here) else sizes_here
            for dim in np.unique(sizes_here).tolist():
                rows = np.nonzero(sizes_here == dim)[0]
                x, p = _unit(flat[starts[rows][:, None] + np.arange(dim)]), pivots[dim]
                d = np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))
                own = d.argmin(1)
                near = d <= d[np.arange(len(rows)), own][:, None] + reach
                near &= np.arange(len(p))[None] <= own[:, None]
                near[np.arange(len(rows)), own] = True
                at, cell = np.nonzero(near)
                for lo in range(0, len(at), 4000):
                    r, c = at[lo : lo + 4000], cell[lo : lo + 4000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{dim}:{k}" for k in c]), pa.array(own[r] == c), pa.array(reps[rows[r]], pa.int64()), pa.array(copies[rows[r]], pa.int64()), pa.array([v.tobytes() for v in x[r]], pa.binary())],
                        ["cell", "home", "rep", "copies", "vec"],
                    )

    placed = groups.select("rep", "copies", "vec").mapInArrow(place, "cell string, home boolean, rep long, copies long, vec binary")
    # At most two counts per pivot: a bounded table of chunk counts.
    counts: dict[str, dict[bool, int]] = {}
    for r in placed.groupBy("cell", "home").count().collect():
        counts.setdefault(r["cell"], {})[r["home"]] = r["count"]
    plan = [(c, max(1, math.ceil(n.get(True, 0) / home_rows)), math.ceil(n.get(False, 0) / guest_rows)) for c, n in counts.items()]
    chunks = F.broadcast(spark.createDataFrame(plan, "cell string, homes int, guests int"))  # one row per pivot
    cut = placed.join(chunks, "cell")
    spot = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("homes")).otherwise(F.greatest("guests", F.lit(1)))).cast("int")
    cut = cut.withColumn("chunk", spot)
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    unit = lambda kind, h, g, left: F.struct(F.lit(kind).alias("kind"), h.alias("a"), g.alias("b"), left.alias("left"))
    as_home = F.concat(
        F.transform(span("homes"), lambda o: unit("home", F.least("chunk", o), F.greatest("chunk", o), F.col("chunk") <= o)),
        F.when(F.col("guests") > 0, F.transform(span("guests"), lambda g: unit("guest", F.col("chunk"), g, F.lit(True)))).otherwise(F.array()),
    )
    as_guest = F.transform(span("homes"), lambda h: unit("guest", h, F.col("chunk"), F.lit(False)))
    units = cut.select("cell", "rep", "copies", "vec", F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)).alias("u"))
    units = units.select("cell", "u.kind", "u.a", "u.b", "u.left", "rep", "copies", "vec")

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == "home" and key[2] == key[3]
        left = frame[frame["left"]]
        right = left if same else frame[~frame["left"]]
        return _join_block(left, right, same, min_cosine)

    found = units.groupBy("cell", "kind", "a", "b").applyInPandas(join, "rep long, links long, low long")
    return groups, found


def _join_block(left: pd.DataFrame, right: pd.DataFrame, same: bool, min_cosine: float, step: int = 1024) -> pd.DataFrame:
    """Linked rows and a smallest linked id for each rep of a block that has links (a spanning set, not all pairs)."""
    none = pd.DataFrame({"rep": [], "links": [], "low": []}).astype("int64")
    if not len(left) or not len(right):
        return none
    frames = [left] if same else [left, right]
    ids, copies = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("rep", "copies"))
    shift = 0 if same else len(left)
    x, y = (np.frombuffer(b"".join(f["vec"]), "<f8").reshape(len(f), -1) for f in (left, right))
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i in range(0, len(x), step):
        for j in range(0, len(y), 4 * step):
            if same and j + 4 * step <= i:
                continue
            # single precision finds candidates with a margin far above its error; double precision decides
            a, b = np.nonzero(x32[i : i + step] @ y32[j : j + 4 * step].T >= min_cosine - 1e-4)
            a, b = a + i, b + j
            if same:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 1 << 17):
                p, q = a[k : k + (1 << 17)], b[k : k + (1 << 17)]
                ok = np.einsum("ij,ij->i", x[p], y[q]) >= min_cosine
                p, q = p[ok], q[ok] + shift
                links += (np.bincount(p, copies[q], len(ids)) + np.bincount(q, copies[p], len(ids))).astype(np.int64)
                root = _unite(root, p, q)
    low = ids.copy()
    np.minimum.at(low, root, ids)
    has = links > 0
    return pd.DataFrame({"rep": ids[has], "links": links[has], "low": low[root][has]})


def _unite(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """root: each row's representative; joins the sets of p[i] and q[i], all at once, until nothing is left to join."""
    while len(p):
        a, b = root[p], root[q]
        open_ = a != b
        p, q, a, b = p[open_], q[open_], a[open_], b[open_]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def embedding_components(vectors: DataFrame, min_cosine: float = MIN_COSINE, **sizes: int) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> vec_id, n_links, component_id, kept; one row per row of vectors.

    Equal vectors are one point with a number of copies. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing: n_links 0 and their own component; so do vectors of another length, and rows without
    a vec_id are returned with null component_id and kept. An empty table gives no rows. A vec_id that repeats is
    answered row by row.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))
    groups, found = link_groups(vectors, min_cosine, **sizes)
    found = materialize(found.where("rep IS NOT NULL"))
    degree = found.groupBy("rep").agg(F.sum("links").alias("linked"))
    labels = connected_components(found.select(F.col("rep").alias("src"), F.col("low").alias("dst")))
    points = groups.join(degree, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    points = points.select("vec", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("vec_id IS NOT NULL").join(points, "vec", "left").unionByName(rows.where("vec_id IS NULL").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.lit(None).cast("long")}))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
