"""Approximate nearest neighbours by angular distance: a random-projection
forest built as Spark jobs.

Angular distance of u, v is sqrt(2 - 2 cos(u, v)) (the Euclidean distance of
the unit vectors); similarity is ``1 - distance``.  ``k`` neighbours include
the item itself, which is then dropped, so each item gets up to k - 1 others.

Plan:

1. ``mapInPandas``: scale each vector to unit length and project it on
   ``levels`` random directions per tree (one small matrix product per Arrow
   batch; the directions come from a seeded generator, identical on every
   task).  Rows become (id, tree, projections) — no vector travels further.
2. Level by level, all trees at once: every node holding more than
   ``leaf_size`` items is split at its median projection
   (``percentile_approx``, a partial aggregate); items exactly at the median
   go left or right by a hash of their id, so even a node of identical
   vectors halves.  Only the node -> median table is joined back (broadcast
   behind a row-count check, else a shuffle join).  The table of items is
   written to the checkpoint directory after each level, without the
   projections that are done with.
3. Leaves are bounded by ``leaf_size`` by construction (a final hash split
   covers the level cap), so ``applyInPandas`` per (tree, leaf) scores a
   bounded group with one Gram matrix and emits only each item's best k - 1.
4. Per item, the best k - 1 over all trees (a window over at most
   trees * (k - 1) rows).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.constants import DEFAULT_NEIGHBOURS, DEFAULT_TREES
from termlens.session import cut_lineage

MAX_BROADCAST_NODES = 2_000_000


def _directions(seed: int, dim: int, trees: int, levels: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * levels))


def _project(seed: int, dim: int, trees: int, levels: int):
    d = _directions(seed, dim, trees, levels)

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(float)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            p = x @ d
            for t in range(trees):
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "tree": t,
                                    "proj": list(p[:, t * levels:(t + 1) * levels])})
    return run


def build_forest(items: DataFrame, trees: int = DEFAULT_TREES, leaf_size: int = 32,
                 seed: int = 17, n_items: int | None = None) -> DataFrame:
    """(tree, leaf, id) for every item in every tree.  ``items``: id, vec."""
    head = items.select("vec").first()
    dim = len(head[0]) if head is not None else 1  # no item: an empty forest
    n = n_items if n_items is not None else items.count()
    levels = max(1, math.ceil(math.log2(max(n, 2) / leaf_size)) + 4)
    schema = T.StructType([T.StructField("id", items.schema["id"].dataType),
                           T.StructField("tree", T.IntegerType()),
                           T.StructField("proj", T.ArrayType(T.DoubleType()))])
    cur = items.mapInPandas(_project(seed, dim, trees, levels), schema)
    cur = cut_lineage(cur.withColumn("node", F.lit(1).cast("long")))
    for level in range(levels):
        stats = cur.groupBy("tree", "node").agg(
            F.count(F.lit(1)).alias("_n"), F.percentile_approx(F.col("proj")[0], 0.5, 10000).alias("_m"))
        # small (one row per node to split) and computed from the written item
        # table, so it is recomputed rather than written out
        stats = stats.where(F.col("_n") > leaf_size).select("tree", "node", "_m")
        big = stats.count()
        if big == 0:
            break
        if big <= MAX_BROADCAST_NODES:
            stats = F.broadcast(stats)
        p = F.col("proj")[0]                 # those of the levels behind are gone
        tie = F.pmod(F.xxhash64(F.lit(seed), F.col("tree"), F.col("id"), F.lit(level)), F.lit(2)) == 0
        left = (p < F.col("_m")) | ((p == F.col("_m")) & tie)
        child = F.when(F.col("_m").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1))
        cur = cut_lineage(cur.join(stats, ["tree", "node"], "left").select(
            "id", "tree", F.slice("proj", 2, levels).alias("proj"), child.alias("node")))
    # Safety net at the level cap: split any node still over the bound by
    # hash, so every candidate group stays bounded.
    sizes = cur.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("_n"))
    cur = cur.join(sizes, ["tree", "node"])
    chunk = F.when(F.col("_n") > leaf_size,
                   F.pmod(F.xxhash64(F.col("id")), F.ceil(F.col("_n") / leaf_size))).otherwise(F.lit(0))
    return cur.select("tree", F.concat_ws(":", F.col("node").cast("string"), chunk.cast("string")).alias("leaf"),
                      "id")


def _leaf_topk(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        cos = np.clip(x @ x.T, -1.0, 1.0)
        sim = 1.0 - np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
        np.fill_diagonal(sim, -np.inf)
        m = min(k - 1, len(ids) - 1)
        if m <= 0:
            return pd.DataFrame({"id": ids[:0], "other": ids[:0], "similarity": np.zeros(0)})
        # best m per row: by similarity desc, then other id asc
        order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :m]
        rows = np.repeat(np.arange(len(ids)), m)
        cols = order.reshape(-1)
        return pd.DataFrame({"id": ids[rows], "other": ids[cols], "similarity": sim[rows, cols]})
    return run


@F.pandas_udf(T.DoubleType())
def _angular_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - angular distance, row by row, on Arrow batches."""
    x = np.stack(a.to_numpy()).astype(float)
    y = np.stack(b.to_numpy()).astype(float)
    nx = np.linalg.norm(x, axis=1)
    ny = np.linalg.norm(y, axis=1)
    cos = np.einsum("ij,ij->i", x, y) / np.where(nx * ny > 0, nx * ny, 1.0)
    return pd.Series(1.0 - np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.clip(cos, -1.0, 1.0))))


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.col("similarity").desc(), F.col("other"))
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k - 1).drop("_r")


def refine(base: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """One round of neighbours-of-neighbours: candidates of an item are its
    neighbours and their neighbours (at most (k-1)^2 + k - 1), scored exactly.
    The join key is the middle item, whose own list is bounded by k - 1."""
    nn = top.select("id", "other")
    two = (nn.alias("a").join(nn.alias("b"), F.col("a.other") == F.col("b.id"))
           .select(F.col("a.id").alias("id"), F.col("b.other").alias("other"))
           .where(F.col("id") != F.col("other")))
    cand = two.unionByName(nn).distinct()
    va = base.select("id", F.col("vec").alias("va"))
    vb = base.select(F.col("id").alias("other"), F.col("vec").alias("vb"))
    # the vectors are the smaller side of both joins; a hash join doesn't sort (and spill) the pairs with their vectors
    scored = cand.join(va.hint("shuffle_hash"), "id").join(vb.hint("shuffle_hash"), "other").select("id", "other", _angular_udf("va", "vb").alias("similarity"))
    return _top(scored, k)


def nearest_neighbours(items: DataFrame, k: int = DEFAULT_NEIGHBOURS, trees: int = DEFAULT_TREES,
                       leaf_size: int = 128, seed: int = 17, id_col: str = "doc_id",
                       vec_col: str = "vec", refine_rounds: int = 1) -> DataFrame:
    """doc_id, similar_doc_id, similarity: the k - 1 most similar other items
    found by the forest (plus ``refine_rounds`` neighbour-of-neighbour
    rounds)."""
    # single precision travels as it is (half the bytes) and becomes double where it is used
    single = items.schema[vec_col].dataType == T.ArrayType(T.FloatType(), items.schema[vec_col].dataType.containsNull)
    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    base = cut_lineage(items.select(F.col(id_col).alias("id"), vec.alias("vec")).where(F.col("vec").isNotNull()))
    leaves = build_forest(base, trees, leaf_size, seed)
    grouped = leaves.join(base, "id")
    id_type = base.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("other", id_type),
                        T.StructField("similarity", T.DoubleType())])
    cand = grouped.groupBy("tree", "leaf").applyInPandas(_leaf_topk(k), out)
    best = cand.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    top = _top(best, k)
    for _ in range(refine_rounds):
        top = refine(base, cut_lineage(top), k)
    return top.select(F.col("id").alias("doc_id"), F.col("other").alias("similar_doc_id"), "similarity")
