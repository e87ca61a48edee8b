"""Nearest neighbours by angular distance: exact (metric cells) and by hyperplane hashing.

The angular distance sqrt(2 - 2 cos) is the Euclidean distance of unit vectors,
hence a metric; similarity is ``1 - distance``.  ``k`` counts the item itself,
so each item gets up to ``k - 1`` others, nearest first, ties by id.

Both ways work on *classes*: equal vectors are one row with its ``k`` least ids
(more can never be among anyone's neighbours), so a vector that a third of the
items share is searched once.  Both use one bounded join: queries and data meet
by a key, both sides of a key are dealt into chunks of about ``CHUNK`` rows by
hash, and a task scores one chunk of queries against one of data with matrix
products and returns at most ``k`` rows a query - never all pairs.

:func:`exact_neighbours`: cells around pivots (a bounded sample; at most
``MAX_PIVOTS``).  Round one searches each class's own cell, which bounds its
k-th distance r.  Round two visits the other cells that can hold something
nearer than r: the triangle inequality on the cell's inner and outer radius, and
the distance to the plane between the two pivots, rule out the rest.  Items
whose r crosses no border are done after round one.  (With vectors that have no
structure few cells can be ruled out, and exact search is quadratic by nature.)

:func:`hashed_neighbours`: several tables of hyperplane codes; each plane is put
at the median of a bounded sample, so that it halves the data.  One routing pass
gives every class its codes.  A bucket is a prefix of the code; prefixes with
more than ``leaf`` classes are split by more bits, until the code ends.  A class
also asks the buckets that differ in its least certain bits (multi-probe).

Vectors without direction (zero, null, with null or non-finite entries) have no
angle: they are left out, as are those whose length isn't the most frequent one.
An item without id gets neighbours but is nobody's neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.constants import DEFAULT_NEIGHBOURS
from termlens.session import cut_lineage

CHUNK = 2048
CELL = 512                    # classes of a cell aimed at
MAX_PIVOTS = 1024
SAMPLE = 20_000               # vectors that place the planes
BLOCK = 512                   # rows of a matrix product
SPAN = 16_384                 # classes of neighbouring cells that are sent together
SLACK = 1e-7                  # of distances: rounding of products near 1
FOUND = "a long, b long, dist double"


def _lowest(df: DataFrame, column: str, n: int, total: int) -> DataFrame:
    """The n rows of least ``column`` (a hash); a threshold keeps the tasks from sending n rows each."""
    if total > 4 * n:
        most = int(min(2.0 * n / total, 1.0) * 2.0 ** 64) - (1 << 63)
        some = df.where(F.col(column) <= F.lit(min(most, (1 << 63) - 1)))
        if some.count() >= n:
            df = some
    return df.orderBy(column).limit(n)


def classes(items: DataFrame, k: int, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Written tables (c, v, ids) of different unit vectors ``v`` (binary doubles) and (id, c) of items; vector length."""
    d = F.col(vec_col).cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(d, lambda x: x != 0)
    rows = cut_lineage(items.select(F.col(id_col).alias("id"), d.alias("vec")).where(fine).select(
        "id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")))
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = int(size["d"]) if size else 0
    rows = rows.where(F.size("vec") == dim)
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))       # k rows a task at most reach the shuffle
    few = rows.select("h1", "h2", "id").withColumn("nth", nth).where(F.col("nth") <= k).groupBy("h1", "h2").agg(
        F.array_sort(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("h1", "h2").agg(F.any_value("vec").alias("vec"))

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["vec"].to_numpy()).astype(float) if len(b) else np.zeros((0, dim))
            x = x / np.abs(x).max(1, initial=0.0, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield b.drop(columns="vec").assign(v=[r.tobytes() for r in x])

    kinds = {c: t for c, t in few.dtypes}
    made = one.join(few, ["h1", "h2"]).select(F.monotonically_increasing_id().alias("c"), "h1", "h2", "ids", "vec").mapInPandas(
        units, f"c long, h1 long, h2 long, ids {kinds['ids']}, v binary")
    made = cut_lineage(made)
    members = rows.select("id", "h1", "h2").join(made.select("h1", "h2", "c"), ["h1", "h2"]).select("id", "c")
    return made, members, dim


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(k: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        """The k nearest other classes of each query in one chunk of data, none beyond its radius."""
        out = []
        if len(queries) and len(data):
            y, names = _matrix(data["w"]), data["name"].to_numpy()
            for lo in range(0, len(queries), BLOCK):
                q = queries.iloc[lo:lo + BLOCK]
                dist = np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(_matrix(q["v"]) @ y.T, -1, 1)))
                dist[q["c"].to_numpy()[:, None] == names[None, :]] = np.inf
                dist[dist > q["r"].to_numpy()[:, None] + SLACK] = np.inf
                m = min(k, dist.shape[1])
                near = np.argpartition(dist, m - 1, 1)[:, :m]
                found = np.take_along_axis(dist, near, 1)
                row, col = np.nonzero(np.isfinite(found))
                out.append(pd.DataFrame({"a": q["c"].to_numpy()[row], "b": names[near[row, col]], "dist": found[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "dist": []}).astype({"a": "int64", "b": "int64"})
    return run


def _nearest_of_cells(k: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        """The k nearest other classes of each query among the cells that it asks for, none beyond its radius."""
        none = pd.DataFrame({"a": [], "b": [], "dist": []}).astype({"a": "int64", "b": "int64"})
        if not len(queries) or not len(data):
            return none
        data = data.sort_values("cell", kind="stable")
        y, names, cells = _matrix(data["w"]), data["name"].to_numpy(), data["cell"].to_numpy()
        x, own, radius = _matrix(queries["v"]), queries["c"].to_numpy(), queries["r"].to_numpy(copy=True)
        asked = queries["cells"].to_numpy()
        row = np.repeat(np.arange(len(queries)), [len(a) for a in asked])
        cell = np.concatenate(asked)
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        best, which = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, np.int64)
        for key in np.unique(cells):
            lo, hi = np.searchsorted(cells, key), np.searchsorted(cells, key, "right")
            those = row[np.searchsorted(cell, key):np.searchsorted(cell, key, "right")]
            for i in range(0, len(those), BLOCK):
                q = those[i:i + BLOCK]
                dist = np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(x[q] @ y[lo:hi].T, -1, 1)))
                dist[own[q][:, None] == names[None, lo:hi]] = np.inf
                dist[dist > radius[q][:, None] + SLACK] = np.inf
                some = np.isfinite(dist).any(1)
                if not some.any():
                    continue
                q, dist = q[some], dist[some]
                dist = np.concatenate([best[q], dist], 1)
                near = np.argpartition(dist, k - 1, 1)[:, :k]
                at = np.concatenate([which[q], np.broadcast_to(names[lo:hi], (len(q), hi - lo))], 1)
                best[q], which[q] = np.take_along_axis(dist, near, 1), np.take_along_axis(at, near, 1)
                radius[q] = np.minimum(radius[q], best[q].max(1))
        r, col = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"a": own[r], "b": which[r, col], "dist": best[r, col]})
    return run


def bounded_join(queries: DataFrame, data: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b, dist): for queries (key, c, v, r) the k nearest classes of data (key, c, v) with their key, per chunk;
    if a query also names ``cells``, among the data of these ``cell``s only."""
    by_cell = "cells" in queries.columns
    def dealt(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name))

    sizes = cut_lineage(dealt(queries, "nq").join(dealt(data, "nd"), "key"))
    q = queries.join(sizes, "key").select("key", F.pmod(F.xxhash64("c", F.lit("q")), "nq").cast("int").alias("qc"),
                                          F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("dc"), "c", "v", "r",
                                          *(["cells"] if by_cell else []))
    d = data.join(sizes, "key").select(F.col("key").alias("place"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qd"),
                                       F.pmod(F.xxhash64("c", F.lit("d")), "nd").cast("int").alias("dd"),
                                       F.col("c").alias("name"), F.col("v").alias("w"), *(["cell"] if by_cell else []))
    nearest = _nearest_of_cells(k) if by_cell else _nearest(k)
    return q.groupBy("key", "qc", "dc").cogroup(d.groupBy("place", "qd", "dd")).applyInPandas(nearest, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def expanded(found: DataFrame, made: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Neighbour classes to neighbours of items: (doc_id, similar_doc_id, similarity)."""
    others = found.join(made.select(F.col("c").alias("b"), F.explode("ids").alias("other")), "b").select("a", "dist", "other")
    own = made.select(F.col("c").alias("a"), F.lit(0.0).alias("dist"), F.explode("ids").alias("other"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy("dist", "other"))
    top = others.unionByName(own).withColumn("nth", nth).where(F.col("nth") <= k)
    near = top.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("nth", "other", "dist"))).alias("near"))   # k at most
    rows = members.join(near, members["c"] == near["a"]).select(
        "id", F.explode(F.expr(f"slice(filter(near, x -> NOT (x.other <=> id)), 1, {k - 1})")).alias("n"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n.other").alias("similar_doc_id"),
                       (F.lit(1.0) - F.col("n.dist")).alias("similarity"))


# ---- exact -------------------------------------------------------------------

def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(x @ pivots.T, -1, 1)))


def exact_neighbours(items: DataFrame, k: int = DEFAULT_NEIGHBOURS, id_col: str = "doc_id", vec_col: str = "vec",
                     cell: int = CELL, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """doc_id, similar_doc_id, similarity: the k - 1 most similar other items."""
    made, members, _ = classes(items, k, id_col, vec_col)
    n = made.count()
    wanted = max(1, min(MAX_PIVOTS, math.ceil(n / cell)))
    sample = _lowest(made.select("h1", "v"), "h1", wanted, n).collect()          # at most MAX_PIVOTS vectors
    pivots = np.array([np.frombuffer(r.v, float) for r in sample]) if sample else np.zeros((1, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                dist = _distances(_matrix(b["v"]), pivots)
                own = dist.argmin(1)
                yield b.assign(key=own.astype("int32"), d=dist[np.arange(len(b)), own])

    placed = cut_lineage(made.select("c", "v").mapInPandas(assign, "c long, v binary, key int, d double"))
    cells = {r.key: (r.lo, r.hi, r.n) for r in placed.groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    inner = np.array([cells.get(i, (np.inf, -np.inf, 0))[0] for i in range(len(pivots))])
    outer = np.array([cells.get(i, (np.inf, -np.inf, 0))[1] for i in range(len(pivots))])
    first = cut_lineage(_best(bounded_join(placed.withColumn("r", F.lit(float("inf"))), placed, k, chunk), k))
    # the class itself and k - 1 others are enough; a cell with fewer bounds nothing
    radius = first.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k - 1, F.sort_array(F.collect_list("dist"))[max(k - 2, 0)]).alias("r"))
    # a query goes once to every span of cells that it asks, not once to each cell
    spans = (np.cumsum([cells.get(i, (0, 0, 0))[2] for i in range(len(pivots))]) - 1) // span
    first_cell = np.flatnonzero(np.diff(spans, prepend=-1))
    asked = placed.join(radius, placed["c"] == radius["a"], "left").select(
        "c", "v", "key", "d", F.coalesce("r", F.lit(float("inf"))).alias("r"))
    between = _distances(pivots, pivots)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                q = b.iloc[lo:lo + BLOCK]
                own, dist = q["key"].to_numpy(), _distances(_matrix(q["v"]), pivots)
                plane = (dist ** 2 - q["d"].to_numpy()[:, None] ** 2) / np.maximum(2 * between[own], 1e-12)
                least = np.maximum(np.maximum(dist - outer, inner - dist), plane)
                least[np.arange(len(q)), own] = np.inf
                wanted = (least <= q["r"].to_numpy()[:, None] + SLACK) & np.isfinite(least)
                for s, at in enumerate(first_cell):
                    part = wanted[:, at:first_cell[s + 1] if s + 1 < len(first_cell) else None]
                    row = np.flatnonzero(part.any(1))
                    if len(row):
                        yield pd.DataFrame({"key": np.int32(s), "c": q["c"].to_numpy()[row], "v": q["v"].to_numpy()[row],
                                            "r": q["r"].to_numpy()[row],
                                            "cells": [(np.flatnonzero(w) + at).astype("int32") for w in part[row]]})

    more = cut_lineage(asked).mapInPandas(visits, "key int, c long, v binary, r double, cells array<int>")
    numbers = F.array(*[F.lit(int(x)) for x in np.searchsorted(first_cell, np.arange(len(pivots)), "right") - 1])
    data = placed.select(F.get(numbers, F.col("key")).alias("key"), "c", "v", F.col("key").alias("cell"))
    second = bounded_join(more, data, k, max(chunk, span))
    return expanded(_best(first.unionByName(second), k), made, members, k)


# ---- hashing -----------------------------------------------------------------

CODE_BITS = 40


def planes(made: DataFrame, dim: int, tables: int, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions [tables, CODE_BITS, dim] and the sample's median along each."""
    w = np.random.default_rng(seed).standard_normal((tables, CODE_BITS, max(dim, 1)))
    sample = _lowest(made.select("h1", "v"), "h1", SAMPLE, n).collect()          # at most SAMPLE vectors
    x = np.array([np.frombuffer(r.v, float) for r in sample]) if sample else np.zeros((1, max(dim, 1)))
    return w, np.median(np.einsum("nd,tbd->tbn", x, w), axis=2)


def hashed_neighbours(items: DataFrame, k: int = DEFAULT_NEIGHBOURS, tables: int = 10, leaf: int = 256, probes: int = 2,
                      seed: int = 17, id_col: str = "doc_id", vec_col: str = "vec", chunk: int = CHUNK) -> DataFrame:
    """doc_id, similar_doc_id, similarity: the most similar other items among those that share a bucket."""
    made, members, dim = classes(items, k, id_col, vec_col)
    n = made.count()
    w, middle = planes(made, dim, tables, seed, n)
    base = min(CODE_BITS, max(0, math.ceil(math.log2(max(n, 1) / leaf))))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            x = _matrix(b["v"])
            for t in range(tables if len(b) else 0):
                side = x @ w[t].T - middle[t]
                unsure = np.argsort(np.abs(side), axis=1)                        # bits by rising certainty
                yield pd.DataFrame({"t": np.int32(t), "c": b["c"], "code": (side > 0) @ weights,
                                    "unsure": [u.astype(np.int32) for u in unsure]})

    vectors = made.select("c", "v")
    coded = cut_lineage(vectors.mapInPandas(route, "t int, c long, code long, unsure array<int>"))

    # buckets with too many classes get the bits that halve them to fit, until none is left or the code ends
    where = cut_lineage(coded.select("t", "c", "code").withColumn("bits", F.lit(base)))
    while True:
        full = where.withColumn("p", F.expr(f"shiftrightunsigned(code, {CODE_BITS} - bits)")).groupBy("t", "bits", "p").agg(
            F.count(F.lit(1)).alias("m")).where((F.col("m") > leaf) & (F.col("bits") < CODE_BITS))
        full = cut_lineage(full)
        if not full.limit(1).count():
            break
        grown = F.least(F.lit(CODE_BITS), F.col("bits") + F.ceil(F.log2(F.col("m") / leaf)).cast("int"))
        split = full.select("t", F.col("bits").alias("was"), "p", grown.alias("longer"))
        now = where.withColumn("p", F.expr(f"shiftrightunsigned(code, {CODE_BITS} - bits)"))
        where = cut_lineage(now.join(split, (now["t"] == split["t"]) & (now["bits"] == split["was"]) & (now["p"] == split["p"]), "left").select(
            now["t"], "c", "code", F.coalesce("longer", "bits").alias("bits")))
    rows = cut_lineage(coded.join(where.select("t", "c", "bits"), ["t", "c"]))
    key = F.concat_ws(":", "t", "bits", F.expr(f"shiftrightunsigned(code, {CODE_BITS} - bits)")).alias("key")
    held = cut_lineage(rows.select(key, "c"))
    asked = rows.select("t", "bits", "c", F.explode(F.expr(
        f"concat(array(code), transform(slice(filter(unsure, u -> u < bits), 1, {probes}),"
        f" u -> code ^ shiftleft(1L, {CODE_BITS} - 1 - u)))")).alias("code"))
    # a probed place belongs to the one bucket whose prefix it has, of whatever length
    lengths = [r.bits for r in where.select("bits").distinct().collect()]        # at most CODE_BITS
    if len(lengths) > 1:
        asked = asked.withColumn("bits", F.explode(F.array(*[F.lit(b) for b in lengths])))
    queries = asked.select(key, "c").join(held.select("key").distinct(), "key", "left_semi").join(vectors, "c").withColumn(
        "r", F.lit(float("inf")))
    data = held.join(vectors, "c")
    found = bounded_join(queries, data, k, chunk).groupBy("a", "b").agg(F.min("dist").alias("dist"))
    return expanded(_best(found, k), made, members, k)
