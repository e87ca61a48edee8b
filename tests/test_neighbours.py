"""Exact and hashed neighbours against brute force; equal vectors, ties, directions, recall."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.operators.neighbours import exact_neighbours, hashed_neighbours


def brute(ids, vecs, k=10):
    x = np.asarray(vecs, float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = 1 - np.sqrt(np.maximum(0, 2 - 2 * np.clip(x @ x.T, -1, 1)))
    sim = np.round(sim, 7)
    return {(a, ids[j]): sim[i, j] for i, a in enumerate(ids)
            for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sim[i, j], ids[j]))[:k - 1]}


def frame(spark, ids, vecs):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vecs, strict=True)], "doc_id long, vec array<double>")


def pairs(df):
    rows = df.collect()
    out = {(r.doc_id, r.similar_doc_id): r.similarity for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("chunk", [2048, 17])
def test_exact_on_clusters(spark, chunk):
    rnd = np.random.default_rng(0)
    centres = rnd.standard_normal((12, 6)) * 4
    vecs = np.concatenate([c + rnd.standard_normal((40, 6)) * 0.2 for c in centres])
    ids = rnd.permutation(len(vecs))
    got = pairs(exact_neighbours(frame(spark, ids, vecs), cell=24, chunk=chunk))
    want = brute(ids.tolist(), vecs)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)


def test_exact_with_a_third_of_equal_vectors_and_few_items(spark):
    rnd = np.random.default_rng(1)
    vecs = rnd.integers(-2, 3, (150, 4)).astype(float)                    # many ties
    vecs = vecs[(vecs != 0).any(1)]
    vecs[:50] = vecs[0]
    ids = rnd.permutation(len(vecs))
    got = pairs(exact_neighbours(frame(spark, ids, vecs), cell=10, chunk=16))
    want = brute(ids.tolist(), vecs)
    assert {a: sorted(round(s, 5) for (x, _), s in got.items() if x == a) for a in ids.tolist()} == {
        a: sorted(round(float(s), 5) for (x, _), s in want.items() if x == a) for a in ids.tolist()}
    same = [i for i, v in zip(ids.tolist(), vecs, strict=True) if (v == vecs[0]).all()]
    for a in same:                                                        # the least ids of its equals
        assert {(a, b) for b in [s for s in sorted(same) if s != a][:9]} <= got.keys()
    for n in (0, 1, 2, 5):
        got = pairs(exact_neighbours(frame(spark, ids[60:60 + n], vecs[60:60 + n])))
        assert len(got) == n * (n - 1)


def test_vectors_without_direction_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0]),
            (8, [1e308, 1e308]), (9, []), (None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    for find in (exact_neighbours, hashed_neighbours):
        assert {r.doc_id for r in find(df).collect()} == {1, 2, 8, None}


def test_cells_are_ruled_out(spark, monkeypatch):
    """On clustered vectors round two asks few cells."""
    from termlens.operators import neighbours

    asked, join = [], neighbours.bounded_join

    def counting(queries, data, k, chunk):
        asked.append(queries.count())
        return join(queries, data, k, chunk)

    monkeypatch.setattr(neighbours, "bounded_join", counting)
    rnd = np.random.default_rng(5)
    vecs = np.concatenate([c + rnd.standard_normal((60, 8)) * 0.05 for c in rnd.standard_normal((20, 8)) * 3])
    exact_neighbours(frame(spark, range(len(vecs)), vecs), cell=30).collect()
    assert asked[0] == 1200 and asked[1] < 0.25 * 1200 * 39


def test_hashing_recall_at_sf01(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    pdf = e.toPandas()
    want = brute(pdf.doc_id.tolist(), np.stack(pdf.vec.to_numpy()))
    got = pairs(hashed_neighbours(e))
    assert len(pdf) == 2000 and len(got.keys() & want.keys()) / len(want) >= 0.9


def test_hashing_splits_crowded_buckets(spark):
    rnd = np.random.default_rng(7)
    crowd = np.concatenate([rnd.standard_normal((300, 16)), np.ones((300, 16)) + rnd.standard_normal((300, 16)) * 1e-3])
    got = pairs(hashed_neighbours(frame(spark, range(600), crowd), leaf=32, probes=3, chunk=64))
    want = brute(list(range(600)), crowd)
    dense = {p for p in want if p[0] >= 300}
    assert len(got.keys() & dense) / len(dense) > 0.5 and max(p[0] for p in got) == 599
