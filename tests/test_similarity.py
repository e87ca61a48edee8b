"""Neighbours: similarity values (FIXTURES 3.7), bounded leaves, recall."""
import numpy as np
from pyspark.sql import functions as F

from termlens.operators.similarity import build_forest, nearest_neighbours


def exact_neighbours_local(ids, vecs, k: int = 10):
    """Brute force on a small in-memory fixture (tests only)."""
    x = np.asarray(vecs, dtype=float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.clip(x @ x.T, -1.0, 1.0)
    sim = 1 - np.sqrt(np.maximum(0.0, 2 - 2 * cos))
    out = []
    for i, d in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sim[i, j], ids[j]))[: k - 1]
        out.extend((d, ids[j], float(sim[i, j])) for j in order)
    return out


def test_fixture_values(spark):
    df = spark.createDataFrame([("doc1", [0.1, 0.3, 0.0]), ("doc2", [0.0, 0.5, 0.2]), ("doc3", [0.1, 0.0, 0.4])],
                               "doc_id string, vec array<double>")
    got = {(r.doc_id, r.similar_doc_id): r.similarity for r in nearest_neighbours(df, k=3, trees=2).collect()}
    want = {("doc1", "doc2"): 0.511800, ("doc1", "doc3"): -0.358899, ("doc2", "doc3"): -0.131104}
    for (a, b), v in want.items():
        assert abs(got[(a, b)] - v) < 1e-6 and abs(got[(b, a)] - v) < 1e-6
    assert all(a != b for a, b in got)


def test_leaves_bounded_with_duplicates(spark):
    rng = np.random.default_rng(0)
    vecs = [list(map(float, v)) for v in rng.standard_normal((300, 8))]
    same = vecs[0]
    vecs[:100] = [same] * 100  # a third of the items identical
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, vec array<double>")
    leaves = build_forest(df, trees=3, leaf_size=16)
    sizes = leaves.groupBy("tree", "leaf").count().agg(F.max("count")).first()[0]
    assert sizes <= 16
    assert leaves.count() == 900


def test_recall_against_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    pdf = e.toPandas()
    exact = {(a, b) for a, b, _ in exact_neighbours_local(list(pdf.vec_id), list(pdf.embedding))}
    got = nearest_neighbours(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))).collect()
    pairs = {(r.doc_id, r.similar_doc_id) for r in got}
    assert len(pairs) == len(got) == 9 * len(pdf)
    assert len(pairs & exact) / len(exact) >= 0.95
