"""Plan and property checks over every registered query (sf0.001)."""
import pytest
from pyspark.sql import functions as F

from termlens.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
PYTHON_OK = {"similarity_forest", "similarity_pending", "similarity_upsert", "similarity_knn", "similarity_lsh", "text_similarity",
             "joint_entropy_words"}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cross_join_no_python_row_udf(spark, name):
    df = REGISTRY[name].run(spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"
    if name not in PYTHON_OK:
        assert "ArrowEvalPython" not in plan and "FlatMapGroupsInPandas" not in plan and "MapInPandas" not in plan


def test_mutual_information_is_non_negative(spark):
    mi = REGISTRY["mutual_information"].run(spark, SF)
    assert mi.agg(F.min("mutual_information")).first()[0] >= -1e-12
    assert mi.where(F.col("n11") > F.least("n_term", "n_word")).count() == 0


def test_forest_similarities_are_exact(spark):
    import numpy as np

    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.stack(e.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    idx = {v: i for i, v in enumerate(e.vec_id)}
    got = REGISTRY["similarity_forest"].run(spark, SF).collect()
    for r in got[:500]:
        cos = float(np.clip(x[idx[r.doc_id]] @ x[idx[r.similar_doc_id]], -1, 1))
        assert abs(r.similarity - (1 - np.sqrt(max(0.0, 2 - 2 * cos)))) < 1e-9


def test_small_top_n_limits_before_shuffle(spark):
    from termlens.operators import network as nw
    from termlens.plans import queries as q

    df = nw.network_edges(q.cooc(spark, SF), top_m=50)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
