"""Dense per-group row index against row_number()."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from termlens.operators.rowindex import dense_index


def test_dense_index_matches_row_number(spark):
    rows = [("a" if i % 3 else "b", i // 7, i % 7) for i in range(500)] + [("c", 1, 1)]
    df = spark.createDataFrame(rows, "g string, d long, f long")
    got = sorted(tuple(r) for r in dense_index(df, ["g"], ["d", "f"], "idx", partitions=5).collect())
    w = Window.partitionBy("g").orderBy("d", "f")
    want = sorted(tuple(r) for r in df.withColumn("idx", F.row_number().over(w) - 1).collect())
    assert got == want
