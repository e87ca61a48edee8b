"""Readers for the driver tables and the corpus views built on them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet so filters and projections reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread the rows over all cores when the scan has fewer splits than the
    cluster has cores (a small file with one row group is read by one task).
    Decided on the driver from file metadata; a large input has many splits
    and is left alone, so this never adds a shuffle at scale.  With a key the
    rows are hash-partitioned on it (no sort needed; round-robin sorts first
    to stay deterministic on retry)."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (Spark Connect): leave the scan as it is
        return df
    if splits < cores:
        return df.repartition(cores, key) if key else df.repartition(cores)
    return df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the canonical corpus columns: doc_id, text, publisher, lang."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("publisher"), "lang")
    return spread(d, "doc_id")


HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as a corpus: markup removed (the extraction's ``clean``
    switch), the page id as doc_id, the host as publisher."""
    from termlens.functions.text import strip_html

    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    p = spread(p, "page_id")
    return p.select(F.col("page_id").alias("doc_id"), strip_html("html").alias("text"),
                    F.regexp_extract("url", HOST_PATTERN, 1).alias("publisher"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography input built from ``documents`` (one row per document), with
    every field kind the bibliography job handles: DOIs (some 'NaN'), document
    ids, titles with and without years, numeric and non-numeric years, cover
    dates, author strings, journals, publishers and links."""
    return table(spark, sf_dir, "documents").selectExpr(*CITATION_COLUMNS)


# Shared by Spark (selectExpr) and DuckDB (oracle): plain SQL expressions.
CITATION_COLUMNS = (
    "doc_id AS snippet_row",
    "CASE WHEN doc_id % 5 IN (0, 1, 2) THEN concat('10.5555/', CAST(doc_id % 97 AS STRING))"
    " WHEN doc_id % 5 = 4 AND doc_id % 3 = 0 THEN 'NaN' WHEN doc_id % 5 = 4 AND doc_id % 3 = 1 THEN ' ' END AS doi",
    "CASE WHEN doc_id % 5 = 3 THEN concat('d', CAST(doc_id % 41 AS STRING)) END AS doc_id",
    "CASE WHEN doc_id % 10 <> 9 THEN concat('Title ', CAST(doc_id % 13 AS STRING)) ELSE '' END AS title",
    "CASE WHEN doc_id % 4 = 0 THEN CAST(1990 + doc_id % 30 AS STRING)"
    " WHEN doc_id % 4 = 1 THEN '2001.0' END AS pub_year",
    "CASE WHEN doc_id % 4 IN (1, 2) AND doc_id % 8 <> 1 THEN concat(CAST(1980 + doc_id % 25 AS STRING), '-05-01') END AS coverdate",
    "concat('Smith, J.; Doe, A', CAST(doc_id % 7 AS STRING), ' and Roe, B.') AS authors",
    "source AS journal",
    "concat('pub-', lang) AS publisher",
    "CASE WHEN doc_id % 2 = 0 THEN concat('https://example.org/', CAST(doc_id AS STRING)) END AS url",
)


def citations_sql() -> str:
    return "SELECT " + ", ".join(CITATION_COLUMNS) + " FROM documents"
