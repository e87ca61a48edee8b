"""Readers and writers for raw search responses, snippet tables and results.

* Raw responses: JSON pages ``{"success": {"data": [doc, ...], "next_page": ..}}``
  parsed as semi-structured values: known fields are typed, all others kept in
  one column, and pages that are no such JSON are set aside with path and reason.
  Documents are exploded to rows, then one row per highlight (empty lists drop out).
* Snippet tables: Parquet (native) or CSV with every field quoted and ``"`` as
  the escape on both sides, always with an explicit schema (never inference);
  the all-string variant is the bibliography reader's view.
* Source column names are mapped once to the canonical ones
  (``_gddid`` -> ``doc_id``, ``pubname`` -> ``journal``, ``URL`` -> ``url``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.functions.biblio import split_authors
from termlens.functions.text import preprocess_text

S = T.StringType()

# Fields of a response document that later stages read; all others are kept together in ``extra``.
RAW_FIELDS = ("_gddid", "doi", "title", "pubname", "publisher", "coverDate", "URL", "authors",
              "pub_year", "year", "type", "source", "landing_page")
AUTHOR = "array<struct<name string, given string, family string>>"

SNIPPET = T.StructType([
    T.StructField("search_term", S), T.StructField("doc_id", S), T.StructField("frag_idx", T.IntegerType()),
    T.StructField("doi", S), T.StructField("title", S), T.StructField("journal", S),
    T.StructField("publisher", S), T.StructField("coverDate", S), T.StructField("url", S),
    T.StructField("authors", S), T.StructField("highlight", S), T.StructField("processed_text", S),
])

CANONICAL = {"_gddid": "doc_id", "pubname": "journal", "url": "url"}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename source columns to the canonical names (case-insensitive)."""
    out = df
    for c in df.columns:
        new = CANONICAL.get(c.lower())
        if new and c != new:
            out = out.withColumnRenamed(c, new)
    return out


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the response files, each as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _parsed(pages: DataFrame) -> DataFrame:
    page = F.try_parse_json("value")
    return pages.select("path", page.alias("page"), F.try_variant_get(page, "$.success.data", "array<variant>").alias("data"))


def rejected_pages(pages: DataFrame) -> DataFrame:
    """(path, reason) of the pages (``path``, ``value``) that give no documents: not JSON, or without ``success.data``."""
    reason = F.when(F.col("page").isNull(), "not JSON").otherwise("no list success.data")
    return _parsed(pages).where("data IS NULL").select("path", reason.alias("reason"))


def page_documents(pages: DataFrame) -> DataFrame:
    """One row per document of the pages: the known fields by their canonical names (as text, whatever their JSON type;
    ``author`` as a list of name structs), ``highlight`` and ``extra``, a JSON object of all other fields."""
    d = _parsed(pages).select("path", F.explode("data").alias("d")).where(F.schema_of_variant("d").startswith("OBJECT"))
    known = [F.try_variant_get("d", f"$.{f}", "string").alias(f) for f in RAW_FIELDS]
    name = "transform({}, n -> named_struct('name', n, 'given', CAST(NULL AS STRING), 'family', CAST(NULL AS STRING)))"
    author = F.coalesce(
        F.when(F.schema_of_variant(F.try_variant_get("d", "$.author", "variant")).startswith("ARRAY<OBJECT"),
               F.try_variant_get("d", "$.author", AUTHOR)),
        F.expr(name.format("try_variant_get(d, '$.author', 'array<string>')")),
        F.transform(split_authors(F.try_variant_get("d", "$.author", "string")), lambda n: F.struct(
            n.alias("name"), F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"))))
    others = F.map_filter(F.try_variant_get("d", "$", "map<string,variant>"),
                          lambda k, v: ~k.isin(*RAW_FIELDS, "author", "highlight"))
    line = F.try_variant_get("d", "$.highlight", "string")
    lines = F.coalesce(F.try_variant_get("d", "$.highlight", "array<string>"), F.when(line.isNotNull(), F.array(line)))
    return canonical_columns(d.select("path", *known, author.alias("author"), lines.alias("highlight"),
                                      F.to_json(others).alias("extra")))


def read_api_responses(spark: SparkSession, path: str, search_term: str | None = None,
                       stop_words: Iterable[str] | None = None) -> DataFrame:
    """Snippet rows from raw response pages: one row per highlight, with the
    cleaned text and (optionally) the term the pages were fetched for.  Pages
    that can't be read give no row here; :func:`rejected_pages` names them."""
    docs = page_documents(raw_pages(spark, path)).drop("path")
    rows = docs.select(*[c for c in docs.columns if c != "highlight"],
                       F.posexplode("highlight").alias("frag_idx", "highlight"))
    rows = rows.withColumn("processed_text", preprocess_text("highlight", stop_words))
    if search_term is not None:
        rows = rows.withColumn("search_term", F.lit(search_term.lower()))
    return rows


def read_snippets_csv(spark: SparkSession, path: str, all_strings: bool = False,
                      schema: T.StructType = SNIPPET) -> DataFrame:
    """Snippet CSV (header, quoted fields, ``"`` escape, multi-line fields).

    Column names come from the header (one line is read); types come from
    ``schema`` by name, or all strings — never inferred from the data."""
    opts = {"header": True, "multiLine": True, "escape": '"'}
    names = spark.read.options(**opts).csv(path).columns
    known = {f.name.lower(): f.dataType for f in schema.fields}
    fields = [T.StructField(n, S if all_strings else known.get(n.lower(), S)) for n in names]
    return spark.read.schema(T.StructType(fields)).options(**opts).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists; any other failure (permissions, network) is raised."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_by_term(spark: SparkSession, path: str, term: str = "search_term") -> DataFrame:
    """A table partitioned by a term column, whose values stay strings
    (partition type inference would turn the term ``007`` into 7)."""
    schema = spark.read.parquet(path).schema
    fields = [T.StructField(term, S) if f.name == term else f for f in schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_snippets(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Snippet table partitioned by term.  Only the partitions of the terms in
    ``df`` are replaced (dynamic partition overwrite), so re-running a term is
    idempotent and other terms are untouched."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    w = df.write.mode("overwrite").partitionBy("search_term")
    if fmt == "csv":
        w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """A result table (co-occurrence, corpus summary, TF-IDF, map) as Parquet
    or a quoted CSV with a header.  With ``partition_by`` (the term column)
    only the partitions present in ``df`` are replaced."""
    w = df.write.mode("overwrite")
    if partition_by:
        df.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)
