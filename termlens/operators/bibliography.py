"""De-duplicated bibliography and snippet -> bibliography map.

Key of a row, first that applies: DOI, document id, ``title::year`` (when the
fallback is on and both exist, year != 0), else ``row-<snippet_row>``.  Key
kinds are kept apart (the same string as a DOI and as a document id gives two
records).  A ``row-`` key is mapped but gets no record.  The record of a key is
built from its first row in snippet order.

Plan: one projection computes (key_kind, bibjson_id) per row; the map is that
projection; the records are one aggregation ``min_by(row, snippet_row)`` per
key — partial aggregation on the map side, so a key holding a third of all
rows costs one small partial result per task, not a sort of its rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.constants import BIBJSON_GENERATOR, BIBJSON_VERSION, DEFAULT_COLLECTION
from termlens.functions.biblio import author_names, clean, key_year, nanify, optional, parse_year

ROW = "snippet_row"


def with_keys(rows: DataFrame, title_year_fallback: bool = True) -> DataFrame:
    """Adds key_kind and bibjson_id.  The cleaned key fields are computed once
    as columns (kept apart from the key expressions so each regex chain runs
    once per row and the generated code stays small)."""
    keyed = rows.select(
        "*", clean(optional(rows, "doi")).alias("_doi"), clean(optional(rows, "doc_id")).alias("_doc"),
        clean(optional(rows, "title")).alias("_title"),
        key_year(optional(rows, "pub_year"), optional(rows, "year"), optional(rows, "coverDate")).alias("_year"))
    doi, doc, title, year = F.col("_doi"), F.col("_doc"), F.col("_title"), F.col("_year")
    ty_ok = F.lit(bool(title_year_fallback)) & title.isNotNull() & year.isNotNull() & (year != 0)
    kind = (F.when(doi.isNotNull(), "doi").when(doc.isNotNull(), "doc_id")
            .when(ty_ok, "title_year").otherwise("row"))
    bib_id = (F.when(doi.isNotNull(), doi).when(doc.isNotNull(), doc)
              .when(ty_ok, F.concat(title, F.lit("::"), year.cast("string")))
              .otherwise(F.concat(F.lit("row-"), F.col(ROW).cast("string"))))
    return keyed.select(*rows.columns, kind.alias("key_kind"), bib_id.alias("bibjson_id"))


def bib_map(rows: DataFrame, title_year_fallback: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """snippet_row, bibjson_id (after the collection's columns ``by``)."""
    return with_keys(rows, title_year_fallback).select(*by, ROW, "bibjson_id")


def _first_rows(rows: DataFrame, title_year_fallback: bool, by: Sequence[str]) -> DataFrame:
    k = with_keys(rows, title_year_fallback).where(F.col("key_kind") != "row")
    keys = [*by, "key_kind", "bibjson_id"]
    first = k.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in k.columns if c not in keys]), F.col(ROW)).alias("_r"))
    return first.select(*keys, "_r.*")


def bib_records(rows: DataFrame, title_year_fallback: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """One record per key: id, key_kind, type, title, author (array of
    struct<name>), year, journal, publisher, identifier, link.  With ``by``
    (such as the search term) every value has a collection of its own."""
    r = _first_rows(rows, title_year_fallback, by)
    doi, url = clean(optional(r, "doi")), F.coalesce(clean(optional(r, "url")), clean(optional(r, "landing_page")))
    lower = {c.lower(): c for c in r.columns}
    author = F.array().cast("array<string>")
    for c in [lower[x] for x in ("author", "authors") if x in lower]:       # authors go first, row by row
        author = F.when(F.size(author_names(r, c)) > 0, author_names(r, c)).otherwise(author)
    return r.select(
        *by, F.col("bibjson_id").alias("id"), "key_kind",
        F.coalesce(nanify(optional(r, "type")), F.lit("article")).alias("type"),
        F.coalesce(clean(optional(r, "title")), F.lit("")).alias("title"),
        F.transform(author, lambda n: F.struct(n.alias("name"))).alias("author"),
        parse_year(optional(r, "pub_year"), optional(r, "year"), optional(r, "coverDate")).alias("year"),
        F.coalesce(clean(optional(r, "journal")), clean(optional(r, "source"))).alias("journal"),
        clean(optional(r, "publisher")).alias("publisher"),
        F.when(doi.isNotNull(), F.array(F.struct(F.lit("doi").alias("type"), doi.alias("id"))))
        .otherwise(F.array().cast("array<struct<type:string,id:string>>")).alias("identifier"),
        F.when(url.isNotNull(), F.array(F.struct(url.alias("url"), F.lit("text/html").alias("content_type"))))
        .alias("link"),
    )


def bib_records_flat(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scalar view of the records (for tables and checks)."""
    return records.select(
        *by, "id", "key_kind", "type", "title", "year", "journal", "publisher",
        F.array_join(F.col("author.name"), " | ").alias("author_names"),
        F.size("author").alias("n_authors"),
        F.try_element_at(F.col("identifier"), F.lit(1))["id"].alias("doi"),
        F.try_element_at(F.col("link"), F.lit(1))["url"].alias("url"))


def bib_json_lines(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """id, record_json: each record as one JSON object (null fields kept)."""
    rec = F.struct("id", "type", "title", "author", "year", "journal", "publisher", "identifier", "link")
    return records.select(*by, "id", F.to_json(rec, {"ignoreNullFields": "false"}).alias("record_json"))


def collection_header(collection: Column, created: str | None = None) -> Column:
    """The collection header as one JSON object."""
    metadata = F.struct(F.lit(created or now()).alias("created"), F.lit(BIBJSON_GENERATOR).alias("generator"),
                        F.lit(BIBJSON_VERSION).alias("version"))
    return F.to_json(F.struct(collection.alias("collection"), metadata.alias("metadata")))


def now() -> str:
    """Creation stamp (UTC)."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def write_bibjson(records: DataFrame, out_dir: str, collection: str | None = None,
                  created: str | None = None) -> None:
    """BibJSON collection as JSON Lines records plus a small header file.
    Records are written by the executors; the driver writes only the header
    (collection, metadata), never the records."""
    collection = collection or DEFAULT_COLLECTION
    bib_json_lines(records).select("record_json").write.mode("overwrite").text(os.path.join(out_dir, "records"))
    header = {"collection": collection,
              "metadata": {"created": created or now(), "generator": BIBJSON_GENERATOR, "version": BIBJSON_VERSION}}
    spark = records.sparkSession
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(out_dir, "collection"))
