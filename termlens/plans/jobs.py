"""End-to-end runs: extraction -> statistics -> load, for many terms at once.

The published workflow loops over terms one by one and keeps per-term files;
here every stage is one Spark job over all pending terms:

1. **extract** — terms whose snippets already exist are skipped (left-anti
   against the partition values of the snippet table) unless ``overwrite``;
   the rest are extracted from the corpus and written partitioned by term
   (dynamic partition overwrite: re-running a term replaces only its data).
2. **bibliography** — per term a collection of de-duplicated records, its
   header and the snippet map.
3. **statistics** — co-occurrence, corpus summary and TF-IDF of the pending
   terms, read back from the snippet table with partition pruning.
4. **load** — terms already in the ``processed_terms`` ledger are skipped
   unless ``skip_processed`` is off; counts and co-occurrence rows are
   upserted and the terms added to the ledger in one commit, so a failed run
   leaves the tables as they were and can simply be repeated.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.constants import DEFAULT_FRAGMENT_LIMIT, DEFAULT_TOP_N
from termlens.operators import bibliography as bib
from termlens.operators.cooccurrence import cooccurrence_stats
from termlens.operators.corpus import corpus_summary, term_counts, tfidf
from termlens.operators.rowindex import dense_index
from termlens.operators.snippets import extract_snippets, terms_frame, with_processed_text
from termlens.operators.store import TableStore, clean_stats
from termlens.session import cut_lineage
from termlens.sources.snippets_io import path_exists, read_by_term, write_result, write_snippets


@dataclass
class Layout:
    root: str

    @property
    def snippets(self) -> str:
        return os.path.join(self.root, "snippets")

    def result(self, name: str) -> str:
        return os.path.join(self.root, "results", name)

    @property
    def store(self) -> str:
        return os.path.join(self.root, "tables")


def _pending(spark: SparkSession, terms: Iterable[str], path: str, column: str = "search_term") -> list[str]:
    """The terms that the term-partitioned table at ``path`` does not hold yet."""
    wanted = terms_frame(spark, list(terms)).select("search_term")
    if path_exists(spark, path):
        done = read_by_term(spark, path, column).select(F.col(column).alias("search_term")).distinct()
        wanted = wanted.join(done, "search_term", "left_anti")
    return sorted(r.search_term for r in wanted.collect())  # the term list: user input, small


def extract(spark: SparkSession, docs: DataFrame, terms: Iterable[str], layout: Layout,
            fragment_limit: int | None = DEFAULT_FRAGMENT_LIMIT, overwrite: bool = False) -> list[str]:
    """Extract and store snippets of the pending terms; returns those terms."""
    todo = (sorted(r.search_term for r in terms_frame(spark, list(terms)).select("search_term").collect()) if overwrite
            else _pending(spark, terms, layout.snippets))
    if todo:
        snips = with_processed_text(extract_snippets(docs, todo, fragment_limit))
        write_snippets(snips, layout.snippets)
    return todo


def bibliography(spark: SparkSession, terms: list[str], layout: Layout) -> None:
    """Snippet map, BibJSON records and collection header of each term."""
    if not terms or not path_exists(spark, layout.snippets):
        return
    by = ["search_term"]
    snips = read_by_term(spark, layout.snippets).where(F.col("search_term").isin(terms))
    rows = cut_lineage(dense_index(snips.drop("highlight", "processed_text"), by, ["doc_id", "frag_idx"], bib.ROW))
    records = bib.bib_json_lines(bib.bib_records(rows, by=by), by)
    headers = rows.select(*by).distinct().withColumn("header_json", bib.collection_header(F.col("search_term")))
    write_result(records, layout.result("bibjson"), partition_by="search_term")
    write_result(headers, layout.result("bib_collections"), partition_by="search_term")
    write_result(bib.bib_map(rows, by=by), layout.result("bib_map"), partition_by="search_term")


def statistics(spark: SparkSession, terms: list[str], layout: Layout, total_docs: int,
               n: int = DEFAULT_TOP_N, lemmatize: bool = True) -> None:
    """Co-occurrence, corpus summary and TF-IDF for ``terms``."""
    if not terms or not path_exists(spark, layout.snippets):
        return
    snips = read_by_term(spark, layout.snippets).where(F.col("search_term").isin(terms))
    co = cut_lineage(cooccurrence_stats(snips, total_docs, n, lemmatize))
    write_result(co, layout.result("cooccurrence"), partition_by="word_1")
    write_result(corpus_summary(snips, co), layout.result("corpus_stats"), partition_by="search_term")
    write_result(tfidf(snips, total_docs), layout.result("tfidf"), partition_by="search_term")


def load(spark: SparkSession, terms: list[str], layout: Layout, total_docs: int,
         skip_processed: bool = True) -> list[str]:
    """Upsert counts and co-occurrence of ``terms`` into the tables and add
    them to the ledger; returns the terms loaded."""
    store = TableStore(spark, layout.store)
    todo = list(terms)
    if skip_processed and store.exists("processed_terms"):
        done = {r.term for r in store.read("processed_terms").where(F.col("term").isin(todo)).collect()}
        todo = [t for t in todo if t not in done]
    if not todo or not path_exists(spark, layout.snippets):
        return []
    snips = read_by_term(spark, layout.snippets).where(F.col("search_term").isin(todo))
    co = read_by_term(spark, layout.result("cooccurrence"), "word_1").where(F.col("word_1").isin(todo))
    with store.change() as c:
        c.merge("term_counts", term_counts(snips, total_docs))
        c.merge("term_cooccurrence", clean_stats(co))
        c.add_terms(todo)
    return todo


def process_terms(spark: SparkSession, docs: DataFrame, terms: Iterable[str], root: str, total_docs: int,
                  n: int = DEFAULT_TOP_N, fragment_limit: int | None = DEFAULT_FRAGMENT_LIMIT,
                  overwrite: bool = False, skip_processed: bool = True, lemmatize: bool = True) -> list[str]:
    """All stages for ``terms``; returns the terms newly loaded.  Each
    stage asks its own output which terms are left, so a run that broke off is
    repeated from where it stopped."""
    layout, terms = Layout(root), list(terms)
    fresh = extract(spark, docs, terms, layout, fragment_limit, overwrite)
    # terms without any snippet have no partition and count as done by every stage
    left = _pending(spark, terms, layout.result("bib_map"))
    bibliography(spark, sorted({*left, *fresh}), layout)
    left = _pending(spark, terms, layout.result("corpus_stats"))
    statistics(spark, sorted({*left, *fresh}), layout, total_docs, n, lemmatize)
    wanted = [r.search_term for r in terms_frame(spark, terms).select("search_term").collect()]
    again = set(fresh) if overwrite else set()
    done = load(spark, [t for t in wanted if t not in again], layout, total_docs, skip_processed)
    return sorted([*done, *(load(spark, sorted(again), layout, total_docs, False) if again else [])])
