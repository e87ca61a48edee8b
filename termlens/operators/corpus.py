"""Per-term corpus summaries, term counts, TF-IDF and document vectors.

All of them are aggregations keyed by the search term (and document): partial
aggregation on the map side, one exchange on the key.  Group contents are never
collected except the per-(term, document) snippet list, which is bounded by
the fragment limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.constants import TOKENS_PER_DOCUMENT
from termlens.session import cut_lineage

TERM = "search_term"


def corpus_summary(snippets: DataFrame, cooccurrence: DataFrame, doc_col: str = "doc_id",
                   publisher_col: str = "publisher") -> DataFrame:
    """search_term, total_snippets, total_documents (distinct, nulls ignored),
    total_tokens (sum of kept co-occurrence counts + snippets), unique_terms
    (distinct co-occurring words + 1), unique_publishers (distinct, nulls
    ignored)."""
    s = snippets.groupBy(TERM).agg(
        F.count(F.lit(1)).alias("total_snippets"),
        F.count_distinct(doc_col).alias("total_documents"),
        F.count_distinct(publisher_col).alias("unique_publishers"))
    return _summary(s, cooccurrence)


def corpus_summary_of_state(documents: DataFrame, publishers: DataFrame, cooccurrence: DataFrame, doc_col: str = "doc_id",
                            publisher_col: str = "publisher") -> DataFrame:
    """:func:`corpus_summary` from stored numbers of snippets (``n``) per (term, document) and per (term, publisher)."""
    d = documents.groupBy(TERM).agg(F.sum("n").alias("total_snippets"), F.count(doc_col).alias("total_documents"))
    p = publishers.groupBy(TERM).agg(F.count(publisher_col).alias("unique_publishers"))
    return _summary(d.join(p, TERM), cooccurrence)


def _summary(s: DataFrame, cooccurrence: DataFrame) -> DataFrame:
    c = cooccurrence.groupBy(F.col("word_1").alias(TERM)).agg(
        F.sum("count").alias("_tok"), F.count_distinct("word_2").alias("_uniq"))
    j = s.join(c, TERM, "left")
    return j.select(
        TERM, "total_snippets", "total_documents",
        (F.coalesce("_tok", F.lit(0)) + F.col("total_snippets")).cast("long").alias("total_tokens"),
        (F.coalesce("_uniq", F.lit(0)) + 1).cast("long").alias("unique_terms"),
        "unique_publishers")


def term_counts(snippets: DataFrame, total_docs: int) -> DataFrame:
    """word (the term), count (snippet rows), probability."""
    denom = float(total_docs) * TOKENS_PER_DOCUMENT
    return (snippets.groupBy(F.lower(F.col(TERM)).alias("word"))
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("probability", F.col("count") / F.lit(denom)))


def extraction_profile(snippets: DataFrame, journal_col: str = "journal",
                       authors_col: str = "authors") -> DataFrame:
    """Per term: snippet rows, distinct journals, distinct author strings."""
    return snippets.groupBy(TERM).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count_distinct(journal_col).alias("unique_journals"),
        F.count_distinct(authors_col).alias("unique_authors"))


def tfidf(snippets: DataFrame, total_docs: int, doc_col: str = "doc_id") -> DataFrame:
    """search_term, doc, num_snippets, tf, tfidf.

    tf = snippets of the document / TOKENS_PER_DOCUMENT; one idf per term:
    ln(total_docs / (1 + documents of the term)).  The document frequency is a
    second, tiny aggregation joined back on the term (no window over a term,
    which would put a whole term into one task)."""
    per_doc = cut_lineage(snippets.where(F.col(doc_col).isNotNull())
                          .groupBy(TERM, doc_col).agg(F.count(F.lit(1)).alias("num_snippets")))
    df_ = per_doc.groupBy(TERM).agg(F.count(F.lit(1)).alias("_df"))
    # one row per search term: bounded by the term list, whose size the
    # extraction checked; broadcasting it keeps a hot term off one reducer
    j = per_doc.join(F.broadcast(df_), TERM)
    idf = F.log(F.lit(float(total_docs)) / (F.col("_df") + 1))
    tf = F.col("num_snippets") / F.lit(float(TOKENS_PER_DOCUMENT))
    return j.select(TERM, doc_col, "num_snippets", tf.alias("tf"), (tf * idf).alias("tfidf"))


def doc_snippet_text(snippets: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """search_term, doc, text = the document's snippets joined by a space in
    fragment order.  One group holds at most ``fragment_limit`` snippets."""
    g = snippets.groupBy(TERM, doc_col).agg(
        F.array_sort(F.collect_list(F.struct("frag_idx", "highlight"))).alias("_s"))
    return g.select(TERM, doc_col, F.array_join(F.col("_s.highlight"), " ").alias("text"))


def doc_vectors(tfidf_rows: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Sparse document x term vectors: doc, terms (sorted), weights (tf-idf).
    A group holds one entry per search term."""
    g = tfidf_rows.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct(TERM, "tfidf"))).alias("_v"))
    return g.select(doc_col, F.col("_v." + TERM).alias("terms"), F.col("_v.tfidf").alias("weights"))


def vector_space_shape(vectors: DataFrame) -> tuple[int, int]:
    """(documents, features) of a document-vector table: two scalars from
    one aggregate (the number of distinct terms across all vectors)."""
    r = vectors.select("doc_id", F.explode("terms").alias("_t")).agg(
        F.count_distinct("doc_id").alias("rows"), F.count_distinct("_t").alias("features")).first()
    return int(r["rows"]), int(r["features"])
