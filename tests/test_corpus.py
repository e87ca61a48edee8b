"""Corpus summary (FIXTURES 3.5) and TF-IDF (3.6)."""
import math

from termlens.operators.cooccurrence import cooccurrence_stats
from termlens.operators.corpus import corpus_summary, doc_snippet_text, term_counts, tfidf


def test_corpus_summary(spark):
    snips = spark.createDataFrame(
        [("volcanic arc", "x", "p", "volcanic arcs basalt basalts zircon"),
         ("volcanic arc", "x", None, "basalt zircon rock rocks rocks"),
         ("volcanic arc", None, None, "arc basalt ab zircon")],
        "search_term string, doi string, publisher string, processed_text string")
    co = cooccurrence_stats(snips, 10, n=10, lemmatize=False)
    r = corpus_summary(snips, co, doc_col="doi").collect()[0]
    assert (r.total_snippets, r.total_documents, r.total_tokens, r.unique_terms, r.unique_publishers) == (
        3, 1, 11, 4, 1)


def test_tfidf(spark):
    s = spark.createDataFrame(
        [("granite", "doc1", "granite rock"), ("granite", "doc1", "granite formation"),
         ("granite", "doc2", "granite contains feldspar")],
        "search_term string, _gddid string, highlight string")
    got = {r._gddid: r for r in tfidf(s, 100000, doc_col="_gddid").collect()}
    idf = math.log(100000 / 3)
    assert abs(idf - 10.41431317630212) < 1e-12
    assert math.isclose(got["doc1"].tfidf, 0.004814754126815589, rel_tol=1e-12)
    assert math.isclose(got["doc2"].tfidf, 0.0024073770634077947, rel_tol=1e-12)


def test_term_counts_and_snippet_text(spark):
    s = spark.createDataFrame([("Granite", 1, 2, "b"), ("Granite", 1, 0, "a"), ("Granite", 2, 5, "c")],
                              "search_term string, doc_id long, frag_idx int, highlight string")
    tc = term_counts(s, 10).collect()[0]
    assert (tc.word, tc["count"], tc.probability) == ("granite", 3, 3 / 43260)
    texts = {r.doc_id: r.text for r in doc_snippet_text(s).collect()}
    assert texts == {1: "a b", 2: "c"}


def test_vector_space_shape(spark):
    from termlens.operators.corpus import doc_vectors, vector_space_shape

    t = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.2), ("a", 2, 0.1)],
                              "search_term string, doc_id long, tfidf double")
    v = doc_vectors(t)
    assert sorted((r.doc_id, r.terms) for r in v.collect()) == [(1, ["a", "b"]), (2, ["a"])]
    assert vector_space_shape(v) == (2, 2)
