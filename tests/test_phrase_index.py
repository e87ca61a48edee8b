"""Phrase index: sentence marks and wildcards inside terms, equality with the scan, no rescan for new terms."""
import os
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termlens.operators import phrase_index
from termlens.operators.phrase_index import PhraseIndex
from termlens.operators.snippets import extract_snippets
from termlens.sources.tables import corpus

TEXTS = [
    (1, "Rocks of the U.S. coast are old. They are 3.5 Ma, or 3,5 Ma old!"),
    (2, "Mt. Etna erupts.\nVolcanic arcs and volcanoes arcs. The volcanic\narcs end"),
    (3, None), (4, ""), (5, "coast"), (6, "U.S. coast. U.S. coast? Mt.\tEtna"), (7, "the coast of the coast of the coast"),
    (None, "an arc without id: 3.5 Ma."), (8, "wait... what?! Mt. Etna"), (8, "wait... what?! Mt. Etna"),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("lang", F.lit("en"))
    return PhraseIndex.build(docs, os.path.join(tempfile.mkdtemp(prefix="termlens-index-"), "i"), buckets=4)


def found(index, *terms, **kw):
    return sorted(((r.search_term, r.doc_id, r.frag_idx, r.highlight) for r in index.snippets(terms, **kw).collect()),
                  key=lambda r: (r[0], r[1] or 0, r[2]))


def test_marks_and_inner_wildcards(index):
    assert found(index, "3.5 ma") == [("3.5 ma", None, 0, "an arc without id: 3.5 Ma"),
                                      ("3.5 ma", 1, 2, "They are 3.5 Ma, or 3,5 Ma old")]
    assert found(index, "u.s. coast") == [("u.s. coast", 1, 0, "Rocks of the U.S. coast are old"),
                                          ("u.s. coast", 6, 0, "U.S. coast"), ("u.s. coast", 6, 2, "U.S. coast")]
    assert found(index, "Mt. Etna") == [("mt. etna", 2, 0, "Mt. Etna erupts"), ("mt. etna", 6, 4, "Mt.\tEtna"),
                                        ("mt. etna", 8, 2, "Mt. Etna")]
    assert found(index, "what") == [("what", 8, 1, "what"), ("what", 8, 1, "what")]
    assert found(index, "volc* arcs") == [("volc* arcs", 2, 2, "Volcanic arcs and volcanoes arcs")]
    assert found(index, "volc* ar* an*", "v* arcs", "etna mt", "mt etna", "no such") == [
        ("v* arcs", 2, 2, "Volcanic arcs and volcanoes arcs"), ("volc* ar* an*", 2, 2, "Volcanic arcs and volcanoes arcs")]


def test_repeated_words_and_limit(index):
    assert [r[1:3] for r in found(index, "coast of the coast")] == [(7, 0)]
    assert [r[1:3] for r in found(index, "coast", fragment_limit=1)] == [(1, 1), (5, 0), (6, 1), (7, 0)]


def test_wildcards_need_letters(index):
    with pytest.raises(ValueError, match="wildcard"):
        index.snippets(["vo*"])
    docs = index.spark.createDataFrame(TEXTS, "doc_id long, text string")
    for term in ("volc* arcs", "mt. etna"):
        for terms in ([term], index.spark.createDataFrame([(term,)], "t string")):
            with pytest.raises(ValueError, match="phrase index"):
                extract_snippets(docs, terms)
    assert sorted(r.doc_id or 0 for r in extract_snippets(docs, ["3.5 ma"]).collect()) == [0, 1]


def test_equals_the_scan_and_reads_no_document(spark):
    docs = corpus(spark, "/root/testdata/sf0.001")
    index = PhraseIndex.build(docs, os.path.join(tempfile.mkdtemp(prefix="termlens-index-"), "i"), buckets=8)
    terms = ["of the", "thing", "nich*", "of th*", "example.com", "anea"]
    for given in (terms, spark.createDataFrame([(t,) for t in terms], "t string")):
        got = index.snippets(given)
        want = extract_snippets(docs, terms)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert not [f for f in got.inputFiles() if "testdata" in f] and got.inputFiles()


def test_only_the_words_buckets_are_read(spark, index):
    words = index.term_words(["volc* arcs"])
    plan = index.occurrences(words)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("`", "") or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "In(word" in plan or "EqualTo(word" in plan


def test_a_word_has_one_row_a_block(spark, monkeypatch):
    """Blocks hold whole documents; a longer one is a block of its own."""
    words = [[["a", "b"], [], ["a"]], [], [["b"] * 5], [["c"]], [[]]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None, 4, 5]), pa.array(words, pa.list_(pa.list_(pa.string())))], ["doc", "words"])
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", 4)
    got = [r for b in phrase_index._postings(iter([batch])) for r in b.to_pylist()]
    assert got == [
        {"word": "a", "n": 2, "doc": [1, 1], "pos": [0, 2], "frag": [0, 2]}, {"word": "b", "n": 1, "doc": [1], "pos": [1], "frag": [0]},
        {"word": "b", "n": 5, "doc": [None] * 5, "pos": [0, 1, 2, 3, 4], "frag": [0] * 5},
        {"word": "c", "n": 1, "doc": [4], "pos": [0], "frag": [0]}]
    docs = spark.range(300).selectExpr("cast(id as string) doc_id", "'the coast of the coast. the end' text").coalesce(1)
    index = PhraseIndex.build(docs, os.path.join(tempfile.mkdtemp(prefix="termlens-index-"), "i"), buckets=2)
    assert sorted(map(tuple, index._table("postings").select("word", "n").collect())) == [
        ("coast", 600), ("end", 300), ("of", 300), ("the", 900)]
    assert index.snippets(["the coast. the", "the coast"]).groupBy("search_term", "highlight").count().sort("search_term").collect() == [
        ("the coast", "the coast of the coast", 300), ("the coast. the", "the coast of the coast. the end", 300)]
