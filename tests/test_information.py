"""Entropy, mutual information, PMI (FIXTURES 3.10)."""
import collections
import itertools
import random

from termlens.operators import information
from termlens.operators.information import pair_information, pmi, word_entropy, word_pair_information


def presence(spark, docs):
    return spark.createDataFrame([(i, w) for i, ws in enumerate(docs) for w in ws], "doc_id long, word string")


def info(spark, docs):
    p = presence(spark, docs)
    td = p.where("word = 'x'").selectExpr("'x' AS search_term", "doc_id")
    return {r.word: r for r in pair_information(td, p, len(docs)).collect()}


def test_dependent_pair(spark):
    docs = [{"x", "y"}, {"x", "y"}, {"z"}, {"z"}]
    ent = {r.word: r.entropy for r in word_entropy(presence(spark, docs), 4).collect()}
    assert ent["x"] == 1.0
    y = info(spark, docs)["y"]
    assert (y.joint_entropy, y.mutual_information) == (1.0, 1.0)


def test_independent_pair(spark):
    y = info(spark, [{"x", "y"}, {"x"}, {"y"}, {"z"}])["y"]
    assert (y.joint_entropy, y.mutual_information) == (2.0, 0.0)


def test_pmi(spark):
    co = spark.createDataFrame([("x", "y", 1, 0.5)], "word_1 string, word_2 string, count long, prob_w1w2 double")
    tc = spark.createDataFrame([("x", 2, 0.5), ("y", 2, 0.5)], "word string, count long, probability double")
    assert pmi(co, tc).first().pmi == 1.0


def test_network_neighbourhood_and_lexicon(spark):
    from termlens.operators.network import network_edges, network_nodes

    co = spark.createDataFrame([("t", "a", 5, 0.5), ("t", "b", 1, 0.1), ("u", "a", 2, 0.2)],
                               "word_1 string, word_2 string, count long, prob_w1w2 double")
    e = network_edges(co, min_prob=0.15, terms=["T "])
    assert [tuple(r) for r in e.collect()] == [("t", "a", 5, 0.5)]
    lex = spark.createDataFrame([("a", "mineral")], "word string, type string")
    nodes = {r.node: (r.degree, r.strength, r.type) for r in network_nodes(network_edges(co), lex).collect()}
    assert nodes == {"t": (2, 6, "term"), "u": (1, 2, "term"), "a": (2, 7, "mineral"), "b": (1, 1, "word")}


def test_word_pairs_from_bitmaps(spark, monkeypatch):
    """Joint counts against pairs made one by one, with chunks that fill up several times."""
    monkeypatch.setattr(information, "CHUNK_DOCS", 16)
    rnd = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in "kmp"]
    docs = [" ".join(rnd.choices(vocab, weights=range(1, len(vocab) + 1), k=rnd.randrange(0, 25))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    held = [set((t or "").split()) for t in docs]
    count = collections.Counter(w for h in held for w in h)
    top = sorted(sorted(count, key=lambda w: (-count[w], w))[:20])
    want = {p: sum(set(p) <= h for h in held) for p in itertools.combinations(top, 2)}
    got = {(r.word_1, r.word_2): r for r in word_pair_information(df, len(docs), 20).collect()}
    assert {p: r.n11 for p, r in got.items()} == {p: n for p, n in want.items() if n}
    for r in got.values():
        assert (r.n_1, r.n_2) == (count[r.word_1], count[r.word_2]) and r.mutual_information >= -1e-9
    assert word_pair_information(df.limit(0), 0, 20).count() == 0


def test_one_pass_equals_the_join(spark):
    from pyspark.sql import functions as F

    from termlens.operators.information import doc_words, document_information
    from termlens.operators.snippets import extract_snippets, matched_terms

    terms = ["of the", "thing", "nich*", "2.0", "absent"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "One of. The thing\n2.0, nichts"), (-2, None), (-3, "of\nthe  of - the")], docs.schema))
    want = extract_snippets(docs, terms).select("search_term", "doc_id").distinct()
    got = docs.select(F.explode(matched_terms("text", terms)).alias("search_term"), "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    a = document_information(docs, matched_terms("text", terms), docs.count())
    b = pair_information(want, doc_words(docs), docs.count())
    assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
