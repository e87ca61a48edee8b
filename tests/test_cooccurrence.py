"""Co-occurrence statistics (FIXTURES 3.4) and plan shape."""
from pyspark.sql import functions as F

from termlens.operators.cooccurrence import cooccurrence_stats
from termlens.operators.snippets import extract_snippets

ROWS = ["volcanic arcs basalt basalts zircon", "basalt zircon rock rocks rocks", "arc basalt ab zircon"]


def snip(spark):
    return spark.createDataFrame([("volcanic arc", t) for t in ROWS], "search_term string, processed_text string")


def result(df):
    return sorted((r.word_2, r["count"]) for r in df.collect())


def test_surface_counts_and_stem_dedup(spark):
    got = cooccurrence_stats(snip(spark), total_docs=10, n=10, lemmatize=False)
    assert result(got) == [("basalt", 3), ("rocks", 2), ("zircon", 3)]
    probs = {r.word_2: r.prob_w1w2 for r in got.collect()}
    assert probs["basalt"] == 3 / 43260
    assert {r.word_1 for r in got.collect()} == {"volcanic arc"}


def test_top_n_before_dedup(spark):
    assert result(cooccurrence_stats(snip(spark), 10, n=3, lemmatize=False)) == [
        ("basalt", 3), ("rocks", 2), ("zircon", 3)]
    # n = 4: the tie basalts/rock at 1 goes to 'basalts' (word ascending),
    # which the stem de-duplication then drops in favour of 'basalt'.
    assert result(cooccurrence_stats(snip(spark), 10, n=4, lemmatize=False)) == [
        ("basalt", 3), ("rocks", 2), ("zircon", 3)]
    assert result(cooccurrence_stats(snip(spark), 10, n=1, lemmatize=False)) == [("basalt", 3)]


def test_lemma_fold_first(spark):
    assert result(cooccurrence_stats(snip(spark), 10, n=10, lemmatize=True)) == [
        ("basalt", 4), ("rock", 3), ("zircon", 3)]


def test_dedup_never_adds_counts(spark):
    before = cooccurrence_stats(snip(spark), 10, n=10, lemmatize=False).agg(F.sum("count")).first()[0]
    assert before <= 3 + 1 + 3 + 1 + 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_plan_is_equi_join_without_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = extract_snippets(docs, ["of the", "thing", "thble*"])
    s.count()
    plan = _plan(s)
    assert "BroadcastHashJoin" in plan
    for bad in ("NestedLoop", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_wildcard_and_fragment_limit(spark):
    docs = spark.createDataFrame(
        [(1, "Basalts here. A basaltic dyke! Nothing.\nbasalt again"), (2, "no match; bas is too short")],
        "doc_id long, text string")
    rows = extract_snippets(docs, ["basalt*"]).orderBy("frag_idx").collect()
    assert [r.frag_idx for r in rows] == [0, 1, 3]
    limited = extract_snippets(docs, ["basalt*"], fragment_limit=2).collect()
    assert sorted(r.frag_idx for r in limited) == [0, 1]
    exact = extract_snippets(docs, ["Basalt"]).collect()
    assert [r.frag_idx for r in exact] == [3]


def test_top_n_boundary_split_matches_plain_ranking(spark):
    """A large tie group at rank n is cut by word prefix; the kept rows must
    equal a plain (score desc, word asc) ranking."""
    import random

    from pyspark.sql import Window

    from termlens.operators.cooccurrence import top_n_per_key

    random.seed(7)
    words = sorted({"".join(random.choice("abcd") for _ in range(random.randint(1, 7))) for _ in range(3000)})
    rows = [("t", w, 1 if i % 4 else 2) for i, w in enumerate(words)] + [("u", w, 1) for w in words[:50]]
    df = spark.createDataFrame(rows, "search_term string, word string, count long")
    n = 900
    got = sorted(tuple(r) for r in top_n_per_key(df, n, sort_max=40, window_max=0).collect())
    w = Window.partitionBy("search_term").orderBy(F.col("count").desc(), "word")
    want = sorted(tuple(r) for r in df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
                  .drop("r").collect())
    assert got == want


def test_case_sensitive_and_acquired_before(spark):
    import datetime

    docs = spark.createDataFrame(
        [(1, "Volcanic Arc rocks. a volcanic arc here", datetime.date(2020, 1, 1)),
         (2, "Volcanic Arc again", datetime.date(2024, 1, 1))],
        "doc_id long, text string, acquired date")
    plain = extract_snippets(docs, ["volcanic arc"]).collect()
    assert sorted((r.doc_id, r.frag_idx) for r in plain) == [(1, 0), (1, 1), (2, 0)]
    cs = extract_snippets(docs, ["Volcanic Arc"], case_sensitive=True).collect()
    assert sorted((r.doc_id, r.frag_idx) for r in cs) == [(1, 0), (2, 0)]
    assert {r.search_term for r in cs} == {"volcanic arc"}
    old = extract_snippets(docs, ["volcanic arc"], acquired_before="2023-01-01").collect()
    assert sorted((r.doc_id, r.frag_idx) for r in old) == [(1, 0), (1, 1)]


def test_stemmed_matching(spark):
    docs = spark.createDataFrame(
        [(1, "Two volcanic arcs meet. A volcanic arc! Volcanism only. arcs volcanic"), (2, "Basalts everywhere")],
        "doc_id long, text string")
    got = sorted((r.search_term, r.doc_id, r.frag_idx)
                 for r in extract_snippets(docs, ["volcanic arc", "basalt"], stemmed=True).collect())
    assert got == [("basalt", 2, 0), ("volcanic arc", 1, 0), ("volcanic arc", 1, 1)]
    exact = sorted((r.search_term, r.doc_id, r.frag_idx)
                   for r in extract_snippets(docs, ["volcanic arc", "basalt"]).collect())
    assert exact == [("volcanic arc", 1, 1)]


def test_term_alone_equals_term_among_others(spark):
    both = spark.createDataFrame([("a", "rocks rocks pebbles"), ("b", "rock pebble pebbles")],
                                 "search_term string, processed_text string")
    together = {(r.word_1, r.word_2, r["count"]) for r in cooccurrence_stats(both, 10).collect()}
    alone = {(r.word_1, r.word_2, r["count"]) for t in "ab"
             for r in cooccurrence_stats(both.where(F.col("search_term") == t), 10).collect()}
    assert together == alone == {("a", "rocks", 2), ("a", "pebbles", 1), ("b", "rock", 1), ("b", "pebble", 2)}


def test_user_lemma_table(spark):
    rows = spark.createDataFrame([("a", "mice mouse rocks rock")], "search_term string, processed_text string")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("rocks", "rocks"), ("rock", None)], "word string, lemma string")
    got = result(cooccurrence_stats(rows, 10, lemmas=lemmas))
    assert got == [("mouse", 2), ("rock", 1)]     # rock and rocks stay apart, then share a stem


def test_two_spellings_of_a_term(spark):
    docs = spark.createDataFrame([(1, "Thing and thing. a thing. Thing")], "doc_id long, text string")
    got = extract_snippets(docs, ["Thing", "thing"], case_sensitive=True).collect()
    assert sorted(r.frag_idx for r in got) == [0, 1, 2]
    two = extract_snippets(docs, ["Thing", "thing"], 2, case_sensitive=True).collect()
    assert sorted(r.frag_idx for r in two) == [0, 1]
