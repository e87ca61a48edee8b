"""Work that has to grow no faster than the input: what a task repeats, and what is sent."""
import itertools
import time

import numpy as np
from pyspark.sql import functions as F

from termlens.functions import tagging
from termlens.functions.porter import porter_sql
from termlens.functions.text import fold_ascii, preprocess_tokens
from termlens.operators import information, neighbours, similarity, text_similarity, tokens
from termlens.operators.snippets import extract_snippets


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def random_vectors(spark, n, dim, kind="double"):
    x = np.random.default_rng(11).standard_normal((n, dim)).astype("float32")
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, f"doc_id long, vec array<{kind}>")


def test_a_long_document_is_weighed_once(spark):
    """the norm was summed again for each word."""
    letters = "".join(chr(c) for c in range(97, 123))
    words = ["".join(w) for w in itertools.islice(itertools.product(letters, repeat=4), 50_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "river text"), (3, "mountain"), (4, "valley")], "doc_id long, text string")
    begun = time.monotonic()
    v, _ = text_similarity.vectors(docs)
    assert v.agg(F.max(F.size("terms"))).first()[0] > 40_000 and time.monotonic() - begun < 60
    assert abs(v.agg(F.max(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w))).first()[0] - 1) < 1e-9


def test_stems_are_found_by_their_forms(spark):
    """all words of a document were stemmed for every term."""
    docs = spark.createDataFrame([(1, "A thing. Things here!\nno thinking"), (2, "parts of the sum. of them the"), (2, "parts of the sum."),
                                  (3, None), (4, ""), (5, "of the of thes things")], "doc_id long, text string")
    found = extract_snippets(docs, ("things", "of the", "absent"), stemmed=True)
    got = sorted((r.search_term, r.doc_id, r.frag_idx, r.highlight) for r in found.collect())
    assert got == [("of the", 2, 0, "parts of the sum"), ("of the", 2, 0, "parts of the sum"), ("of the", 5, 0, "of the of thes things"),
                   ("things", 1, 0, "A thing"), ("things", 1, 1, "Things here"), ("things", 5, 0, "of the of thes things")]
    assert "aeiouy" not in plan(found)


def test_a_query_is_sent_once_to_a_span_of_cells(spark, monkeypatch):
    """vectors without structure went to every cell."""
    asked, join = [], neighbours.bounded_join

    def counting(queries, data, k, chunk):
        asked.append(queries.count())
        return join(queries, data, k, chunk)

    monkeypatch.setattr(neighbours, "bounded_join", counting)
    x, items = random_vectors(spark, 400, 8)
    got = {}
    for kw, most in (({}, 400), ({"span": 90}, 400 * 6)):
        asked.clear()
        rows = neighbours.exact_neighbours(items, cell=20, **kw).collect()
        assert 0 < asked[1] <= most
        got[len(kw)] = {(r.doc_id, r.similar_doc_id) for r in rows}
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-cos[i])[:9]}
    assert got[0] == got[1] == want


def test_tags_by_states_are_those_of_the_fold(spark):
    """the fold compared 36 structs for every token."""
    rnd = np.random.default_rng(2)
    words = [f for fs in tagging.FORMS.values() for f in fs] + [e for e, _, _ in tagging.ENDINGS] + [
        "river", "walked", "walks", "quickly", "famous", "x", ".", "naïve"]
    runs = [[str(w) for w in rnd.choice(words, n)] for n in (1, 2, 3, 5, 64) for _ in range(20)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, words array<string>")
    sql = tagging.tags_sql("words")
    assert "array_max" not in sql
    for r in df.select("words", F.expr(sql).alias("tags")).collect():
        best = None
        for w in r.words:
            s = tagging.form_scores(w)
            if best is None:
                best = [(s[t], 0, x) for t, x in enumerate(tagging.TAGS)]
            else:
                tops = [max((b[0] + tagging.FOLLOWS.get(p + x, 0), -k, b[2]) for k, (p, b) in enumerate(zip(tagging.TAGS, best, strict=True)))
                        for x in tagging.TAGS]
                best = [(o[0] + s[t], 0, o[2] + tagging.TAGS[t]) for t, o in enumerate(tops)]
        assert r.tags == max((b[0], -k, b[2]) for k, b in enumerate(best))[2]


def test_tokens_are_not_sent_to_their_lemmas(spark, monkeypatch):
    """every token was written, sent to its lemma and sent back to its document."""
    written, cut = [], tokens.cut_lineage

    def counting(df, *args):
        written.append((out := cut(df, *args)).count())
        return out

    monkeypatch.setattr(tokens, "cut_lineage", counting)
    rows = [(1, "to walks the women the woman."), (2, "She walked to walking. walk walke."), (2, "to saws the boxes, box"), (2, None),
            (None, "rivers"), (None, "a river. flies fly"), (3, ""), (4, None), (5, "the walks " * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = spark.createDataFrame([("saws", "v", "see of"), ("box", "n", "a\tbox")], "form string, pos string, lemma string")
    for lemmas in (None, own):
        got = [{r.doc_id: r.cleaned for r in tokens.clean_tokens_by_tag(docs, lemmas=lemmas, head=h).collect()} for h in (1, 1000)]
        assert got[0] == got[1] and len(got[0]) == 6 and got[0][3] == got[0][4] == ""
        assert got[0][1] == "to walk the woman the woman ." and got[0][None] == "a river river . fly fly"
    assert "see of" in got[0][2] and "a\tbox" in got[0][2]
    written.clear()
    left = tokens.clean_tokens_by_tag(docs)
    assert tokens.tagged_tokens(docs).count() > 200 and max(written) < 50
    assert not any(j in left._jdf.queryExecution().sparkPlan().toString().split("Subqueries")[0] for j in ("SortMergeJoin", "HashJoin"))


def test_stemmer_passes_over_words_without_a_suffix():
    """every suffix was tried on every word."""
    assert "NOT substr(w, -1) IN" in porter_sql("w")
    assert "NOT substr" not in porter_sql("w", "duckdb")


def test_forest_sends_single_precision_and_sorts_no_pairs(spark):
    """F8: pairs travelled with double vectors, and were sorted."""
    _, items = random_vectors(spark, 300, 8, "float")
    found = similarity.nearest_neighbours(items, trees=3, leaf_size=32)
    text = found._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text.split("ShuffledHashJoin")[0]
    assert found.groupBy("doc_id").count().agg(F.min("count")).first()[0] == 9


def test_words_are_cut_once(spark):
    """a filter on the size of the words computed them twice."""
    docs = spark.createDataFrame([(1, "blue words here"), (2, "words"), (3, None)], "doc_id long, text string")
    pairs = information.joint_counts(docs, ["blue", "words"], preprocess_tokens("text"))
    assert "Filter (" not in plan(pairs) and [tuple(r) for r in pairs.collect()] == [(0, 1, 1)]
    counts = information.term_word_counts(docs, F.array(F.lit("a"), F.lit("b")), preprocess_tokens("text"))
    got = {(r.search_term, r.word): r.n for r in counts.collect()}
    assert len(got) == 9 and got[None, "words"] == got["a", "words"] == 2 and got["b", None] == 2 and got["a", "blue"] == 1


def test_symbols_are_dropped_as_by_ranges(spark):
    import re

    text = "".join(chr(i) for i in range(1, 128))
    got = spark.createDataFrame([(text,)], "text string").select(fold_ascii("text")).first()[0]
    want = re.sub(r"[^A-Za-z0-9_\t-\r\x1c-\x20.,;'\"!?()\-]", "", text)
    assert got == re.sub(r"[\t-\r\x1c-\x20]+", " ", want).strip()
