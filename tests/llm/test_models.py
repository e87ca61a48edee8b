"""Language ID, quality and toxicity classifiers: held-out accuracy and edge cases."""
import numpy as np
from pyspark.sql import functions as F

from termlens.llm import langid, quality_knn, toxicity
from termlens.llm.common import split_remainder

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = split_remainder("doc_id", 3) == 1
    model = langid.fit(docs.where(~held))
    got = langid.add_language(docs.where(held), model)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.96
    kept = langid.keep_identified(docs, model, 0.4)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_language_edge(spark, edge, empty):
    model = langid.fit(edge)
    got = {r.doc_id: r for r in langid.add_language(edge, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[8].lang_pred == "en" and 0 <= got[8].score <= 1 and got[8].node == 1
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.add_language(edge, none).collect()} == {"und"}
    assert langid.add_language(empty, model).count() == 0


def test_every_language_is_learned(spark):
    rows = [(f"{chr(0x4E00 + g)}{chr(0x5E00 + i)}", f"l{g:03}") for g in range(210) for i in range(2)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == model.weights.shape[1] == 210


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = split_remainder("doc_id", 4) == 2
    both = docs.join(labels, "doc_id")
    model = quality_knn.fit(docs, both.where(~held))
    got = quality_knn.add_quality(both.where(held), model)
    assert got.agg(F.avg(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.95


def test_quality_neighbours_are_exact(spark):
    rng = np.random.default_rng(0)
    m = quality_knn.NeighbourModel(np.ones(quality_knn.DIM, np.float32), rng.random((quality_knn.DIM, 8)).astype(np.float32) - 0.5,
                                   quality_knn.unit(rng.random((300, 8)).astype(np.float32) - 0.5), rng.integers(0, 2, 300).astype(float))
    texts = ["some words here", "### ###", "A B C a b c"]
    x = m.project(quality_knn.counts(texts))
    for t, v in zip(texts, x, strict=True):
        cos = m.vectors @ v
        near = np.argsort(-cos)[:m.k]
        w = np.maximum(cos[near], 0) ** quality_knn.SHARPNESS
        assert abs(m.score([t])[0] - (w * m.labels[near]).sum() / w.sum()) < 1e-5


def test_quality_copies_are_one_neighbour(spark):
    texts = [f"some words number {i} stand here in a row {i * i}" for i in range(30)]
    rows = [(t, i % 2) for i, t in enumerate(texts)] + [("### some words ### stand here", 1)] * 500 + [("### some words ### stand here", 0)] * 500
    both = spark.createDataFrame(rows, "text string, quality int").repartition(4)
    model = quality_knn.fit(both, both)
    assert len(model.labels) == 31 and sorted(model.copies) == [1] * 30 + [1000] and 0.5 in model.labels
    few = quality_knn.fit(both, both, max_labelled=7)
    assert len(few.labels) == 7 and few.vectors.shape[0] == 7
    least = {r.text for r in both.select("text").distinct().orderBy(F.xxhash64("text")).limit(7).collect()}
    want = few.project(quality_knn.counts(sorted(least))) @ few.vectors.T
    assert (want.max(1) > 0.999).all()


def test_quality_edge(spark, edge, empty):
    both = edge.withColumn("quality", F.col("doc_id") % 2)
    model = quality_knn.fit(edge, both)
    got = [r.score for r in quality_knn.add_quality(edge, model).collect()]
    assert len(got) == edge.count() and all(0 <= s <= 1 for s in got)
    none = quality_knn.fit(empty, empty.withColumn("quality", F.lit(1)))
    assert {r.score for r in quality_knn.add_quality(edge, none).collect()} == {0.5}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.1/" + f"{t}.parquet") for t in ("documents", "labels"))
    held = split_remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.add_toxicity(docs.join(labels.where(held), "doc_id"), model)
    by = {r.toxic: r.hit for r in got.groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("double")).alias("hit")).collect()}
    assert by[1] > 0.5 and by[0] < 0.03  # few labels: 300 toxic texts train; 0.94 on 4,000


def test_toxicity_windows_cover_the_text():
    text = " ".join(f"w{i}" for i in range(100))
    seen = {w for win in toxicity.windows_of(text) for w in win.split()}
    assert seen == set(text.encode().split()) and list(toxicity.windows_of(None)) == []


def test_windows_without_lexicon_bytes_save_nothing():
    rnd = np.random.default_rng(4)
    words = ["".join(rnd.choice(list("abcdefghij"), rnd.integers(2, 9))) for _ in range(900)]
    core = " ".join(rnd.choice(words, 3000)).encode()
    lexicon = b" zxvkw  qzzyv  vkjwq  xqvzz "
    m = toxicity.ToxicityModel(b" " * len(lexicon) + core, lexicon + core, np.zeros(0), lexicon=lexicon)
    texts = [" ".join(rnd.choice(words, 60)) + (" zxvkw and qzzyv here" if i % 2 else "") for i in range(20)]
    for t in texts:
        windows = list(toxicity.windows_of(t))
        want = {i for i, w in enumerate(windows) if any(w[j:j + 5] in lexicon for j in range(len(w) - 4))}
        some = set(m.suspects(windows).tolist())
        assert want <= some and len(some - want) <= 1
        for ordinary, toxic in toxicity._compressors(m.ordinary, m.toxic):
            rest = [len(ordinary.compress(w)) - len(toxic.compress(w)) for i, w in enumerate(windows) if i not in some]
            assert np.mean(np.abs(rest)) < 0.1
    assert m.suspects([b""]).tolist() == [] and m.suspects([b" zxvkw "]).tolist() == [0]


def test_every_toxic_label_feeds_the_lexicon(spark):
    words = [f"{a}{b}{a}{b}q" for a in "zxvkj" for b in "wyfh"]  # each in two toxic texts only
    texts = [f"plain text about thing{i % 7} and other{i % 11} matters here" for i in range(440)]
    rows = [(i, t + (f" {words[i // 2]} and more" if i < 40 else ""), int(i < 40)) for i, t in enumerate(texts)]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(both.select("doc_id", "text"), both.select("doc_id", "toxic"))
    assert [w for w in words if w.encode() not in model.toxic] == []


def test_toxicity_edge(spark, edge, empty):
    marks = edge.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).alias("toxic")).distinct()
    model = toxicity.fit(edge, marks)
    got = [r.score for r in toxicity.add_toxicity(edge, model).collect()]
    assert len(got) == edge.count() and all(0 <= s <= 1 for s in got)
    none = toxicity.fit(empty, marks.limit(0))
    assert {r.score for r in toxicity.add_toxicity(edge, none).collect()} == {0.0}
