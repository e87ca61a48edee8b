"""BagMinHash: unbiased signatures, classes against brute force, edge cases; the pipeline."""
import collections
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from termlens.llm import bagminhash, common


def bag(text):
    w = text.lower().split()
    k = min(5, len(w))
    return collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_signatures_estimate_weighted_jaccard():
    rnd, errors = random.Random(1), []
    for k in range(30):
        base = [f"w{rnd.randrange(200)}" for _ in range(60)] + ["z"] * rnd.randrange(60)
        other = [w if rnd.random() > 0.04 else "q" for w in base] + ["z"] * rnd.randrange(40)
        texts = [" ".join(base), " ".join(other)]
        sig = bagminhash.signatures(*bagminhash.multiset(texts), 2)
        errors.append((sig[0] == sig[1]).mean() - jaccard(bag(texts[0]), bag(texts[1])))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def variants(rnd, n, words, edits):
    base = [f"v{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(edits):
            t[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_classes_match_brute_force(spark):
    rnd = random.Random(3)
    texts = variants(rnd, 40, 120, 2) + variants(rnd, 25, 200, 4) + variants(rnd, 20, 60, 3) + variants(rnd, 12, 30, 0)
    texts += [" ".join(f"s{rnd.randrange(9000)}" for _ in range(50)) for _ in range(30)]
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.class_id for r in bagminhash.classes(df).collect()}
    want = {i: root(i) for i in range(len(texts))}
    least = {}
    for i, r in want.items():
        least[r] = min(least.get(r, i), i)
    assert got == {i: least[r] for i, r in want.items()}


def brute_classes(texts):
    """Least place of the component of each text; equal texts and J >= 0.8 are linked (an index of shingles finds the pairs)."""
    first, parent = {}, {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    bags, held = {i: bag(t) for t, i in first.items()}, collections.defaultdict(list)

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for i in sorted(bags):
        if not bags[i]:
            root(i)
            continue
        for j in {j for x in bags[i] for j in held[x]}:
            if jaccard(bags[i], bags[j]) >= 0.8 - 1e-12:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in bags[i]:
            held[x].append(i)
        root(i)
    return [root(first[t]) for t in texts]


def test_classes_of_sf001_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    want = brute_classes([r.text or "" for r in rows])
    got = {r.id: r.class_id for r in bagminhash.classes(docs).collect()}
    assert [got[r.doc_id] for r in rows] == [rows[w].doc_id for w in want]


def test_a_large_group_around_the_threshold(spark, monkeypatch):
    """Hundreds of texts whose similarities scatter about 0.8, with and without chunks of buckets."""
    rnd = random.Random(12)
    base = [f"v{rnd.randrange(9000)}" for _ in range(140)]
    texts = []
    for _ in range(400):
        t = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(60)}"
        texts.append(" ".join(t))
    want = brute_classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (1 << 20, 9000):
        monkeypatch.setattr(bagminhash, "CHUNK_ELEMENTS", size)
        monkeypatch.setattr(bagminhash, "STAR_ROUNDS", 1)
        got = {r.id: r.class_id for r in bagminhash.classes(df).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert 1 < len(set(want)) < 400


def test_common_elements():
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 4000, rnd.integers(0, 3000))) for _ in range(12)]
    off = ~np.eye(12, dtype=bool)
    assert (bagminhash._common(sets)[off] == np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])[off]).all()


def test_only_likely_rows_are_moved(spark):
    """A filter loses no wanted row (nulls among them) and lets few others pass, whatever the columns are called."""
    df = spark.range(20_000).select(F.expr("nullif(id, 700)").alias("id"), (F.col("id") * 7).alias("k"), F.lit("x").alias("__bits"))
    wanted = df.where("k % 350 = 0").select(F.col("id").alias("rep"), "k")
    got = common.likely(df, ["id", "k"], wanted, ["rep", "k"])
    assert got.columns == df.columns and {r.k for r in wanted.collect()} <= {r.k for r in got.collect()}
    assert wanted.count() == 400 and got.count() < 2200
    assert common.likely(df, ["id"], wanted.limit(0), ["rep"]).count() == 0


def test_buckets_of_the_same_nodes_are_one(spark):
    rows = [(h, n, 9) for h, nodes in ((5, (1, 2)), (3, (2, 1)), (8, (1, 2, 3)), (9, (1, 3)), (4, (1, 2))) for n in nodes]
    got = bagminhash.one_of_each(spark.createDataFrame(rows, "h long, node long, n long")).collect()
    assert sorted((r.h, r.node) for r in got) == [(3, 1), (3, 2), (8, 1), (8, 2), (8, 3), (9, 1), (9, 3)]
    assert {r.n for r in got} == {9}


def test_components_start_at_the_least_neighbour(spark, monkeypatch):
    """A star round its least node needs no pass but the one that finds nothing to change."""
    written, write = [], bagminhash.cut_lineage
    monkeypatch.setattr(bagminhash, "cut_lineage", lambda df: written.append(1) or write(df))

    def labels(n, links):
        return {r.node: r.label for r in bagminhash.components(spark.range(n).toDF("node"), spark.createDataFrame(
            links, "a long, b long")).collect()}

    assert labels(9, [(i, 1) for i in range(2, 8)]) == {0: 0, 8: 8} | dict.fromkeys(range(1, 8), 1) and len(written) == 3
    assert labels(40, [(i, i + 1) for i in range(5, 39)]) == {i: min(i, 5) for i in range(40)}


def test_edge(spark, edge, empty):
    got = collections.defaultdict(list)
    for r in bagminhash.classes(edge).collect():
        got[r.id].append(r.class_id)
    assert got[1] == [1] and got[2] == [2] and got[3] == [3] and got[4] == [4] and got[5] == [4, 4] and got[None] == [None]
    kept = bagminhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 5").count() == 0 and kept.count() == edge.count() - 2
    assert bagminhash.classes(empty).count() == 0 and bagminhash.keep_one(empty).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = bagminhash.cut_lineage(stage(spark, docs, sf))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()


def plain_line_dedup(rows):
    """rows of (doc_id, text, source): texts without boilerplate lines, line by line."""
    import re
    sites, first = collections.defaultdict(set), {}
    for i, t, site in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line) >= 20 or re.search(r"[^\W_]", line):
                sites[line].add(site)
                first.setdefault(line, (i, t, k))
    gone = {x for x, s in sites.items() if len(s) >= (5 if len(x) >= 20 else 10)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if x not in gone or first[x] == (i, t, k))
            for i, t, _ in rows}


def test_pipeline_matches_plain_python(spark):
    """The pieces of run() against line dedup, near-duplicate classes and ids made in plain Python from the rows that
    the two classifiers keep."""
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = bagminhash.cut_lineage(stage(spark, docs, sf))
    rows = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect()]
    assert 0.5 * 1000 < len(rows) < 1000
    texts = plain_line_dedup(rows)
    ids = [i for i, _, _ in rows]
    classes = brute_classes([texts[i] or "" for i in ids])
    kept = {i: texts[i] for k, i in enumerate(ids) if classes[k] == k or not bag(texts[i] or "")}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    library.no_truncation()
    library.no_padding()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in kept.items()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    got, places = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        got[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        places[p.sequence_id].append((p.offset, p.length))
    assert {i: [x for _, part in sorted(v) for x in part] for i, v in got.items()} == want
    for k, v in places.items():
        ends = np.cumsum([0, *[n for _, n in sorted(v)]])
        assert [o for o, _ in sorted(v)] == ends[:-1].tolist() and (ends[-1] == 4096 or k == max(places))


def test_pipeline_edge(spark, edge, empty, tmp_path):
    """Nulls, empty, very long and repeated rows, a null id, clashing columns, empty tables, no labels."""
    marks = edge.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    for k, (docs, labels) in enumerate([(edge, marks), (edge, marks.limit(0)), (empty, marks), (empty, marks.limit(0))]):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        sf = f"{tmp_path}/{k}"
        now = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = bagminhash.cut_lineage(stage(spark, now, sf))
            assert out.columns == docs.columns and out.count() <= now.count(), name
            now = out
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert pieces.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
        assert corpus_pipeline.run(spark, sf).columns == pieces.columns
    # every stage takes all the edge rows as they are
    for name, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, edge, f"{tmp_path}/0").count() > 0, name


def test_pipeline_gives_back_what_training_took(monkeypatch):
    said = []
    for module, keep in ((corpus_pipeline.langid, "keep_identified"), (corpus_pipeline.quality_knn, "keep_quality")):
        monkeypatch.setattr(module, "fit", lambda *a: said.append("fit"))
        monkeypatch.setattr(module, keep, lambda *a: said.append("keep"))
    monkeypatch.setattr(corpus_pipeline.quality_knn, "labelled_texts", lambda *a: None)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: None)
    monkeypatch.setattr(corpus_pipeline, "release_memory", lambda: said.append("release"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        stage(None, None, "")
    assert said == ["fit", "release", "keep"] * 2


def test_pipeline_keeps_what_op8_calls_good(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.quality_knn, "fit", lambda docs, labelled: None)
    monkeypatch.setattr(corpus_pipeline.quality_knn, "quality", lambda model, text: F.col("n_chars") / 100)
    docs = spark.createDataFrame([(i, "text", 10 * i + 5) for i in range(10)], "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.classify_quality(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in kept) == [7, 8, 9]
