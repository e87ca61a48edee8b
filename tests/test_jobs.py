"""End-to-end runs: batch stages, skip logic, incremental stream, readers."""
import json
import os
import tempfile


from termlens.operators.store import TableStore
from termlens.plans.jobs import Layout, extract, process_terms
from termlens.sources.snippets_io import read_api_responses, read_by_term, read_snippets_csv, write_snippets
from termlens.sources.tables import corpus
from termlens.streaming import incremental

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_process_terms_skips_done_work(spark):
    root = tempfile.mkdtemp(prefix="termlens-run-")
    docs = corpus(spark, SF)
    assert process_terms(spark, docs, ["thing", "thble"], root, 1000) == ["thble", "thing"]
    # second run: extracted and loaded terms are skipped, a new one is added
    assert process_terms(spark, docs, ["thing", "nicht"], root, 1000) == ["nicht"]
    store = TableStore(spark, os.path.join(root, "tables"))
    assert rows(store.read("processed_terms")) == [("nicht",), ("thble",), ("thing",)]
    co = store.read("term_cooccurrence")
    assert {r.word_1 for r in co.select("word_1").distinct().collect()} == {"nicht", "thble", "thing"}
    assert extract(spark, docs, ["thing"], Layout(root)) == []
    assert extract(spark, docs, ["thing"], Layout(root), overwrite=True) == ["thing"]


def test_incremental_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="termlens-src-")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("doc_id < 100").write.parquet(os.path.join(src, "part1"))
    docs.where("doc_id >= 100").write.parquet(os.path.join(src, "part2"))
    root = tempfile.mkdtemp(prefix="termlens-inc-")
    q = incremental.start(spark, os.path.join(src, "*"), ["thing", "nicht"], root, 1000, max_files_per_trigger=1)
    q.awaitTermination(600)
    store = TableStore(spark, os.path.join(root, "tables"))
    batch_root = tempfile.mkdtemp(prefix="termlens-batch-")
    process_terms(spark, corpus(spark, SF), ["thing", "nicht"], batch_root, 1000)
    ref = TableStore(spark, os.path.join(batch_root, "tables"))
    assert rows(store.read("term_cooccurrence")) == rows(ref.read("term_cooccurrence"))
    assert rows(store.read("term_counts")) == rows(ref.read("term_counts"))


def test_batches_are_additive_and_read_no_old_snippets(spark):
    from pyspark.sql import functions as F

    from termlens.sources.snippets_io import read_by_term

    root, terms = tempfile.mkdtemp(prefix="termlens-inc-"), ["thing", "nicht", "of the"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i in range(3):
        batch = docs.where(F.col("doc_id") % 3 == i)
        incremental.batch_update(batch, i, terms, root, 1000, 10 ** 6, None)
        # what earlier batches wrote is gone: only the stored aggregates can be used
        docs.limit(0).select(F.lit("x").alias("highlight"), F.lit("t").alias("search_term")).write.mode("overwrite").partitionBy(
            "search_term").parquet(os.path.join(root, "snippets", f"batch_id={i}"))
    store = TableStore(spark, os.path.join(root, "tables"))
    batch_root = tempfile.mkdtemp(prefix="termlens-batch-")
    process_terms(spark, corpus(spark, SF), terms, batch_root, 1000)
    ref = TableStore(spark, os.path.join(batch_root, "tables"))
    for name in ("term_cooccurrence", "term_counts", "processed_terms"):
        assert rows(store.read(name)) == rows(ref.read(name)), name
    want = read_by_term(spark, Layout(batch_root).result("corpus_stats"))
    assert rows(store.read("corpus_stats")) == rows(want.select(*store.read("corpus_stats").columns))
    before = store.version()
    incremental.batch_update(docs.where(F.col("doc_id") % 3 == 2), 2, terms, root, 1000, 10 ** 6, None)   # run again
    assert store.version() == before


def test_api_response_reader(spark):
    d = tempfile.mkdtemp(prefix="termlens-api-")
    page = {"success": {"data": [
        {"_gddid": "g1", "doi": "10.1/a", "title": "T", "pubname": "J", "URL": "u",
         "highlight": ["Volcanic arcs, basalt 12!", "second"]},
        {"_gddid": "g2", "highlight": []}], "next_page": ""}}
    with open(os.path.join(d, "p1.json"), "w") as f:
        json.dump(page, f)
    df = read_api_responses(spark, d, "Volcanic Arc")
    got = rows(df.select("doc_id", "frag_idx", "journal", "url", "processed_text", "search_term"))
    assert got == [("g1", 0, "J", "u", "volcanic arcs basalt", "volcanic arc"),
                   ("g1", 1, "J", "u", "second", "volcanic arc")]


def test_drifting_and_broken_pages(spark):
    from termlens.operators.bibliography import bib_records
    from termlens.operators.rowindex import dense_index
    from termlens.sources.snippets_io import page_documents, raw_pages, rejected_pages

    d = tempfile.mkdtemp(prefix="termlens-api-")
    docs = [
        {"_gddid": "g1", "title": "One", "year": 1999, "source": "S1", "landing_page": "http://l/1", "highlight": ["a b."],
         "author": [{"given": "Ann", "family": "Roe"}, {"name": "B. Doe"}], "score": 1.5, "tags": ["x", {"y": 2}]},
        {"_gddid": "g2", "title": "Two", "pub_year": "2001", "type": "book", "author": ["C", "D"], "highlight": "only one"},
        {"_gddid": "g3", "title": "Three", "coverDate": "1987-05-01", "author": "E, F.; G", "authors": "", "highlight": ["x", "y"]},
        {"_gddid": "g4", "authors": "H and I", "author": ["ignored"], "highlight": []}, "no object", None]
    texts = {"p1.json": json.dumps({"success": {"data": docs, "next_page": ""}, "new": 1}), "p2.json": '{"success": {"data": [{"_gd',
             "p3.json": json.dumps({"error": {"message": "gone"}}), "p4.json": json.dumps({"success": {"data": {"a": 1}}}), "p5.json": "[]",
             "p6.json": json.dumps({"success": {"data": []}})}
    for name, text in texts.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    pages = raw_pages(spark, d)
    assert sorted((os.path.basename(r.path), r.reason) for r in rejected_pages(pages).collect()) == [
        ("p2.json", "not JSON"), ("p3.json", "no list success.data"), ("p4.json", "no list success.data"), ("p5.json", "no list success.data")]
    got = {r.doc_id: r for r in page_documents(pages).collect()}
    assert sorted(got) == ["g1", "g2", "g3", "g4"]
    assert json.loads(got["g1"].extra) == {"score": 1.5, "tags": ["x", {"y": 2}]} and json.loads(got["g2"].extra) == {}
    rows_ = read_api_responses(spark, d, "T")
    assert sorted((r.doc_id, r.frag_idx, r.highlight) for r in rows_.collect()) == [
        ("g1", 0, "a b."), ("g2", 0, "only one"), ("g3", 0, "x"), ("g3", 1, "y")]
    recs = {r.id: r for r in bib_records(dense_index(rows_, ["search_term"], ["doc_id", "frag_idx"], "snippet_row")).collect()}
    assert (recs["g1"].year, recs["g1"].journal, recs["g1"].link[0].url) == (1999, "S1", "http://l/1")
    assert [a.name for a in recs["g1"].author] == ["Ann Roe", "B. Doe"] and [a.name for a in recs["g2"].author] == ["C", "D"]
    assert (recs["g2"].year, recs["g2"].type) == (2001, "book") and recs["g3"].year == 1987
    assert [a.name for a in recs["g3"].author] == ["E, F.", "G"]


def test_snippet_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="termlens-csv-")
    df = spark.createDataFrame([("t", "d1", 0, 'He said "hi",\nthen left', "said hi left")],
                               "search_term string, doc_id string, frag_idx int, highlight string, processed_text string")
    write_snippets(df, os.path.join(d, "s"), fmt="csv")
    back = read_snippets_csv(spark, os.path.join(d, "s"), all_strings=True)
    r = back.collect()[0]
    assert (r.search_term, r.doc_id, r.highlight) == ("t", "d1", 'He said "hi",\nthen left')


def test_runs_resume_after_any_stage(spark):
    from termlens.plans.jobs import statistics

    docs = spark.createDataFrame([(1, "agent 007 was here. rock 2024.", "p", "en"), (2, "in 2024 the agent left.", "p", "en")],
                                 "doc_id long, text string, publisher string, lang string")
    terms, ends = ["007", "2024", "absent"], []
    for stop in range(3):
        root = tempfile.mkdtemp(prefix="termlens-resume-")
        if stop > 0:
            fresh = extract(spark, docs, terms, Layout(root))
            assert fresh == ["007", "2024", "absent"]
        if stop > 1:
            statistics(spark, fresh, Layout(root), 1000)
        process_terms(spark, docs, terms, root, 1000)
        store = TableStore(spark, os.path.join(root, "tables"))
        ends.append([rows(store.read(t)) for t in ("processed_terms", "term_counts", "term_cooccurrence")])
        assert {r[0] for r in ends[-1][1]} == {"007", "2024"}
        maps = read_by_term(spark, Layout(root).result("bib_map"))
        assert rows(maps.select("search_term", "snippet_row", "bibjson_id")) == [
            ("007", 0, "1"), ("2024", 0, "1"), ("2024", 1, "2")]
        heads = read_by_term(spark, Layout(root).result("bib_collections")).collect()
        assert {json.loads(r.header_json)["collection"] for r in heads} == {"007", "2024"}
    assert ends[0] == ends[1] == ends[2]


def test_wildcards(spark):
    import pytest

    from termlens.operators.snippets import extract_snippets

    docs = spark.createDataFrame([(1, "Rock of the north. volcanic arcs.")], "doc_id long, text string")
    found = {r.search_term for r in extract_snippets(docs, ["of th*", "volc*", "of x*"]).collect()}
    assert found == {"of th*", "volc*"}
    with pytest.raises(ValueError):
        extract_snippets(docs, ["vo*"])


def test_empty_vectors(spark):
    from termlens.operators.similarity import build_forest

    items = spark.createDataFrame([], "id long, vec array<double>")
    assert build_forest(items).count() == 0
