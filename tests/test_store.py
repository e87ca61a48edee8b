"""Upserts, ledger, removal, cleaning (FIXTURES 3.9) and the table store."""
import os
import tempfile

import pytest

from termlens.operators.store import CommitConflict, TableStore, clean_stats, insert_if_absent, pending, remove_term, upsert

CO = "word_1 string, word_2 string, count long, prob_w1w2 double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_remove_term(spark):
    co = spark.createDataFrame([("a", "b", 1, 0.1), ("b", "c", 2, 0.2), ("c", "d", 3, 0.3)], CO)
    led = spark.createDataFrame([("a",), ("b",)], "term string")
    cnt = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.2)], "word string, count long, probability double")
    l2, c2, n2 = remove_term(led, co, cnt, " B ")
    assert rows(c2) == [("c", "d", 3, 0.3)]
    assert rows(l2) == [("a",)] and [r.word for r in n2.collect()] == ["a"]


def test_clean_stats(spark):
    co = spark.createDataFrame([("a", None, 1, 0.1), ("a", "", 1, 0.1), ("a", "  ", 1, 0.1), ("a", "x", 1, 0.1)], CO)
    assert rows(clean_stats(co)) == [("a", "x", 1, 0.1)]


def test_upsert_incoming_wins_and_is_idempotent(spark):
    ex = spark.createDataFrame([("t", "a", 1, 0.1), ("t", "b", 2, 0.2)], CO)
    inc = spark.createDataFrame([("t", "b", 5, 0.5), ("u", "c", 1, 0.1)], CO)
    once = upsert(ex, inc, ["word_1", "word_2"])
    assert rows(once) == [("t", "a", 1, 0.1), ("t", "b", 5, 0.5), ("u", "c", 1, 0.1)]
    assert rows(upsert(once, inc, ["word_1", "word_2"])) == rows(once)


def test_ledger_and_pending(spark):
    led = spark.createDataFrame([("a",)], "term string")
    inc = spark.createDataFrame([("a",), ("b",), ("b",)], "term string")
    assert rows(insert_if_absent(led, inc, ["term"])) == [("a",), ("b",)]
    cand = spark.createDataFrame([("a",), ("c",)], "term string")
    assert rows(pending(cand, led, "term")) == [("c",)]


def test_table_store_versions(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="termlens-store-"))
    inc = spark.createDataFrame([("t", "a", 1, 0.1)], CO)
    store.merge("term_cooccurrence", inc)
    store.merge("term_cooccurrence", spark.createDataFrame([("t", "a", 2, 0.2), ("t", "b", 1, 0.1)], CO))
    assert rows(store.read("term_cooccurrence")) == [("t", "a", 2, 0.2), ("t", "b", 1, 0.1)]
    store.write("term_counts", spark.createDataFrame([("t", 1, 0.1)], "word string, count long, probability double"))
    store.add_terms(["T ", "u"])
    store.remove_term("t")
    assert rows(store.read("processed_terms")) == [("u",)]
    assert rows(store.read("term_cooccurrence")) == []


COUNTS = "word string, count long, probability double"


def filled(spark, buckets=8):
    store = TableStore(spark, tempfile.mkdtemp(prefix="termlens-store-"), buckets)
    with store.change() as c:
        c.merge("term_cooccurrence", spark.createDataFrame([(f"t{i % 5}", f"w{i}", i, 0.1) for i in range(60)], CO))
        c.merge("term_counts", spark.createDataFrame([(f"t{i}", i, 0.1) for i in range(5)], COUNTS))
        c.add_terms([f"t{i}" for i in range(5)])
    return store


def tables(store):
    return {n: rows(store.read(n)) for n in ("term_cooccurrence", "term_counts", "processed_terms")}


@pytest.mark.parametrize("after", [1, 2, 3])
def test_a_removal_that_breaks_off_changes_nothing(spark, monkeypatch, after):
    store = filled(spark)
    before, done = tables(store), []
    from termlens.operators import store as module
    put = module.Change._put

    def breaking(self, name, df, buckets):
        put(self, name, df, buckets)
        done.append(name)
        if len(done) == after:
            raise OSError("lost")

    monkeypatch.setattr(module.Change, "_put", breaking)
    with pytest.raises(OSError, match="lost"):
        store.remove_term("t1")
    assert len(done) == after and tables(store) == before
    monkeypatch.undo()
    store.remove_term(" T1")
    now = tables(store)
    assert now == {n: [r for r in before[n] if r[0] != "t1"] for n in before} and now != before


def test_of_two_writers_the_second_is_refused(spark):
    store = filled(spark)
    with pytest.raises(CommitConflict):
        with store.change() as slow:
            slow.add_terms(["slow"])
            store.add_terms(["quick"])
    assert ("quick",) in rows(store.read("processed_terms")) and ("slow",) not in rows(store.read("processed_terms"))
    assert not [n for n in os.listdir(f"{store.root}/manifests") if not n.strip(".").endswith((".json", ".crc"))]
    store.add_terms(["slow"])
    assert ("slow",) in rows(store.read("processed_terms"))


def test_merge_rewrites_the_touched_buckets_only(spark):
    store = filled(spark)
    was, before = store.manifest()["term_cooccurrence"]["parts"], store.read("term_cooccurrence")
    inc = spark.createDataFrame([("t0", "w0", 99, 0.9), ("t0", "new", 1, 0.1)], CO)
    want = rows(upsert(before, inc, ["word_1", "word_2"]))
    store.merge("term_cooccurrence", inc)
    now = store.manifest()["term_cooccurrence"]["parts"]
    changed = {b for b in now if now[b] != was.get(b)}
    assert 1 <= len(changed) <= 2 < len(now) and rows(store.read("term_cooccurrence")) == want
    assert store.manifest()["term_counts"] == store.manifest(store.version() - 1)["term_counts"]
    written = [f for b in changed for f in os.listdir(os.path.join(store.root, now[b])) if f.endswith(".parquet")]
    assert len(written) == len(changed)


def test_emptied_tables_can_be_read(spark):
    store = filled(spark)
    for i in range(5):
        store.remove_term(f"t{i}")
    assert tables(store) == {"term_cooccurrence": [], "term_counts": [], "processed_terms": []}
    store.remove_term("t1")
    store.merge("term_counts", spark.createDataFrame([("x", 1, 0.1)], COUNTS))
    assert rows(store.read("term_counts")) == [("x", 1, 0.1)]
