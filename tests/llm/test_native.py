"""Operators of column expressions only: fingerprints, chat, line dedup, quality rules."""
import collections
import hashlib
import re

from pyspark.sql import functions as F

from termlens.llm import chat, fingerprints, linededup, quality_rules
from termlens.llm.queries import ORACLES, QUERIES


def test_oracles(spark, duck):
    from tools_check import rows
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        res = duck.execute(sql)
        cols = [d[0] for d in res.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, res.fetchall()), name


def lanes(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.lanes for r in fingerprints.fingerprint(df).orderBy("doc_id").collect()]


def test_fingerprints_are_homomorphic(spark):
    a, b, ab, ba, aab, nothing, null = lanes(spark, "first, line.", "second line!", "first, line.\nsecond line!",
                                             "second line!\nfirst, line.", "first, line.\nfirst, line.\nsecond line!", "", None)
    mod = fingerprints.MODULUS
    assert [(x + y) & mod for x, y in zip(a, b, strict=True)] == ab == ba != aab and nothing == null
    assert [(x - y) & mod for x, y in zip(aab, ab, strict=True)] == a
    df = spark.createDataFrame([(aab, a)], "x array<long>, y array<long>")
    assert df.selectExpr(fingerprints.combine_sql("x", "y", "-") + " AS z").first().z == ab


def test_likeness_of_very_long_texts(spark):
    once, many = "ab.", "ab." * 40_000
    a, b = ("".join(f"{x}{i}." for i in range(70_000)) for x in "xy")
    half = a[:len(a) // 2] + b[len(b) // 2:]
    x = dict(zip(("once", "many", "a", "b", "half"), lanes(spark, once, many, a, b, half), strict=True))
    pairs = [("once", "many"), ("a", "b"), ("a", "half")]
    got = [r.near for r in spark.createDataFrame([(i, x[p], x[q]) for i, (p, q) in enumerate(pairs)], "i int, x array<long>, y array<long>")
           .selectExpr("i", fingerprints.likeness_sql("x", "y") + " AS near").orderBy("i").collect()]
    assert got[0] > 0.999 and got[1] < 0.3 and 0.3 < got[2] < 0.7  # half of the clauses are the same


def test_edited_texts_follow_descending_ids(spark, docs):
    rows = docs.select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    fingerprints.ROWS_PER_RANGE, old = 7, fingerprints.ROWS_PER_RANGE
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    fingerprints.ROWS_PER_RANGE = old
    for i, r in enumerate(rows):
        nxt, half = rows[(i + 1) % len(rows)].text, len(r.text) // 2
        assert got[r.doc_id].edited == r.text[:len(r.text) - half] + nxt[:half]


def test_fingerprint_edge(spark, edge, empty):
    rows = fingerprints.edited_fingerprints(edge).collect()
    assert len(rows) == edge.count() and all(len(r.edited_lanes) == fingerprints.LANES for r in rows)
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(3, "abcd")], "doc_id long, text string")
    r = fingerprints.edited_fingerprints(one).selectExpr("edited", fingerprints.likeness_sql("lanes", "next_lanes") + " AS near").first()
    assert r.edited == "abab" and r.near == 1.0


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_keeps_maximal_conversations(spark):
    said = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    rows = [(1, 0, *said[0]), (1, 1, *said[1])]                                # prefix of 2
    rows += [(c, i, *s) for c in (2, 3) for i, s in enumerate(said)]           # two copies
    rows += [(4, 10, "user", "hi"), (4, 20, "assistant", "other <|im_end|>")]
    rows += [(None, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x")]
    rows += [(9, i, "user", f"t{i}") for i in range(600)] + [(8, i, "user", f"t{i}") for i in range(300)]
    got = chat.render(talk(spark, rows)).collect()
    assert {(r.conv_id, r.n_turns, r.n_copies, r.n_parts) for r in got} == {
        (2, 3, 2, 1), (4, 2, 1, 1), (None, 1, 1, 1), (5, 2, 1, 1), (9, 600, 1, 3)}
    four = next(r.rendered for r in got if r.conv_id == 4)
    assert four == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother <| im_end|><|im_end|>\n"
    nine = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 9), key=lambda r: r.part))
    assert nine == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(600))
    assert chat.render(talk(spark, [])).count() == 0


def test_line_dedup(spark, edge, empty):
    common, twice = "This line stands on every site.", "This one stands on two sites only."
    rows = [(i, f"{common}\nown text of document {i}\n{twice if i < 2 else 'tail'}", f"s{i}") for i in range(6)]
    rows += [(7, f"{common}\n{common}", None), (7, f"{common}\n{common}", None), (8, None, "s1"), (9, "", "s2"), (None, common, "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("removed", F.lit("other"))
    for k in (4, 7):
        got = linededup.dedup_lines(df, min_sites=k, removed_count="gone").collect()
        by = {r.doc_id: r for r in got}
        assert len(got) == len(rows) and by[0].text.startswith(common) and by[0].gone == 0
        assert by[1].text == f"own text of document 1\n{twice}" and by[1].gone == 1 and by[1].removed == "other"
        assert by[7].text == "" and by[7].gone == 2 and by[8].text is None and by[9].text == "" and by[None].text == ""
    assert [r.gone for r in linededup.dedup_lines(df, min_sites=8, removed_count="gone").collect()] == [0] * len(rows)
    assert linededup.dedup_lines(edge).count() == edge.count() and linededup.dedup_lines(edge).columns == edge.columns
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_of_every_line_with_a_word(spark):
    long, short, dots = "This line stands on five sites.", "Le treque.", " ... "
    rows = [(i, "\n".join([long] * (i < 5) + [short, f"And {i % 9}.", dots, "", f"own {i}"]), f"s{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, **linededup.ALL_LINES).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 10):
        assert got[i] == f"And {i % 9}.\n{dots}\n\nown {i}"


def brute_counts(text):
    w = re.findall("[^\x20\x09-\x0D]+", text)
    wins = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    held = {j for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held),
            len(w) < 50 or 100 * len(held) > 50 * len(w))


def test_quality_counts(spark, docs, edge):
    for df in (docs, edge):
        for r in quality_rules.add_counts(df.select("text")).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(r.text or "")


def test_quality_verdicts(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.quality_rules(docs).where("NOT base_failed").join(labels, "doc_id")
    by = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert by[1] > 0.99 and by[0] < 0.1
    assert quality_rules.quality_rules(docs).where("base_failed AND kept").count() == 0
    assert quality_rules.quality_rules(edge).count() == edge.count()
    assert quality_rules.quality_rules(empty).count() == 0


def test_fences_are_the_data_s(spark, monkeypatch):
    """Fences of groups of their own against exact quantiles; equal texts fall in one group and stand in another."""
    import numpy as np
    rnd = np.random.default_rng(3)
    words = [f"w{'abcdefg'[i % 7]}{i}" for i in range(400)]

    def text(symbols, length):
        return " ".join(rnd.choice(words, length)) + " " + " ".join("#" * symbols)

    rows = [(i, text(int(rnd.integers(0, 3)), 90), "x", "plain") for i in range(400)]
    rows += [(1000 + i, text(int(rnd.integers(20, 80)), 90), "x", "code") for i in range(400)]
    rows += [(2000 + g, text(60, 90), "x", s) for g, s in enumerate(["plain", "code"] * 4)]
    rows += [(3000 + i, text(0, 20), None, None) for i in range(9)]                 # too short: no part of any sketch
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(quality_rules, "SKETCH_K", 4000)                            # exact at this size
    counted = quality_rules.cut_lineage(quality_rules.add_counts(docs).drop("text"))
    got = {r.g_source: r for r in quality_rules.thresholds(counted).collect()}
    table = counted.where("NOT base_failed").select("source", *[v.alias(k) for k, v in quality_rules._ratios().items()]).toPandas()
    for g, own in table.groupby("source"):
        for k, m in quality_rules.FENCES.items():
            def at(level, x=own[k]):
                return np.quantile(x, level, method="inverted_cdf")
            wide = max(at(.75) - at(.5), .1 * (at(.99) - at(.5)))
            if wide > 0:
                assert abs(got[g][f"max_{k}"] - (at(.75) + m * wide)) < 0.02 * m * max(wide, 1e-3) + 1e-9, (g, k)
        assert got[g].basis == "source"
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(counted).collect()}
    assert not any(verdict[2000 + g] for g in (0, 2, 4, 6)) and all(verdict[2000 + g] for g in (1, 3, 5, 7))
    assert sum(verdict[i] for i in range(400)) > 390 and sum(verdict[1000 + i] for i in range(400)) > 390
    assert not any(verdict[3000 + i] for i in range(9))


def test_few_fences_are_borrowed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    limits = quality_rules.thresholds(quality_rules.cut_lineage(quality_rules.add_counts(docs).drop("text"))).toPandas()
    assert limits.borrowed.sum() <= 0.05 * 5 * len(limits) and limits.max_repeat_ratio.nunique() > 10


def test_edited_digest(spark, docs):
    r = QUERIES["op2_fingerprints"](spark, "/root/testdata/sf0.001").orderBy(F.desc("doc_id")).first()
    a, b = (x.text for x in docs.orderBy(F.desc("doc_id")).limit(2).collect())
    half = len(a) // 2
    assert r.edited_sha256 == hashlib.sha256((a[:len(a) - half] + b[:half]).encode()).hexdigest()
