"""Porter stemmer: the SQL rendering (Spark and DuckDB) against a plain
Python statement of the 1980 rules."""
import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from porter_reference import stem
from termlens.functions.porter import porter_sql

WORDS = ["caresses", "ponies", "ties", "caress", "cats", "feed", "agreed", "plastered", "bled", "motoring",
         "sing", "conflated", "troubled", "sized", "hopping", "tanned", "falling", "hissing", "fizzed",
         "failing", "filing", "happy", "sky", "relational", "conditional", "rational", "valenci",
         "hesitanci", "digitizer", "conformabli", "radicalli", "differentli", "vileli", "analogousli",
         "vietnamization", "predication", "operator", "feudalism", "decisiveness", "hopefulness",
         "callousness", "formaliti", "sensitiviti", "sensibiliti", "triplicate", "formative",
         "formalize", "electriciti", "electrical", "hopeful", "goodness", "revival", "allowance",
         "inference", "airliner", "gyroscopic", "adjustable", "defensible", "irritant", "replacement",
         "adjustment", "dependent", "adoption", "homologou", "communism", "activate", "angulariti",
         "homologous", "effective", "bowdlerize", "probate", "rate", "cease", "controll", "roll",
         "generalizations", "oscillators", "pfsnyyed", "yield", "syzygy", "sayyid", "toy", "boyish", "ab", "a"]


def spark_stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    return dict(df.select("w", F.expr(porter_sql("w"))).collect())


def duck_stems(words):
    con = duckdb.connect()
    con.execute("CREATE TABLE t(w VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(w,) for w in words])
    return dict(con.execute(f"SELECT w, {porter_sql('w', 'duckdb')} FROM t").fetchall())


def test_known_words(spark):
    want = {w: stem(w) for w in WORDS}
    assert spark_stems(spark, WORDS) == want
    assert duck_stems(WORDS) == want
    assert want["caresses"] == "caress" and want["relational"] == "relat" and want["generalizations"] == "gener"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abcdeilmnorstuyz", min_size=1, max_size=14), min_size=1, max_size=40))
def test_random_words(spark, words):
    words = sorted(set(words))
    want = {w: stem(w) for w in words}
    assert spark_stems(spark, words) == want
    assert duck_stems(words) == want
