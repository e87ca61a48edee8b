"""Bibliography parsing, keys and records (FIXTURES 3.8)."""
from pyspark.sql import functions as F

from termlens.functions.biblio import parse_year, split_authors
from termlens.operators.bibliography import bib_json_lines, bib_map, bib_records


def test_split_authors(spark):
    df = spark.createDataFrame([("Smith, J.; Doe, A.",), ("A and B, and C|D",), (" ; ",), (None,)], "a string")
    got = [r[0] for r in df.select(split_authors("a")).collect()]
    assert got == [["Smith, J.", "Doe, A."], ["A", "B", "C", "D"], [], []]


def test_parse_year(spark):
    df = spark.createDataFrame([("1999", None, None), ("2001.0", None, "1985-05-01"), (None, None, "n.d."),
                                ("nan", " 2003 ", None)], "p string, y string, c string")
    got = [r[0] for r in df.select(parse_year(F.col("p"), F.col("y"), F.col("c"))).collect()]
    assert got == [1999, 1985, None, 2003]


def test_keys_and_records(spark):
    rows = spark.createDataFrame(
        [(0, "10.1/x", None, "T", "2000", "Smith, J.; Doe, A.", "https://a"),
         (1, None, "10.1/x", "T", "2000", None, None),
         (2, "NaN", None, "Only title", None, None, None),
         (3, " 10.1/x ", None, "Other", None, "Roe, B.", None),
         (4, None, None, "Titled", "1999", "X", None)],
        "snippet_row long, doi string, doc_id string, title string, pub_year string, authors string, url string")
    m = dict((r.snippet_row, r.bibjson_id) for r in bib_map(rows).collect())
    assert m == {0: "10.1/x", 1: "10.1/x", 2: "row-2", 3: "10.1/x", 4: "Titled::1999"}
    recs = {(r.key_kind, r.id): r for r in bib_records(rows).collect()}
    assert set(recs) == {("doi", "10.1/x"), ("doc_id", "10.1/x"), ("title_year", "Titled::1999")}
    first = recs[("doi", "10.1/x")]
    assert [a.name for a in first.author] == ["Smith, J.", "Doe, A."]
    assert first.identifier[0].id == "10.1/x" and first.link[0].url == "https://a" and first.type == "article"
    assert recs[("doc_id", "10.1/x")].identifier == [] and recs[("doc_id", "10.1/x")].link is None
    js = [r.record_json for r in bib_json_lines(bib_records(rows)).collect()]
    assert all(j.startswith('{"id":') and '"link":' in j for j in js)


def test_author_shapes(spark):
    from termlens.functions.biblio import author_names

    df = spark.createDataFrame(
        [([{"name": None, "given": None, "family": "Roe"}, {"name": "A. B.", "given": "x", "family": "y"},
           {"name": " ", "given": "Jo", "family": "Doe"}],)],
        "a array<struct<name:string,given:string,family:string>>")
    assert df.select(author_names(df, "a")).first()[0] == ["Roe", "A. B.", "Jo Doe"]
    df2 = spark.createDataFrame([([" X ", "", None, "Y"],)], "a array<string>")
    assert df2.select(author_names(df2, "a")).first()[0] == ["X", "Y"]


def test_write_bibjson(spark):
    import json
    import os
    import tempfile

    from termlens.operators.bibliography import write_bibjson

    rows = spark.createDataFrame([(0, "10.1/x", "T", "2000", "A; B")],
                                 "snippet_row long, doi string, title string, pub_year string, authors string")
    out = tempfile.mkdtemp(prefix="termlens-bib-")
    write_bibjson(bib_records(rows), out, collection="test-collection", created="2026-01-01T00:00:00Z")
    header = json.loads(spark.read.text(os.path.join(out, "collection")).first()[0])
    assert header == {"collection": "test-collection", "metadata": {
        "created": "2026-01-01T00:00:00Z", "generator": "termlens (bibliography job)", "version": "0.2"}}
    rec = json.loads(spark.read.text(os.path.join(out, "records")).first()[0])
    assert rec["id"] == "10.1/x" and [a["name"] for a in rec["author"]] == ["A", "B"] and rec["year"] == 2000
def test_unicode_blanks_key_years_and_single_author(spark):
    rows = spark.createDataFrame(
        [(0, " ", None, "T", "2001.0", ("Ann", "Lee")), (1, "10.1/x ", None, "T", None, None),
         (2, None, None, "T", "2001", ("", "Roe"))],
        "snippet_row long, doi string, doc_id string, title string, pub_year string,"
        " authors struct<given: string, family: string>")
    assert {r.snippet_row: r.bibjson_id for r in bib_map(rows).collect()} == {0: "T::2001", 1: "10.1/x", 2: "T::2001"}
    recs = {r.id: r for r in bib_records(rows).collect()}
    assert [a.name for a in recs["T::2001"].author] == ["Ann Lee"] and recs["T::2001"].year is None
    assert recs["10.1/x"].author == []


def test_collections_by_term(spark):
    rows = spark.createDataFrame([("a", 0, "d1"), ("a", 1, "d1"), ("b", 0, "d1")],
                                 "search_term string, snippet_row long, doc_id string")
    by = ["search_term"]
    assert sorted(tuple(r) for r in bib_records(rows, by=by).select("search_term", "id").collect()) == [
        ("a", "d1"), ("b", "d1")]
    assert bib_map(rows, by=by).columns == ["search_term", "snippet_row", "bibjson_id"]
