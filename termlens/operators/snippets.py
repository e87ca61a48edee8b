"""Keyword snippet extraction: documents x search terms -> snippet rows.

A document is cut into fragments on sentence marks before white space and on
new lines.  A fragment is a snippet of a term when the term, as a whole-word
phrase, occurs in it (case-insensitive; letters and digits are word characters,
so ``3.5 ma`` is three words).  Terms ending in ``*`` (stem at least three
characters) match any word starting with the stem.  Phrases with an inner ``*``
or over a sentence border (``mt. etna``) need word positions: they are refused
here and found by :mod:`termlens.operators.phrase_index`.
At most ``fragment_limit`` fragments per (term, document) are kept, in document
order.

Plan (one map-side pass over the corpus, one broadcast hash join):

    scan(doc_id, text, ..) -> fragments + their match form (once per document)
      -> explode(distinct words of the document)
      -> BroadcastHashJoin(word == first word of term)  [equi-join, no nested loop]
      -> filter/slice of the fragment array per (document, term)
      -> explode -> snippet rows

No shuffle: the fragment limit is a ``slice`` of an ordered array inside the
document row, not a window.  The term table is broadcast only after its size
has been checked; beyond the limit the join falls back to a shuffle join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.constants import DEFAULT_FRAGMENT_LIMIT, FRAGMENT_SPLIT
from termlens.functions.porter import porter_sql
from termlens.functions.text import preprocess_text
from termlens.session import cut_lineage

# Broadcast the term table up to this many rows (a term row is < 200 bytes).
MAX_BROADCAST_TERMS = 1_000_000
WILDCARD_KEY_LEN = 3
MAX_ROW_TERMS = 500            # of matched_terms


def check_wildcards(terms: Iterable[str]) -> None:
    for t in terms:
        if re.fullmatch(rf"\W*\w{{0,{WILDCARD_KEY_LEN - 1}}}\*", (t or "").strip()):
            raise ValueError(f"a wildcard needs {WILDCARD_KEY_LEN} characters before it: {t!r}")


UNSCANNABLE = r"\*.*\w|[.!?][\t-\r ]+.*\w"


def check_scannable(terms: Iterable[str] | DataFrame) -> None:
    """Refuse terms that a scan of single fragments can't find."""
    if isinstance(terms, DataFrame):
        c = F.trim(F.col(terms.columns[0]))
        terms = [r[0] for r in terms.select(c.alias("t")).where(F.col("t").rlike(UNSCANNABLE)).limit(1).collect()]
    for t in terms:
        if re.search(UNSCANNABLE, (t or "").strip()):
            raise ValueError(f"a wildcard inside a term, or a term over a sentence border, needs a phrase index: {t!r}")


def terms_frame(spark: SparkSession, terms: Iterable[str] | DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(search_term, wildcard, pattern, join_key) for a list or a one-column
    DataFrame of terms.  ``search_term`` is the lower-cased term; the pattern
    keeps the term's case when matching is case-sensitive."""
    if isinstance(terms, DataFrame):
        check_scannable(terms)
        base = terms.select(F.trim(F.col(terms.columns[0])).alias("_given"))
    else:
        terms = list(terms)
        check_wildcards(terms)
        check_scannable(terms)
        uniq = sorted({t.strip() if case_sensitive else t.strip().lower() for t in terms if t and t.strip()})
        if not uniq:
            base = spark.createDataFrame([], T.StructType([T.StructField("_given", T.StringType())]))
        else:  # a VALUES list is a LocalRelation: no Python RDD, size known
            vals = ", ".join("('" + t.replace("\\", "\\\\").replace("'", "\\'") + "')" for t in uniq)
            base = spark.sql(f"SELECT * FROM VALUES {vals} AS t(_given)")
    given = F.col("_given") if case_sensitive else F.lower(F.col("_given"))
    base = base.select(F.lower(F.col("_given")).alias("search_term"), given.alias("_given"))
    if isinstance(terms, DataFrame):
        base = base.dropDuplicates(["_given"])
    wild = F.col("_given").endswith("*")
    stem = F.regexp_replace(F.col("_given"), r"\*$", "")
    norm = F.trim(F.regexp_replace(stem, r"[^\p{L}\p{N}]+", " "))
    return base.select(
        "search_term",
        wild.alias("wildcard"),
        F.concat(F.lit(" "), norm, F.when(wild, F.lit("")).otherwise(F.lit(" "))).alias("pattern"),
        # the first word of several is complete, so only a single word is joined on its prefix
        F.when(wild & ~F.contains(norm, F.lit(" ")), F.substring(norm, 1, WILDCARD_KEY_LEN))
        .otherwise(F.split(norm, " ")[0]).alias("join_key"),
    ).where(F.col("join_key") != "")


def _stem_terms(t: DataFrame) -> DataFrame:
    """Term table matched on stems: pattern and join key from the Porter
    stems of the term's words (wildcard terms keep their prefix)."""
    words = "split(trim(pattern), ' ')"
    stem_pat = f"concat(' ', array_join(transform({words}, sw -> {porter_sql('sw')}), ' '), ' ')"
    return t.select(
        "search_term", "wildcard",
        F.when(F.col("wildcard"), F.col("pattern")).otherwise(F.expr(stem_pat)).alias("pattern"),
        F.when(F.col("wildcard"), F.col("join_key")).otherwise(
            F.expr(f"transform(array(join_key), sw -> {porter_sql('sw')})[0]")).alias("join_key"))


def _stem_forms(t: DataFrame, words: DataFrame) -> DataFrame:
    """Term table with ``forms``: for each place of the term the corpus words (column word) of that stem, and ``padded``:
    these with a blank on both sides; only terms with a word for every place.  A different word is stemmed once, and only
    if it begins like a word of a term: no Porter rule changes a word's first letter."""
    places = t.select("search_term", F.posexplode(F.split(F.trim("pattern"), " ")).alias("i", "stem"))
    first = F.broadcast(places.select(F.substring("stem", 1, 1).alias("_first")).distinct())
    words = words.withColumn("_first", F.substring("word", 1, 1)).join(first, "_first", "left_semi").select("word").distinct()
    # the stem inside an explode: in a plain column, the join's filter would compute it twice
    stems = words.select("word", F.explode(F.expr(f"transform(array(word), sw -> {porter_sql('sw')})")).alias("stem"))
    held = stems.join(F.broadcast(places), "stem").groupBy("search_term", "i").agg(F.array_sort(F.collect_set("word")).alias("w"))
    terms = held.groupBy("search_term").agg(F.array_sort(F.collect_list(F.struct("i", "w")))["w"].alias("forms"))
    size = places.groupBy("search_term").agg(F.count(F.lit(1)).alias("k"))
    terms = cut_lineage(terms.join(size, "search_term").where(F.size("forms") == F.col("k")).drop("k"))
    return terms.withColumn("padded", F.expr("transform(forms, fs -> transform(fs, f -> concat(' ', f, ' ')))"))


def _says(n: Column) -> Column:
    """Whether the fragment ``n`` (single blanks, also at both ends) has a form of every place of a term in a row."""
    each = F.forall("padded", lambda fs: F.exists(fs, lambda f: F.contains(n, f)))
    k = F.size("forms")
    row = F.exists(F.array(F.split(F.trim(n), " ")), lambda ws: F.exists(
        F.sequence(F.lit(0), F.greatest(F.size(ws) - k, F.lit(0))), lambda p: F.forall(
            F.sequence(F.lit(0), k - 1), lambda j: F.array_contains(F.get("forms", j), F.coalesce(F.get(ws, p + j), F.lit(""))))))
    return F.when(each, F.when(k == 1, F.lit(True)).otherwise(row)).otherwise(F.lit(False))


def _maybe_broadcast(df: DataFrame, limit: int, known_rows: int | None = None) -> DataFrame:
    """Broadcast hint only behind a size check (a Python term list is counted
    for free; a term DataFrame costs one small job)."""
    rows = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if rows <= limit else df


def extract_snippets(docs: DataFrame, terms: Iterable[str] | DataFrame,
                     fragment_limit: int | None = DEFAULT_FRAGMENT_LIMIT,
                     doc_col: str = "doc_id", text_col: str = "text",
                     carry: Iterable[str] | None = None, case_sensitive: bool = False,
                     acquired_before: str | None = None, acquired_col: str = "acquired",
                     stemmed: bool = False) -> DataFrame:
    """Snippet rows: search_term, <doc_col>, frag_idx (0-based), carried
    columns, highlight (the raw fragment).

    ``case_sensitive`` matches the terms' own case; ``acquired_before`` keeps
    documents whose ``acquired_col`` is earlier than that date (a predicate
    pushed to the Parquet scan); ``stemmed`` matches Porter stems of the
    words (``volcanic arcs`` is a snippet of ``volcanic arc``): the different
    words of the documents are stemmed once, and the documents searched for
    those of a term's stems (with wildcards or in the terms' own case, each
    document's words are stemmed inside its row)."""
    spark = docs.sparkSession
    if acquired_before is not None:
        docs = docs.where(F.col(acquired_col) < F.to_date(F.lit(acquired_before)))
    carry = [c for c in (carry if carry is not None else docs.columns)
             if c not in (doc_col, text_col) and not (acquired_before is not None and c == acquired_col)]
    if isinstance(terms, DataFrame):
        tf = terms_frame(spark, terms, case_sensitive)
        t = _maybe_broadcast(_stem_terms(tf) if stemmed else tf, MAX_BROADCAST_TERMS)
        wild = t.where("wildcard").limit(1).count() > 0
    else:
        terms = [x for x in terms]
        tf = terms_frame(spark, terms, case_sensitive)
        t = _maybe_broadcast(_stem_terms(tf) if stemmed else tf, MAX_BROADCAST_TERMS, len(terms))
        wild = any(x.strip().endswith("*") for x in terms)

    # The match form of the whole document is computed once: every run of
    # characters that are neither letters/digits nor a fragment border (one new
    # line) becomes a space, so splitting it yields fragments aligned one-to-one
    # with the raw ones.
    marked = F.regexp_replace(F.col(text_col), FRAGMENT_SPLIT, "\n")
    text = marked if case_sensitive else F.lower(marked)
    norm_text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    frags = docs.select(doc_col, *carry, F.split(marked, "\n").alias("frags"), norm_text.alias("_norm"))
    words = F.split(F.trim(F.regexp_replace("_norm", r"[\n ]+", " ")), " ")
    by_form = stemmed and not wild and not case_sensitive    # else the stems are made inside the row
    if by_form:
        forms = _stem_forms(t, frags.select(F.explode(F.array_distinct(words)).alias("word")))
        forms = _maybe_broadcast(forms, MAX_BROADCAST_TERMS)
        own = F.col("forms")[0]
        cand = frags.withColumn("_words", F.array_distinct(words)).select("*", F.explode_outer("_words").alias("join_key")).join(
            forms.withColumn("join_key", F.explode(own)), "join_key")
        # one row of a document and term: the first form that the document has
        cand = cand.where(F.col("join_key") == F.array_intersect(own, "_words")[0]).drop("join_key", "_words")
    elif stemmed:
        words = F.expr(f"transform(array_distinct(split(trim(regexp_replace(_norm, '[\\\\n ]+', ' ')), ' ')),"
                       f" sw -> {porter_sql('sw')})")
    if wild:
        words = F.concat(words, F.transform(words, lambda w: F.substring(w, 1, WILDCARD_KEY_LEN)))
    if not by_form:
        cand = frags.select("*", F.explode(F.array_distinct(words)).alias("join_key"))
        cand = cand.join(t, "join_key").drop("join_key")

    if stemmed and not by_form:
        norms = F.expr(f"transform(split(_norm, '\\\\n'), fr -> concat(' ', array_join(transform("
                       f"split(trim(fr), ' '), sw -> {porter_sql('sw')}), ' '), ' '))")
    else:
        norms = F.transform(F.split("_norm", "\n"),
                            lambda n: F.concat(F.lit(" "), F.trim(n), F.lit(" ")))
    tagged = F.transform("frags", lambda f, i: F.struct(i.alias("frag_idx"), f.alias("highlight")))
    hit = F.filter(F.arrays_zip(tagged.alias("s"), norms.alias("n")),
                   lambda z: _says(z["n"]) if by_form else F.contains(z["n"], F.col("pattern")))
    # two spellings of a term may match the same fragment
    spellings = case_sensitive and t.groupBy("search_term").count().where("count > 1").limit(1).count() > 0
    if fragment_limit is not None and not spellings:
        hit = F.slice(hit, 1, int(fragment_limit))
    out = cand.select("search_term", doc_col, *carry, F.explode(hit).alias("z"))
    out = out.select("search_term", doc_col, F.col("z.s.frag_idx").alias("frag_idx"), *carry,
                     F.col("z.s.highlight").alias("highlight"))
    if spellings:
        out = out.dropDuplicates(["search_term", doc_col, "frag_idx"])
        if fragment_limit is not None:
            nth = F.row_number().over(Window.partitionBy("search_term", doc_col).orderBy("frag_idx"))
            out = out.withColumn("_nth", nth).where(F.col("_nth") <= int(fragment_limit)).drop("_nth")
    return out


def matched_terms(text_col: str, terms: Iterable[str]) -> Column:
    """Array of the (lower-cased) terms of a list that have a snippet in the text, found inside the row; for lists of
    up to ``MAX_ROW_TERMS`` (each term is one search of the text)."""
    terms = sorted({t.strip().lower() for t in terms if t and t.strip()})
    if len(terms) > MAX_ROW_TERMS:
        raise ValueError(f"at most {MAX_ROW_TERMS} terms: use extract_snippets")
    check_wildcards(terms)
    check_scannable(terms)
    marked = F.lower(F.regexp_replace(text_col, FRAGMENT_SPLIT, "\n"))
    # one blank around every word, and a line end between fragments that no pattern holds
    norm = F.regexp_replace(F.regexp_replace(marked, r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", " \n ")
    norm = F.concat(F.lit(" "), F.trim(norm), F.lit(" "))

    def pattern(t: str) -> str:
        return " " + " ".join(re.findall(r"[^\W_]+", t)) + ("" if t.endswith("*") else " ")

    terms = [t for t in terms if re.search(r"[^\W_]", t)]
    if not terms:
        return F.array().cast("array<string>")
    return F.transform(F.array(norm), lambda n: F.array_compact(F.array(
        *[F.when(F.contains(n, F.lit(pattern(t))), F.lit(t)) for t in terms])))[0]


def with_processed_text(snippets: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """Adds ``processed_text`` = full cleaning of ``highlight``."""
    return snippets.withColumn("processed_text", preprocess_text("highlight", stop_words))
