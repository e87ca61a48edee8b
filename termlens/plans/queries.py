"""Registered queries: name -> Spark job over the driver tables, plus the
DuckDB SQL that checks it (absent for the approximate neighbour jobs).

Every query reads the driver tables under ``sf_dir`` whole.  Search terms and
the other knobs are parameters, fixed here so the Spark job and the SQL agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.constants import BIBJSON_GENERATOR, BIBJSON_VERSION, DEFAULT_TERMS, QUERY_TOTAL_DOCS, TOKENS_PER_DOCUMENT
from termlens.functions.biblio import parse_year, split_authors
from termlens.functions.text import fold_ascii, preprocess_text
from termlens.operators import bibliography as bib
from termlens.operators import cooccurrence as co
from termlens.operators import corpus as cs
from termlens.operators import information as inf
from termlens.operators import neighbours as nb
from termlens.operators import network as nw
from termlens.operators import similarity as sim
from termlens.operators import store as st
from termlens.operators import text_similarity as ts
from termlens.operators.phrase_index import PhraseIndex
from termlens.operators.rowindex import dense_index
from termlens.operators.snippets import extract_snippets, matched_terms, with_processed_text
from termlens.operators.tokens import TOKEN_PATTERN, clean_tokens, clean_tokens_by_tag
from termlens.plans import oracle as o
from termlens.session import cut_lineage, scratch_table_path
from termlens.sources.snippets_io import page_documents, rejected_pages
from termlens.sources.tables import CITATION_COLUMNS, citations, citations_sql, corpus, page_corpus, spread, table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
TD = QUERY_TOTAL_DOCS
DENOM = TD * TOKENS_PER_DOCUMENT
TERMS = tuple(sorted(set(t.lower() for t in DEFAULT_TERMS)))
EXISTING_TERMS = TERMS[0:3]          # an earlier run processed these ...
INCOMING_TERMS = TERMS[2:5]          # ... a later run these (one overlaps)
LEDGER_TERMS = TERMS[0:2]
REMOVED_TERM = "thing"
EDGE_MIN_COUNT = 3
FRAGMENT_LIMIT = 2                   # of snippets_limited: small enough to bind
WILDCARD_TERMS = ("nich*", "of th*", "thing")
SINGLE_TERM = ("of the",)            # run alone
# marks and wildcards inside a phrase, a phrase over a sentence border, a word that doesn't occur
PHRASE_TERMS = ("2.0", "example.com", "mail* example.com", "the. of", "of th* a*", "th* nicht", "of the", "thing*", "no such words")
CASE_TERMS = ("The", "the", "Of the", "Nicht")
STEM_TERMS = ("things", "of the", "retions", "nichts")
ACQUIRED_BEFORE = "2021-06-01"
NETWORK_TERMS = ("nicht", "thing")   # of network_neighbourhood


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn
    return deco


def snippets(spark: SparkSession, sf_dir: str, terms=TERMS) -> DataFrame:
    return with_processed_text(extract_snippets(corpus(spark, sf_dir), terms))


def cooc(spark, sf_dir, terms=TERMS, **kw) -> DataFrame:
    return co.cooccurrence_stats(snippets(spark, sf_dir, terms), TD, **kw)


def snippet_table(spark: SparkSession, sf_dir: str, terms=TERMS) -> DataFrame:
    """Snippets extracted once and written to the checkpoint directory, for
    queries that read them in several branches (per-term extraction is
    independent, so a term subset is a filter of this table)."""
    return cut_lineage(snippets(spark, sf_dir, terms))


def of_terms(snips: DataFrame, terms) -> DataFrame:
    return snips.where(F.col("search_term").isin(list(terms)))


def _snip_sql(prefix: str, terms) -> str:
    import re

    body = o.snippets_ctes(terms)
    for cte in ("terms", "frags", "fragn", "matched", "snippets"):
        body = re.sub(rf"\b{cte}\b", prefix + cte, body)
    return body


SNIP = f"WITH {o.snippets_ctes(TERMS)}"


# ---- text functions ---------------------------------------------------------

@register("fold_ascii", "SELECT doc_id, " + o.fold_sql("text") + " AS folded FROM documents")
def q_fold_ascii(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", fold_ascii("text").alias("folded"))


@register("preprocess_text", "SELECT doc_id, " + o.preprocess_sql("text") + " AS processed_text FROM documents")
def q_preprocess_text(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", preprocess_text("text").alias("processed_text"))


# ---- extraction ---------------------------------------------------------------

@register("snippets_by_term", f"{SNIP} SELECT * FROM snippets")
def q_snippets_by_term(spark, sf_dir):
    return snippets(spark, sf_dir)


@register("snippets_limited", f"WITH {o.snippets_ctes(TERMS, FRAGMENT_LIMIT)} SELECT * FROM snippets")
def q_snippets_limited(spark, sf_dir):
    """The fragment limit as a feature: the first fragments of each (term, document)."""
    return with_processed_text(extract_snippets(corpus(spark, sf_dir), TERMS, FRAGMENT_LIMIT))


@register("snippets_wildcard", f"WITH {o.snippets_ctes(WILDCARD_TERMS)} SELECT * FROM snippets")
def q_snippets_wildcard(spark, sf_dir):
    return snippets(spark, sf_dir, WILDCARD_TERMS)


@register("snippet_rows", f"""{SNIP}
SELECT search_term, doc_id, frag_idx, CAST(row_number() OVER (PARTITION BY search_term ORDER BY doc_id, frag_idx) - 1
       AS BIGINT) AS snippet_row FROM snippets""")
def q_snippet_rows(spark, sf_dir):
    s = snippets(spark, sf_dir).select("search_term", "doc_id", "frag_idx")
    return dense_index(s, ["search_term"], ["doc_id", "frag_idx"], "snippet_row")


@register("phrase_snippets", o.phrase_sql(PHRASE_TERMS))
def q_phrase_snippets(spark, sf_dir):
    """Phrases found through a positional index of the whole corpus."""
    index = PhraseIndex.build(corpus(spark, sf_dir), scratch_table_path(spark, "phrases"), buckets=16)
    return index.snippets(PHRASE_TERMS)


@register("snippets_case_sensitive", o.case_sensitive_sql(CASE_TERMS))
def q_snippets_case_sensitive(spark, sf_dir):
    return extract_snippets(corpus(spark, sf_dir), CASE_TERMS, case_sensitive=True)


@register("snippets_stemmed", o.stemmed_sql(STEM_TERMS))
def q_snippets_stemmed(spark, sf_dir):
    return extract_snippets(corpus(spark, sf_dir), STEM_TERMS, stemmed=True)


@register("snippets_acquired_before", f"""WITH {o.snippets_ctes(TERMS, processed=False)}
SELECT * FROM snippets WHERE DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) < DATE '{ACQUIRED_BEFORE}'""")
def q_snippets_acquired_before(spark, sf_dir):
    """Only documents acquired (a date made from the id) before a day."""
    docs = corpus(spark, sf_dir).withColumn("acquired", F.expr("date_add(DATE '2020-01-01', cast(doc_id % 1000 as int))"))
    return extract_snippets(docs, TERMS, acquired_before=ACQUIRED_BEFORE)


@register("page_snippets", o.page_snippets_sql(TERMS))
def q_page_snippets(spark, sf_dir):
    return with_processed_text(extract_snippets(page_corpus(spark, sf_dir), TERMS))


# ---- co-occurrence --------------------------------------------------------------

@register("cooccurrence_stats", o.cooccurrence_sql(TERMS, TD))
def q_cooccurrence_stats(spark, sf_dir):
    return cooc(spark, sf_dir)


@register("cooccurrence_single",
          f"WITH {o.cooc_body('c', TERMS, TD)} SELECT * FROM c WHERE word_1 = {o.q(SINGLE_TERM[0])}")
def q_cooccurrence_single(spark, sf_dir):
    """One term run alone has the rows that it has among others."""
    return cooc(spark, sf_dir, SINGLE_TERM)


@register("cooccurrence_top_n",o.cooccurrence_sql(TERMS, TD, n=200))
def q_cooccurrence_top_n(spark, sf_dir):
    return cooc(spark, sf_dir, n=200)


LARGE_N = 1500                       # more than a partial limit takes, and fewer than some terms have


@register("cooccurrence_top_1500", o.cooccurrence_sql(TERMS, TD, n=LARGE_N))
def q_cooccurrence_top_1500(spark, sf_dir):
    """A large n that binds: the tie group at the cut is split, no term is sorted whole."""
    return cooc(spark, sf_dir, n=LARGE_N)


@register("cooccurrence_surface", o.cooccurrence_sql(TERMS, TD, lemmatize=False))
def q_cooccurrence_surface(spark, sf_dir):
    return cooc(spark, sf_dir, lemmatize=False)


@register("cooccurrence_top_pairs",
          f"WITH {o.cooc_body('c', TERMS, TD)} SELECT * FROM c ORDER BY count DESC, word_1, word_2 LIMIT 10")
def q_cooccurrence_top_pairs(spark, sf_dir):
    return co.top_pairs(cooc(spark, sf_dir), 10)


@register("stem_groups", f"""{SNIP}, {o.tokens_cte()},
v AS (SELECT DISTINCT word FROM tokens),
s AS (SELECT word, {o.porter_sql('word', 'duckdb')} AS stem FROM v)
SELECT word, stem, count(*) OVER (PARTITION BY stem) AS group_size FROM s""")
def q_stem_groups(spark, sf_dir):
    return co.stem_groups(snippets(spark, sf_dir))


@register("lemma_fold", f"""{SNIP}, {o.tokens_cte()}, {o.lemma_ctes()}
SELECT word, lemma FROM lemmas WHERE length(word) > 2""")
def q_lemma_fold(spark, sf_dir):
    words = cut_lineage(co.token_counts(snippets(spark, sf_dir)).select("word").distinct())
    return co.lemma_map(words.where(F.length("word") > 2), words)


@register("clean_tokens", f"""SELECT item_id, array_to_string(list_transform(list_filter(
  regexp_extract_all(regexp_replace(regexp_replace(lower(text), 'n''t', ' n''t', 'g'),
                     '''(s|m|d|ll|re|ve)\\b', ' ''\\1', 'g'), '{o.q("n't|'[a-z]+|[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]")[1:-1]}'),
  lambda w: NOT list_contains(['httpdoc', 'example'], w)), lambda tk: {o.porter_sql('tk', 'duckdb')}), ' ') AS cleaned
FROM benchmark""")
def q_clean_tokens(spark, sf_dir):
    b = spread(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")
    return clean_tokens(b, id_col="item_id")


UNWANTED = ("the", "of", "der", "que")      # occur in the data


@register("clean_tokens_unwanted", f"""SELECT doc_id, array_to_string(list_transform(list_filter(
  regexp_extract_all({o.clitics_sql('text')}, {o.q(TOKEN_PATTERN)}),
  lambda w: NOT list_contains({list(UNWANTED)}, w)), lambda tk: {o.porter_sql('tk', 'duckdb')}), ' ') AS cleaned
FROM documents WHERE text IS NOT NULL""")
def q_clean_tokens_unwanted(spark, sf_dir):
    """Stems of all documents without a caller's unwanted words."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where("text IS NOT NULL")
    return clean_tokens(d, unwanted=UNWANTED)


@register("clean_tokens_lemma", o.tagged_lemmas_sql())
def q_clean_tokens_lemma(spark, sf_dir):
    """Lemmas by part of speech of all documents."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return clean_tokens_by_tag(d)


# ---- corpus statistics --------------------------------------------------------------

@register("term_counts", f"{SNIP} {o.term_counts_sql_body('snippets', TD)}")
def q_term_counts(spark, sf_dir):
    return cs.term_counts(snippets(spark, sf_dir), TD)


@register("corpus_stats", f"""WITH {o.cooc_body('c', TERMS, TD)}, {_snip_sql('s_', TERMS)},
agg AS (SELECT search_term, count(*) AS total_snippets, count(DISTINCT doc_id) AS total_documents,
               count(DISTINCT publisher) AS unique_publishers FROM s_snippets GROUP BY 1),
cagg AS (SELECT word_1 AS search_term, sum(count) AS tok, count(DISTINCT word_2) AS uniq FROM c GROUP BY 1)
SELECT a.search_term, total_snippets, total_documents,
       CAST(coalesce(tok, 0) + total_snippets AS BIGINT) AS total_tokens,
       CAST(coalesce(uniq, 0) + 1 AS BIGINT) AS unique_terms, unique_publishers
FROM agg a LEFT JOIN cagg USING (search_term)""")
def q_corpus_stats(spark, sf_dir):
    s = snippet_table(spark, sf_dir)
    return cs.corpus_summary(s, co.cooccurrence_stats(s, TD))


@register("extraction_profile", f"""{SNIP}, cit AS ({citations_sql()})
SELECT s.search_term, count(*) AS num_rows, count(DISTINCT c.journal) AS unique_journals,
       count(DISTINCT c.authors) AS unique_authors
FROM snippets s JOIN cit c ON c.snippet_row = s.doc_id GROUP BY 1""")
def q_extraction_profile(spark, sf_dir):
    # the citation fields are computed on the document rows and carried
    # through the extraction: one scan, no join back
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").selectExpr("text", *CITATION_COLUMNS)
    docs = docs.withColumnRenamed("snippet_row", "doc_key").drop("doc_id")
    s = extract_snippets(docs, TERMS, doc_col="doc_key", carry=["journal", "authors"])
    return cs.extraction_profile(s)


TFIDF_SQL = f"""per_doc AS (SELECT search_term, doc_id, count(*) AS num_snippets FROM snippets
                   WHERE doc_id IS NOT NULL GROUP BY 1, 2),
dfs AS (SELECT search_term, count(*) AS df FROM per_doc GROUP BY 1),
tfidf AS (SELECT p.search_term, p.doc_id, p.num_snippets, p.num_snippets / {float(TOKENS_PER_DOCUMENT)} AS tf,
       (p.num_snippets / {float(TOKENS_PER_DOCUMENT)}) * ln({float(TD)} / (d.df + 1)) AS tfidf
       FROM per_doc p JOIN dfs d USING (search_term))"""


@register("tfidf_by_term", f"{SNIP}, {TFIDF_SQL} SELECT * FROM tfidf")
def q_tfidf_by_term(spark, sf_dir):
    return cs.tfidf(snippets(spark, sf_dir), TD)


@register("doc_snippet_text", f"""{SNIP}
SELECT search_term, doc_id, string_agg(highlight, ' ' ORDER BY frag_idx) AS text FROM snippets GROUP BY 1, 2""")
def q_doc_snippet_text(spark, sf_dir):
    return cs.doc_snippet_text(snippets(spark, sf_dir))


@register("doc_vectors", f"""{SNIP}, {TFIDF_SQL}
SELECT doc_id, list(search_term ORDER BY search_term) AS terms, list(tfidf ORDER BY search_term) AS weights
FROM tfidf GROUP BY 1""")
def q_doc_vectors(spark, sf_dir):
    return cs.doc_vectors(cs.tfidf(snippets(spark, sf_dir), TD))


# ---- bibliography ------------------------------------------------------------------

CIT = f"WITH cit AS ({citations_sql()})"
BLANKS = "' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f '"
NANIFY = "CASE WHEN {x} IS NULL OR lower({x}) = 'nan' OR trim({x}, " + BLANKS + ") = '' THEN NULL ELSE {x} END"


def _clean_sql(x: str) -> str:
    return f"nullif(trim({NANIFY.format(x=x)}, {BLANKS}), '')"


def _year_sql(pub_year: str, cover: str, number: str = "^([0-9]+)$") -> str:
    y = f"trim({NANIFY.format(x=pub_year)}, {BLANKS})"
    cd = f"regexp_extract(trim({NANIFY.format(x=cover)}, {BLANKS}), '^([0-9]{{4}})', 1)"
    return f"coalesce(TRY_CAST(regexp_extract({y}, '{number}', 1) AS INTEGER), TRY_CAST({cd} AS INTEGER))"


def _key_year_sql(pub_year: str, cover: str) -> str:
    return _year_sql(pub_year, cover, r"^([0-9]+)(\.[0-9]*)?$")


def _keys_sql(head: str) -> str:
    """``keyed``: the rows of ``cit`` (made by ``head``) with their bibliography keys."""
    return f"""{head},
k AS (SELECT *, {_clean_sql('doi')} AS cdoi, {_clean_sql('doc_id')} AS cdoc, {_clean_sql('title')} AS ctitle,
             {_key_year_sql('pub_year', 'coverdate')} AS cyear FROM cit),
keyed AS (SELECT *,
  CASE WHEN cdoi IS NOT NULL THEN 'doi' WHEN cdoc IS NOT NULL THEN 'doc_id'
       WHEN ctitle IS NOT NULL AND cyear IS NOT NULL AND cyear <> 0 THEN 'title_year' ELSE 'row' END AS key_kind,
  CASE WHEN cdoi IS NOT NULL THEN cdoi WHEN cdoc IS NOT NULL THEN cdoc
       WHEN ctitle IS NOT NULL AND cyear IS NOT NULL AND cyear <> 0 THEN ctitle || '::' || CAST(cyear AS VARCHAR)
       ELSE 'row-' || CAST(snippet_row AS VARCHAR) END AS bibjson_id FROM k)"""


AUTHORS_SQL = ("list_filter(list_transform(string_split_regex(coalesce({a}, ''), ';|, and | and |\\|'),"
               " lambda x: trim(x, " + BLANKS + ")), lambda x: x <> '')")
AUTHORS_SQL = AUTHORS_SQL.replace("{a}", NANIFY.format(x="authors"))


def _records_sql(head: str, by: str = "") -> str:
    """``recs``: one record per key, within each value of the columns ``by``."""
    return f"""{_keys_sql(head)},
firsts AS (SELECT * FROM keyed WHERE key_kind <> 'row'
           QUALIFY row_number() OVER (PARTITION BY {by}key_kind, bibjson_id ORDER BY snippet_row) = 1),
recs AS (SELECT {by}bibjson_id AS id, key_kind, 'article' AS type, coalesce(ctitle, '') AS title,
                {AUTHORS_SQL} AS names, {_year_sql('pub_year', 'coverdate')} AS year, {_clean_sql('journal')} AS journal,
                {_clean_sql('publisher')} AS publisher, cdoi AS doi, {_clean_sql('url')} AS url FROM firsts)"""


KEYS_SQL, RECORDS_SQL = _keys_sql(CIT), _records_sql(CIT)
# snippets with the citation fields of their documents, numbered within their term
TERM_CIT = f"""{SNIP}, docs AS ({citations_sql()}),
cit AS (SELECT s.search_term, d.* EXCLUDE (snippet_row),
               row_number() OVER (PARTITION BY s.search_term ORDER BY s.doc_id, s.frag_idx) - 1 AS snippet_row
        FROM snippets s JOIN docs d ON d.snippet_row = s.doc_id)"""


def _term_citations(spark, sf_dir) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").selectExpr("text", *CITATION_COLUMNS)
    s = extract_snippets(docs.withColumnRenamed("snippet_row", "doc_key"), TERMS, doc_col="doc_key").drop("highlight")
    return dense_index(s, ["search_term"], ["doc_key", "frag_idx"], "snippet_row")


@register("bib_map_by_term", f"{_keys_sql(TERM_CIT)} SELECT search_term, snippet_row, bibjson_id FROM keyed")
def q_bib_map_by_term(spark, sf_dir):
    return bib.bib_map(_term_citations(spark, sf_dir), by=["search_term"])


@register("bib_records_by_term", f"""{_records_sql(TERM_CIT, 'search_term, ')}
SELECT search_term, id, key_kind, type, title, year, journal, publisher, array_to_string(names, ' | ') AS author_names,
       CAST(len(names) AS INTEGER) AS n_authors, doi, url FROM recs""")
def q_bib_records_by_term(spark, sf_dir):
    by = ["search_term"]
    return bib.bib_records_flat(bib.bib_records(_term_citations(spark, sf_dir), by=by), by)


@register("parse_year", f"{CIT} SELECT snippet_row, {_year_sql('pub_year', 'coverdate')} AS year FROM cit")
def q_parse_year(spark, sf_dir):
    c = citations(spark, sf_dir)
    return c.select("snippet_row", parse_year(F.col("pub_year"), F.lit(None).cast("string"),
                                              F.col("coverdate")).alias("year"))


@register("split_authors", f"""{CIT}
SELECT snippet_row, CAST(pos - 1 AS INTEGER) AS pos, names[pos] AS name FROM (
  SELECT snippet_row, names, unnest(range(1, len(names) + 1)) AS pos FROM (
    SELECT snippet_row, {AUTHORS_SQL} AS names FROM cit))""")
def q_split_authors(spark, sf_dir):
    c = citations(spark, sf_dir)
    return c.select("snippet_row", F.posexplode(split_authors("authors")).alias("pos", "name"))


@register("bib_map", f"{KEYS_SQL} SELECT snippet_row, bibjson_id FROM keyed")
def q_bib_map(spark, sf_dir):
    return bib.bib_map(citations(spark, sf_dir))


@register("bib_records", f"""{RECORDS_SQL}
SELECT id, key_kind, type, title, year, journal, publisher, array_to_string(names, ' | ') AS author_names,
       CAST(len(names) AS INTEGER) AS n_authors, doi, url FROM recs""")
def q_bib_records(spark, sf_dir):
    return bib.bib_records_flat(bib.bib_records(citations(spark, sf_dir)))


@register("bib_json", f"""{RECORDS_SQL}
SELECT id, to_json({{'id': id, 'type': type, 'title': title,
  'author': list_transform(names, lambda n: {{'name': n}}), 'year': year, 'journal': journal,
  'publisher': publisher,
  'identifier': CASE WHEN doi IS NOT NULL THEN [{{'type': 'doi', 'id': doi}}] ELSE [] END,
  'link': CASE WHEN url IS NOT NULL THEN [{{'url': url, 'content_type': 'text/html'}}] END}})::VARCHAR
  AS record_json FROM recs""")
def q_bib_json(spark, sf_dir):
    return bib.bib_json_lines(bib.bib_records(citations(spark, sf_dir)))


@register("bib_collections", f"""{SNIP}
SELECT DISTINCT search_term, to_json({{'collection': search_term,
  'metadata': {{'created': '2024-01-02T03:04:05Z', 'generator': {o.q(BIBJSON_GENERATOR)}, 'version': {o.q(BIBJSON_VERSION)}}}}})::VARCHAR
  AS header_json FROM snippets""")
def q_bib_collections(spark, sf_dir):
    """The header of each term's collection, with a given creation stamp."""
    terms = snippets(spark, sf_dir).select("search_term").distinct()
    return terms.withColumn("header_json", bib.collection_header(F.col("search_term"), "2024-01-02T03:04:05Z"))


# Response pages made of the documents, one a page; every tenth is cut off, every eleventh an error.
def _pages(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id").where("text IS NOT NULL")
    doc = F.expr("""named_struct('_gddid', concat('g', doc_id), 'year', 1990 + doc_id % 30, 'source', source,
        'landing_page', if(doc_id % 2 = 0, concat('https://example.org/', doc_id), NULL), 'author', array('A. One', lang),
        'highlight', split(text, '\\n'), 'lang', lang, 'score', doc_id % 7)""")
    page = F.to_json(F.struct(F.struct(F.array(doc).alias("data")).alias("success")))
    broken = F.when(F.col("doc_id") % 10 == 9, F.substring(page, 1, 40)).when(F.col("doc_id") % 11 == 10, F.lit('{"error": "gone"}'))
    return d.select(F.concat(F.lit("p"), F.col("doc_id")).alias("path"), F.coalesce(broken, page).alias("value"))


PAGE_ROWS = "doc_id % 10 <> 9 AND doc_id % 11 <> 10 AND text IS NOT NULL"


@register("response_documents", f"""SELECT 'g' || doc_id AS doc_id, CAST(1990 + doc_id % 30 AS VARCHAR) AS year, source,
  CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id END AS landing_page, 'A. One | ' || lang AS authors,
  md5(array_to_string(string_split(text, chr(10)), '|')) AS highlights, len(string_split(text, chr(10))) AS n_highlights,
  '{{"lang":"' || lang || '","score":' || (doc_id % 7) || '}}' AS extra FROM documents WHERE {PAGE_ROWS}""")
def q_response_documents(spark, sf_dir):
    """Documents of raw response pages: known fields typed, all others kept."""
    d = page_documents(_pages(spark, sf_dir))
    return d.select("doc_id", "year", "source", "landing_page", F.array_join("author.name", " | ").alias("authors"),
                    F.md5(F.array_join("highlight", "|").cast("binary")).alias("highlights"),
                    F.size("highlight").cast("long").alias("n_highlights"), "extra")


@register("response_rejects", f"""SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 10 = 9 THEN 'not JSON' ELSE 'no list success.data' END AS reason
FROM documents WHERE text IS NOT NULL AND NOT ({PAGE_ROWS})""")
def q_response_rejects(spark, sf_dir):
    """Response pages set aside, with the reason."""
    return rejected_pages(_pages(spark, sf_dir))


# ---- table maintenance ----------------------------------------------------------------

@register("pending_terms", f"""WITH {o.cooc_body('ex', EXISTING_TERMS, TD)}, {_snip_sql('a_', TERMS)}
SELECT DISTINCT search_term FROM a_snippets WHERE search_term NOT IN (SELECT word_1 FROM ex)""")
def q_pending_terms(spark, sf_dir):
    s = snippet_table(spark, sf_dir)
    done = co.cooccurrence_stats(of_terms(s, EXISTING_TERMS), TD).select(F.col("word_1").alias("search_term"))
    cand = s.select("search_term").distinct()
    return st.pending(cand, done, "search_term")


@register("stats_cleaned", f"""WITH {o.cooc_body('c', TERMS, TD)}
SELECT * FROM c WHERE word_2 IS NOT NULL AND trim(word_2) <> ''""")
def q_stats_cleaned(spark, sf_dir):
    return st.clean_stats(cooc(spark, sf_dir))


@register("cooccurrence_upsert", f"""WITH {o.cooc_body('ex', EXISTING_TERMS, TD)}, {o.cooc_body('inc', INCOMING_TERMS, TD)}
SELECT * FROM ex WHERE (word_1, word_2) NOT IN (SELECT (word_1, word_2) FROM inc)
UNION ALL SELECT word_1, word_2, count + 1 AS count, prob_w1w2 FROM inc""")
def q_cooccurrence_upsert(spark, sf_dir):
    s = snippet_table(spark, sf_dir, sorted(set(EXISTING_TERMS) | set(INCOMING_TERMS)))
    ex = co.cooccurrence_stats(of_terms(s, EXISTING_TERMS), TD)
    inc = co.cooccurrence_stats(of_terms(s, INCOMING_TERMS), TD).withColumn("count", F.col("count") + 1)
    return st.upsert(ex, inc, st.KEYS["term_cooccurrence"])


@register("term_counts_upsert", f"""WITH {_snip_sql('e_', EXISTING_TERMS)}, {_snip_sql('i_', INCOMING_TERMS)},
ex AS ({o.term_counts_sql_body('e_snippets', TD)}),
inc AS (SELECT word, count + 1 AS count, probability FROM ({o.term_counts_sql_body('i_snippets', TD)}))
SELECT * FROM ex WHERE word NOT IN (SELECT word FROM inc) UNION ALL SELECT * FROM inc""")
def q_term_counts_upsert(spark, sf_dir):
    s = snippet_table(spark, sf_dir, sorted(set(EXISTING_TERMS) | set(INCOMING_TERMS)))
    ex = cs.term_counts(of_terms(s, EXISTING_TERMS), TD)
    inc = cs.term_counts(of_terms(s, INCOMING_TERMS), TD).withColumn("count", F.col("count") + 1)
    return st.upsert(ex, inc, st.KEYS["term_counts"])


@register("processed_terms_merge", f"""WITH {o.cooc_body('ex', LEDGER_TERMS, TD)}, {_snip_sql('a_', TERMS)}
SELECT DISTINCT word_1 AS term FROM ex UNION SELECT DISTINCT search_term AS term FROM a_snippets""")
def q_processed_terms_merge(spark, sf_dir):
    s = snippet_table(spark, sf_dir)
    ledger = co.cooccurrence_stats(of_terms(s, LEDGER_TERMS), TD).select(F.col("word_1").alias("term")).distinct()
    inc = s.select(F.col("search_term").alias("term"))
    return st.insert_if_absent(ledger, inc, ["term"])


def _store(spark) -> st.TableStore:
    return st.TableStore(spark, scratch_table_path(spark, "tables"), buckets=8)


@register("cooccurrence_store_merge", f"""WITH {o.cooc_body('ex', EXISTING_TERMS, TD)}, {o.cooc_body('inc', INCOMING_TERMS, TD)}
SELECT * FROM ex WHERE (word_1, word_2) NOT IN (SELECT (word_1, word_2) FROM inc)
UNION ALL SELECT word_1, word_2, count + 1 AS count, prob_w1w2 FROM inc""")
def q_cooccurrence_store_merge(spark, sf_dir):
    """The upsert through stored tables: written, merged by touched buckets, read back."""
    s = snippet_table(spark, sf_dir, sorted(set(EXISTING_TERMS) | set(INCOMING_TERMS)))
    store = _store(spark)
    store.merge("term_cooccurrence", co.cooccurrence_stats(of_terms(s, EXISTING_TERMS), TD))
    inc = co.cooccurrence_stats(of_terms(s, INCOMING_TERMS), TD).withColumn("count", F.col("count") + 1)
    store.merge("term_cooccurrence", inc)
    return store.read("term_cooccurrence")


@register("remove_term_tables", f"""WITH {o.cooc_body('c', TERMS, TD)}, {_snip_sql('a_', TERMS)},
tc AS ({o.term_counts_sql_body('a_snippets', TD)})
SELECT 'term_cooccurrence' AS table_name, word_1 AS a, word_2 AS b, count FROM c
WHERE NOT (word_1 = '{REMOVED_TERM}' OR word_2 = '{REMOVED_TERM}')
UNION ALL SELECT 'term_counts', word, NULL, count FROM tc WHERE word <> '{REMOVED_TERM}'
UNION ALL SELECT DISTINCT 'processed_terms', search_term, NULL, CAST(NULL AS BIGINT) FROM a_snippets WHERE search_term <> '{REMOVED_TERM}'""")
def q_remove_term_tables(spark, sf_dir):
    """All three stored tables after one removal."""
    s = snippet_table(spark, sf_dir)
    store = _store(spark)
    with store.change() as c:
        c.write("term_cooccurrence", co.cooccurrence_stats(s, TD))
        c.write("term_counts", cs.term_counts(s, TD))
        c.write("processed_terms", s.select(F.col("search_term").alias("term")).distinct())
    store.remove_term(f"  {REMOVED_TERM.upper()} ")
    none = F.lit(None).cast("string")
    return store.read("term_cooccurrence").select(F.lit("term_cooccurrence").alias("table_name"), F.col("word_1").alias("a"),
                                                  F.col("word_2").alias("b"), "count").unionByName(
        store.read("term_counts").select(F.lit("term_counts").alias("table_name"), F.col("word").alias("a"), none.alias("b"), "count")
    ).unionByName(store.read("processed_terms").select(F.lit("processed_terms").alias("table_name"), F.col("term").alias("a"),
                                                       none.alias("b"), F.lit(None).cast("long").alias("count")))


@register("store_preview", f"WITH {o.cooc_body('c', TERMS, TD)} SELECT * FROM c ORDER BY count DESC, word_1, word_2 LIMIT 10")
def q_store_preview(spark, sf_dir):
    """The ten largest pairs of a saved table, read again."""
    store = _store(spark)
    store.write("term_cooccurrence", cooc(spark, sf_dir))
    return co.top_pairs(st.TableStore(spark, store.root).read("term_cooccurrence"), 10)


@register("stats_blank_words", f"""WITH {o.cooc_body('c', TERMS, TD)},
b AS (SELECT word_1, CASE length(word_2) WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN '   ' ELSE word_2 END AS word_2, count, prob_w1w2 FROM c)
SELECT * FROM b WHERE word_2 IS NOT NULL AND trim(word_2) <> ''""")
def q_stats_blank_words(spark, sf_dir):
    """Rows that do lose their blank words."""
    blank = F.expr("CASE length(word_2) WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN '   ' ELSE word_2 END")
    return st.clean_stats(cooc(spark, sf_dir).withColumn("word_2", blank))


@register("remove_term", f"""WITH {o.cooc_body('c', TERMS, TD)}
SELECT * FROM c WHERE NOT (word_1 = '{REMOVED_TERM}' OR word_2 = '{REMOVED_TERM}')""")
def q_remove_term(spark, sf_dir):
    c = cooc(spark, sf_dir)  # only the co-occurrence branch is returned
    ledger = c.select(F.col("word_1").alias("term")).distinct()
    counts = c.select(F.col("word_1").alias("word"), "count")
    return st.remove_term(ledger, c, counts, f"  {REMOVED_TERM.upper()} ")[1]


# ---- information measures and networks --------------------------------------------------

DOC_WORDS_SQL = f"""dw AS (SELECT DISTINCT doc_id, word FROM (
  SELECT doc_id, unnest(list_filter(string_split_regex({o.preprocess_sql('text')}, ' +'),
         lambda w: length(w) >= 3)) AS word FROM documents)),
nd AS (SELECT count(*) AS n FROM documents)"""
LN2 = "ln(2.0)"


def _plogp(p: str) -> str:
    return f"(CASE WHEN ({p}) > 0 THEN ({p}) * ln({p}) / {LN2} ELSE 0.0 END)"


def _h(p: str) -> str:
    return f"(-({_plogp(p)} + {_plogp('1 - (' + p + ')')}))"


@register("word_entropy", f"""WITH {DOC_WORDS_SQL}
SELECT word, count(*) AS df, count(*) / CAST(any_value(n) AS DOUBLE) AS p,
       round({_h('count(*) / CAST(any_value(n) AS DOUBLE)')}, 12) AS entropy
FROM dw, nd GROUP BY word""")
def q_word_entropy(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return inf.word_entropy(inf.doc_words(docs), docs.count())


PAIR_SQL = f"""{SNIP}, {DOC_WORDS_SQL},
td AS (SELECT DISTINCT search_term, doc_id FROM snippets),
nt AS (SELECT search_term, count(*) AS n_term FROM td GROUP BY 1),
nw AS (SELECT word, count(*) AS n_word FROM dw GROUP BY 1),
n11 AS (SELECT search_term, word, count(*) AS n11 FROM td JOIN dw USING (doc_id) GROUP BY 1, 2),
cells AS (SELECT search_term, word, n11, n_term, n_word, CAST(n AS DOUBLE) AS n FROM n11
          JOIN nt USING (search_term) JOIN nw USING (word), nd),
info AS (SELECT search_term, word, n11, n_term, n_word,
  {_h('n_term / n')} AS ht, {_h('n_word / n')} AS hw,
  -({_plogp('n11 / n')} + {_plogp('(n_term - n11) / n')} + {_plogp('(n_word - n11) / n')}
    + {_plogp('(n - n_term - n_word + n11) / n')}) AS htw FROM cells)"""


@register("joint_entropy", f"""{PAIR_SQL}
SELECT search_term, word, n11, round(htw, 12) AS joint_entropy FROM info""")
def q_joint_entropy(spark, sf_dir):
    return _pairs(spark, sf_dir).select("search_term", "word", "n11", "joint_entropy")


@register("mutual_information", f"""{PAIR_SQL}
SELECT search_term, word, n11, n_term, n_word, round(ht, 12) AS h_term, round(hw, 12) AS h_word,
       round(ht + hw - htw, 12) AS mutual_information FROM info""")
def q_mutual_information(spark, sf_dir):
    return _pairs(spark, sf_dir).drop("joint_entropy")


def _pairs(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return inf.document_information(docs, matched_terms("text", TERMS), docs.count())


PAIR_WORDS = 300


@register("joint_entropy_words", f"""WITH {DOC_WORDS_SQL},
top AS (SELECT word, count(*) AS df FROM dw GROUP BY 1 ORDER BY df DESC, word LIMIT {PAIR_WORDS}),
held AS (SELECT doc_id, word, df FROM dw JOIN top USING (word)),
cells AS (SELECT a.word AS word_1, b.word AS word_2, count(*) AS n11, a.df AS n_1, b.df AS n_2, CAST(any_value(n) AS DOUBLE) AS n
          FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.word < b.word, nd GROUP BY a.word, b.word, a.df, b.df),
info AS (SELECT *, -({_plogp('n11 / n')} + {_plogp('(n_1 - n11) / n')} + {_plogp('(n_2 - n11) / n')}
                     + {_plogp('(n - n_1 - n_2 + n11) / n')}) AS h12 FROM cells)
SELECT word_1, word_2, n11, n_1, n_2, round(h12, 12) AS joint_entropy,
       round({_h('n_1 / n')} + {_h('n_2 / n')} - h12, 12) AS mutual_information FROM info""")
def q_joint_entropy_words(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return inf.word_pair_information(docs, docs.count(), PAIR_WORDS)


@register("pmi", f"""WITH {o.cooc_body('c', TERMS, TD)}, {_snip_sql('a_', TERMS)},
tc AS ({o.term_counts_sql_body('a_snippets', TD)})
SELECT c.word_1, c.word_2, c.prob_w1w2, t1.probability AS p_word_1, t2.probability AS p_word_2,
       round(ln(c.prob_w1w2 / (t1.probability * t2.probability)) / {LN2}, 12) AS pmi
FROM c JOIN tc t1 ON t1.word = c.word_1 JOIN tc t2 ON t2.word = c.word_2""")
def q_pmi(spark, sf_dir):
    s = snippet_table(spark, sf_dir)
    return inf.pmi(co.cooccurrence_stats(s, TD), cs.term_counts(s, TD))


EDGES_SQL = f"""WITH {o.cooc_body('c', TERMS, TD)},
e AS (SELECT word_1 AS source, word_2 AS target, count AS weight, prob_w1w2 AS prob FROM c
      WHERE prob_w1w2 >= {EDGE_MIN_COUNT} / CAST({DENOM} AS DOUBLE))"""


def _edges(spark, sf_dir):
    return nw.network_edges(cooc(spark, sf_dir), min_prob=EDGE_MIN_COUNT / float(DENOM))


@register("network_edges", f"{EDGES_SQL} SELECT * FROM e")
def q_network_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@register("network_nodes", f"""{EDGES_SQL},
ends AS (SELECT source AS node, weight, TRUE AS s FROM e UNION ALL SELECT target, weight, FALSE FROM e)
SELECT node, count(*) AS degree, sum(weight) AS strength,
       CASE WHEN bool_or(s) THEN 'term' ELSE 'word' END AS type FROM ends GROUP BY node""")
def q_network_nodes(spark, sf_dir):
    return nw.network_nodes(_edges(spark, sf_dir))


@register("network_neighbourhood", f"""{EDGES_SQL},
near AS (SELECT * FROM e WHERE source IN ({', '.join(map(o.q, NETWORK_TERMS))})),
lex AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark),
ends AS (SELECT source AS node, weight, TRUE AS s FROM near UNION ALL SELECT target, weight, FALSE FROM near)
SELECT node, count(*) AS degree, sum(weight) AS strength,
       CASE WHEN node IN (SELECT word FROM lex WHERE word IS NOT NULL) THEN 'benchmark'
            WHEN bool_or(s) THEN 'term' ELSE 'word' END AS type FROM ends GROUP BY node""")
def q_network_neighbourhood(spark, sf_dir):
    """Nodes around some terms, typed by a lexicon (the words of the benchmark)."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    edges = nw.network_edges(cooc(spark, sf_dir), EDGE_MIN_COUNT / float(DENOM), terms=NETWORK_TERMS)
    return nw.network_nodes(edges, words.distinct().withColumn("type", F.lit("benchmark")))


# ---- neighbours (approximate: no SQL oracle) ----------------------------------------------

TEXT_COSINE = 0.8


@register("text_similarity", f"""WITH tk AS (
  SELECT doc_id, list_sort(list_filter(string_split_regex({o.preprocess_sql('text')}, ' +'), lambda w: length(w) >= 3)) AS t FROM documents),
cls AS (SELECT min(doc_id) AS id, count(*) AS n, t FROM tk WHERE len(t) > 0 GROUP BY t),
tf AS (SELECT id, n, word, count(*) AS tf FROM (SELECT id, n, unnest(t) AS word FROM cls) GROUP BY ALL),
dfs AS (SELECT word, sum(n) AS df FROM tf GROUP BY 1),
w AS (SELECT id, n, word, tf * ln((SELECT sum(n) FROM cls) / (df + 1)) AS w FROM tf JOIN dfs USING (word)),
u AS (SELECT id, n, word, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w WHERE w > 0)
SELECT a.id AS class_id, a.n AS n_docs, b.id AS similar_class_id, b.n AS similar_n_docs, round(sum(a.w * b.w), 6) AS cosine
FROM u a JOIN u b ON a.word = b.word AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= {TEXT_COSINE}""")
def q_text_similarity(spark, sf_dir):
    """Pairs of documents (copies as one) of like vocabulary."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return ts.similar_classes(docs, TEXT_COSINE).withColumn("cosine", F.round("cosine", 6))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


@register("similarity_forest", None)
def q_similarity_forest(spark, sf_dir):
    return sim.nearest_neighbours(_vectors(spark, sf_dir))


@register("similarity_pending", "SELECT vec_id AS doc_id FROM embeddings WHERE label IS DISTINCT FROM 1")
def q_similarity_pending(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    earlier = sim.nearest_neighbours(e.where(F.col("label") == 1)
                                     .select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")))
    return st.pending(e.select(F.col("vec_id").alias("doc_id")), earlier, "doc_id")


def _knn_sql(name: str, k: int, where: str = "") -> str:
    return f"""{name}_v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings {where}),
{name}_u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM {name}_v),
{name}_p AS (SELECT a.vec_id AS doc_id, b.vec_id AS similar_doc_id,
                    1 - sqrt(greatest(0, 2 - 2 * list_dot_product(a.e, b.e) / (a.n * b.n))) AS s
             FROM {name}_u a JOIN {name}_u b ON a.vec_id <> b.vec_id),
{name} AS (SELECT doc_id, similar_doc_id, round(s, 6) AS similarity FROM {name}_p
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, similar_doc_id) < {k})"""


def _exact(items: DataFrame, k: int = 10) -> DataFrame:
    return nb.exact_neighbours(items, k).withColumn("similarity", F.round("similarity", 6))


@register("similarity_knn", f"WITH {_knn_sql('nn', 10)} SELECT * FROM nn")
def q_similarity_knn(spark, sf_dir):
    return _exact(_vectors(spark, sf_dir))


@register("similarity_lsh", None)
def q_similarity_lsh(spark, sf_dir):
    return nb.hashed_neighbours(_vectors(spark, sf_dir))


@register("similarity_upsert", f"""WITH {_knn_sql('earlier', 5, 'WHERE label = 1')}, {_knn_sql('later', 10)}
SELECT * FROM earlier WHERE (doc_id, similar_doc_id) NOT IN (SELECT (doc_id, similar_doc_id) FROM later) UNION ALL SELECT * FROM later""")
def q_similarity_upsert(spark, sf_dir):
    """A later run over all vectors replaces and adds to an earlier one over some."""
    some = table(spark, sf_dir, "embeddings").where(F.col("label") == 1)
    earlier = _exact(some.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), 5)
    return st.upsert(earlier, _exact(_vectors(spark, sf_dir)), st.KEYS["similarity_results"])
