"""DuckDB SQL for the registered queries (the independent correctness check).

Every builder returns plain SQL over the driver views (``documents``,
``embeddings`` ...).  The SQL restates each definition directly — nested-loop
phrase match, window ranks, row-at-a-time CASE chains — rather than the Spark
plan, so a disagreement points at a real difference.
"""

from __future__ import annotations

import re

from termlens.constants import DEFAULT_FRAGMENT_LIMIT, DEFAULT_TERMS, FRAGMENT_SPLIT, TOKENS_PER_DOCUMENT
from termlens.functions.lemma import lemma_candidates_sql
from termlens.functions.porter import porter_sql
from termlens.functions.stopwords import DEFAULT_STOP_WORDS
from termlens.functions.tagging import RUN, candidates_sql, tags_sql
from termlens.functions.text import fold_tables

WS = r"[\t-\r\x1c-\x20]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def terms_cte(terms=DEFAULT_TERMS) -> str:
    vals = ", ".join(f"({q(t.lower())})" for t in sorted(set(terms)))
    return (f"terms AS (SELECT search_term, ' ' || trim(regexp_replace(search_term, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
            f" || CASE WHEN suffix(search_term, '*') THEN '' ELSE ' ' END AS pattern FROM (VALUES {vals}) v(search_term))")


def fold_sql(x: str) -> str:
    """ASCII folding: accents stripped, then the same three regexes."""
    _, _, expansions = fold_tables()
    t = f"strip_accents({x})"
    t = f"regexp_replace({t}, '[^\\x00-\\x7F]+', ' ', 'g')"
    t = f"regexp_replace({t}, '[^A-Za-z0-9_\\t-\\r\\x1c-\\x20.,;''\"!?()\\-]', '', 'g')"
    return f"trim(regexp_replace({t}, '{WS}', ' ', 'g'))"


def stop_list_sql(stops=DEFAULT_STOP_WORDS) -> str:
    return "[" + ", ".join(q(w) for w in stops) + "]"


def preprocess_sql(x: str, stops=DEFAULT_STOP_WORDS) -> str:
    t = f"lower({fold_sql(x)})"
    t = f"regexp_replace({t}, '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', ' ', 'g')"
    t = f"regexp_replace({t}, '[0-9]+', ' ', 'g')"
    words = f"string_split(trim(regexp_replace({t}, '{WS}', ' ', 'g')), ' ')"
    if stops:
        keep = f"lambda w: length(w) > 1 AND NOT list_contains({stop_list_sql(stops)}, w)"
    else:
        keep = "lambda w: length(w) > 1"
    return f"array_to_string(list_filter({words}, {keep}), ' ')"


def fragments_sql(x: str) -> str:
    """List of the fragments of the text ``x``."""
    return f"string_split(regexp_replace({x}, {q(FRAGMENT_SPLIT)}, chr(10), 'g'), chr(10))"


def case_sensitive_sql(terms) -> str:
    """Snippets of terms in their own case."""
    vals = ", ".join(f"({q(t.strip())})" for t in terms)
    return f"""SELECT DISTINCT lower(t) AS search_term, doc_id, CAST(i - 1 AS INTEGER) AS frag_idx, publisher, lang, f[i] AS highlight
FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (
        SELECT doc_id, source AS publisher, lang, {fragments_sql('text')} AS f FROM documents)), (VALUES {vals}) v(t)
WHERE contains(' ' || regexp_replace(f[i], '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' ' || t || ' ')"""


def stemmed_sql(terms, docs: str = "documents", columns: str = "doc_id, source AS publisher, lang") -> str:
    """Snippets by the stems of the words."""
    def stems(x: str) -> str:
        return (f"list_transform(string_split(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '),"
                f" lambda sw: {porter_sql('sw', 'duckdb')})")

    vals = ", ".join(f"({q(t.lower())})" for t in terms)
    return f"""WITH wanted AS (SELECT t AS search_term, ' ' || array_to_string({stems('t')}, ' ') || ' ' AS pattern FROM (VALUES {vals}) v(t)),
frag AS (SELECT * EXCLUDE (f, i), CAST(i - 1 AS INTEGER) AS frag_idx, f[i] AS highlight FROM (
           SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT {columns}, {fragments_sql('text')} AS f FROM {docs}))),
stemmed AS (SELECT *, ' ' || array_to_string({stems('highlight')}, ' ') || ' ' AS norm FROM frag)
SELECT search_term, s.* EXCLUDE (norm) FROM stemmed s JOIN wanted w ON contains(s.norm, w.pattern)"""


def snippets_ctes(terms=DEFAULT_TERMS, limit=DEFAULT_FRAGMENT_LIMIT, processed: bool = True) -> str:
    """CTEs ``terms``, ``frags``, ``snippets`` (search_term, doc_id, frag_idx,
    publisher, lang, highlight[, processed_text])."""
    proc = f", {preprocess_sql('highlight')} AS processed_text" if processed else ""
    return f"""{terms_cte(terms)},
frags AS (
  SELECT doc_id, publisher, lang, unnest(parts) AS highlight, unnest(range(0, len(parts))) AS frag_idx
  FROM (SELECT doc_id, source AS publisher, lang, {fragments_sql('text')} AS parts FROM documents)),
fragn AS (
  SELECT *, ' ' || trim(regexp_replace(lower(highlight), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS norm FROM frags),
matched AS (
  SELECT t.search_term, f.doc_id, f.frag_idx, f.publisher, f.lang, f.highlight,
         row_number() OVER (PARTITION BY t.search_term, f.doc_id ORDER BY f.frag_idx) AS rk
  FROM fragn f JOIN terms t ON contains(f.norm, t.pattern)),
snippets AS (
  SELECT search_term, doc_id, CAST(frag_idx AS INTEGER) AS frag_idx, publisher, lang, highlight{proc}
  FROM matched{f' WHERE rk <= {int(limit)}' if limit is not None else ''})"""


def phrase_sql(terms) -> str:
    """Snippets of phrases with sentence marks and wildcards inside: every word of the corpus with its place."""
    rows = []
    for term in sorted({t.strip().lower() for t in terms}):
        pieces = re.findall(r"[^\W_]+\*?|[.!?]+(?=\s)", term)
        words = [(w, j > 0 and pieces[j - 1][0] in ".!?") for j, w in enumerate(pieces) if w[0] not in ".!?"]
        rows += [f"({q(term)}, {i}, {len(words)}, {q(w.rstrip('*'))}, {w.endswith('*')}, {cross})" for i, (w, cross) in enumerate(words)]
    return f"""WITH wanted(search_term, i, k, token, wild, crosses) AS (VALUES {', '.join(rows)}),
cut AS (SELECT doc_id, source AS publisher, lang, {fragments_sql('text')} AS f,
               regexp_extract_all(text, {q(FRAGMENT_SPLIT)}) AS s FROM documents),
frag AS (SELECT doc_id, publisher, lang, f, s, unnest(range(1, len(f) + 1)) AS fi FROM cut),
said AS (SELECT doc_id, fi, ws, unnest(range(1, len(ws) + 1)) AS wi
         FROM (SELECT doc_id, fi, regexp_extract_all(lower(f[fi]), '[\\p{{L}}\\p{{N}}]+') AS ws FROM frag)),
placed AS (SELECT doc_id, fi, ws[wi] AS word, row_number() OVER (PARTITION BY doc_id ORDER BY fi, wi) AS pos FROM said),
hit AS (SELECT w.search_term, p.doc_id, p.pos - w.i AS start, w.i, w.k, w.crosses, p.fi
        FROM placed p JOIN wanted w ON CASE WHEN w.wild THEN starts_with(p.word, w.token) ELSE p.word = w.token END),
linked AS (SELECT *, lag(fi) OVER (PARTITION BY search_term, doc_id, start ORDER BY i) AS before FROM hit),
phrase AS (SELECT search_term, doc_id, min(fi) AS a, max(fi) AS b FROM linked GROUP BY search_term, doc_id, start
           HAVING count(*) = any_value(k) AND bool_and(crosses OR before IS NULL OR before = fi)),
found AS (SELECT search_term, doc_id, a, max(b) AS b FROM phrase GROUP BY 1, 2, 3)
SELECT m.search_term, m.doc_id, CAST(a - 1 AS INTEGER) AS frag_idx, publisher, lang,
       array_to_string(list_transform(range(a, b + 1), lambda x: f[x] || CASE WHEN x < b THEN s[x] ELSE '' END), '') AS highlight
FROM found m JOIN cut USING (doc_id)"""


def clitics_sql(x: str) -> str:
    once = f"regexp_replace(lower({x}), {q(chr(110) + chr(39) + 't')}, {q(' n' + chr(39) + 't')}, 'g')"
    return f"regexp_replace({once}, {q(chr(39) + '(s|m|d|ll|re|ve)' + chr(92) + 'b')}, {q(' ' + chr(39) + chr(92) + '1')}, 'g')"


def tagged_lemmas_sql() -> str:
    """Lemmas by part of speech of ``documents``."""
    from termlens.operators.tokens import DEFAULT_UNWANTED_WORDS, SENTENCE, TOKEN_PATTERN

    return f"""WITH sents AS (SELECT doc_id, list_transform(regexp_extract_all({clitics_sql('text')}, {q(SENTENCE)}),
    lambda s: list_filter(regexp_extract_all(s, {q(TOKEN_PATTERN)}), lambda w: NOT list_contains({list(DEFAULT_UNWANTED_WORDS)}, w))) AS ss
  FROM documents),
cut AS (SELECT doc_id, flatten(list_transform(list_filter(ss, lambda t: len(t) > 0), lambda t:
          list_transform(range((len(t) - 1) // {RUN} + 1), lambda k: t[k * {RUN} + 1:k * {RUN} + {RUN}]))) AS runs FROM sents),
run AS (SELECT doc_id, runs[r] AS words, r FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS r FROM cut)),
tagged AS (SELECT doc_id, r, words, {tags_sql('words', 'duckdb')} AS tags FROM run),
tok AS (SELECT doc_id, r, i, words[i] AS word, tags[i] AS tag FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM tagged)),
pairs AS (SELECT DISTINCT word, tag FROM tok),
known AS (SELECT DISTINCT word AS cand FROM pairs),
best AS (SELECT word, tag, first(cand ORDER BY length(cand), cand) AS lemma FROM (
           SELECT word, tag, unnest({candidates_sql('word', 'tag', 'duckdb')}) AS cand FROM pairs) JOIN known USING (cand) GROUP BY ALL),
made AS (SELECT doc_id, string_agg(coalesce(lemma, t.word), ' ' ORDER BY r, i) AS cleaned
         FROM tok t LEFT JOIN best b ON t.word = b.word AND t.tag = b.tag GROUP BY doc_id)
SELECT d.doc_id, coalesce(cleaned, '') AS cleaned FROM documents d LEFT JOIN made USING (doc_id)"""


def page_snippets_sql(terms=DEFAULT_TERMS, limit=DEFAULT_FRAGMENT_LIMIT) -> str:
    from termlens.functions.text import strip_html_sql
    from termlens.sources.tables import HOST_PATTERN

    body = snippets_ctes(terms, limit)
    pages = (f"(SELECT page_id AS doc_id, {strip_html_sql('html', 'duckdb')} AS text,"
             f" regexp_extract(url, '{HOST_PATTERN}', 1) AS source, NULL AS lang FROM pages)")
    body = body.replace("AS parts FROM documents)", f"AS parts FROM {pages})")
    body = body.replace(", f.lang,", ",").replace("publisher, lang, highlight", "publisher, highlight")
    return f"WITH {body} SELECT * FROM snippets"


def tokens_cte(name: str = "tokens") -> str:
    return (f"{name} AS (SELECT search_term, unnest(list_filter(string_split_regex(processed_text, ' +'),"
            f" lambda w: w <> '')) AS word FROM snippets)")


def lemma_ctes(key: str = "") -> str:
    """``vocab``, ``lemmas`` (word, lemma) over snippet tokens; with the column
    ``key`` each of its values has a vocabulary of its own."""
    k, ck, on = (f"{key}, ", f"c.{key}, ", f" AND v.{key} = c.{key}") if key else ("", "", "")
    return f"""vocab AS (SELECT DISTINCT {k}word FROM tokens),
lemma_cands AS (SELECT {k}word, unnest({lemma_candidates_sql('word')}) AS cand FROM vocab WHERE length(word) > 2),
lemma_best AS (
  SELECT {k}word, first(cand ORDER BY length(cand), cand) AS lemma FROM (
    SELECT {ck}c.word, c.cand FROM lemma_cands c JOIN vocab v ON v.word = c.cand{on}) GROUP BY {k}word),
lemmas AS (
  SELECT {k}v.word, coalesce(b.lemma, v.word) AS lemma FROM vocab v LEFT JOIN lemma_best b USING ({k}word))"""


def cooccurrence_sql(terms=DEFAULT_TERMS, total_docs: int = 16023367, n: int = 1000000,
                     lemmatize: bool = True) -> str:
    word = "l.lemma" if lemmatize else "t.word"
    join = "JOIN lemmas l ON l.word = t.word AND l.search_term = t.search_term" if lemmatize else ""
    lem = ("," + lemma_ctes("search_term")) if lemmatize else ""
    return f"""WITH {snippets_ctes(terms)},
{tokens_cte()}{lem},
counts AS (
  SELECT t.search_term, {word} AS word, count(*) AS cnt FROM tokens t {join}
  WHERE length(t.word) > 2 GROUP BY ALL),
kept AS (
  SELECT * FROM counts
  WHERE NOT list_contains(string_split(search_term, ' '), word)
    AND NOT list_contains(list_transform(string_split(search_term, ' '), lambda x: x || 's'), word)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY search_term ORDER BY cnt DESC, word) AS rk FROM kept),
topn AS (SELECT search_term, word, cnt, {porter_sql('word', 'duckdb')} AS stem FROM ranked WHERE rk <= {int(n)}),
dedup AS (
  SELECT *, row_number() OVER (PARTITION BY search_term, stem ORDER BY cnt DESC, word) AS srk FROM topn)
SELECT search_term AS word_1, word AS word_2, cnt AS count,
       cnt / CAST({int(total_docs) * TOKENS_PER_DOCUMENT} AS DOUBLE) AS prob_w1w2
FROM dedup WHERE srk = 1"""


def cooc_body(name: str, terms, total_docs: int, n: int = 1000000, lemmatize: bool = True) -> str:
    """A CTE ``name`` holding the co-occurrence table for ``terms`` (own
    snippets/vocabulary CTEs, prefixed so several can coexist)."""
    sql = cooccurrence_sql(terms, total_docs, n, lemmatize)
    body = sql[len("WITH "):]
    pre = name + "_"
    for cte in ("terms", "frags", "fragn", "matched", "snippets", "tokens", "vocab", "lemma_cands",
                "lemma_best", "lemmas", "counts", "kept", "ranked", "topn", "dedup"):
        body = re.sub(rf"\b{cte}\b", pre + cte, body)
    head, final = body.rsplit("\nSELECT search_term AS word_1", 1)
    return f"{head},\n{name} AS (SELECT search_term AS word_1{final})"


def term_counts_sql_body(snip: str, total_docs: int) -> str:
    return (f"SELECT lower(search_term) AS word, count(*) AS count,"
            f" count(*) / CAST({int(total_docs) * TOKENS_PER_DOCUMENT} AS DOUBLE) AS probability"
            f" FROM {snip} GROUP BY 1")
