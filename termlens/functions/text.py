"""Text cleaning as Catalyst column expressions (no Python UDF).

``fold_ascii``       — Unicode compatibility decomposition, accents dropped,
                       non-ASCII runs to one space, symbols outside a small
                       allowed set deleted, whitespace collapsed.
``preprocess_text``  — ``fold_ascii`` + lower case, punctuation and digits to
                       spaces, stop words and one-letter words dropped.
``word_tokens``      — whitespace tokenisation of cleaned text.

The decomposition is applied per character with a table built at import time
from :mod:`unicodedata`: characters whose decomposition (minus combining marks)
is a single ASCII character, or nothing, go through ``translate``; the few
hundred that expand to several characters including ASCII ones go through a
guarded ``replace`` fold.  Characters that decompose to non-ASCII text only are
left alone because they end up in the same space run either way.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from termlens.functions.stopwords import DEFAULT_STOP_WORDS

# ASCII whitespace as Python's ``str`` regexes see it (\t..\r, \x1c..\x1f, ' ').
WS_CLASS = r"\t-\r\x1c-\x20"
WS_RUN = "[" + WS_CLASS + "]+"
NON_ASCII_RUN = r"[^\x00-\x7F]+"
ASCII_RUN = r"[\x00-\x7F]+"
# Characters that survive symbol removal: word chars, whitespace, . , ; ' " ! ? ( ) -
# The other ASCII characters, each one named: Java tests a class of single characters by one look-up, of ranges one by one.
ILLEGAL_CHAR = "[" + "".join(rf"\x{i:02x}" for i in range(0x80) if not (
    chr(i).isalnum() or 0x09 <= i <= 0x0D or 0x1C <= i <= 0x20 or chr(i) in "_.,;'\"!?()-")) + "]"
# ASCII punctuation (Python's string.punctuation) as a class.
PUNCT_CLASS = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
DIGIT_RUN = "[0-9]+"


@functools.lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Return (translate_from, translate_to, expansions).

    ``translate_from`` holds the one-to-one characters followed by the
    characters to delete; ``translate_to`` is the shorter replacement string so
    the surplus characters of ``translate_from`` are deleted by ``translate``.
    """
    singles_from: list[str] = []
    singles_to: list[str] = []
    deletions: list[str] = []
    expansions: list[tuple[str, str]] = []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        dec = unicodedata.normalize("NFKD", ch)
        dec = "".join(c for c in dec if not unicodedata.combining(c))
        if dec == ch:
            continue
        if dec == "":
            deletions.append(ch)
        elif not any(ord(c) < 0x80 for c in dec):
            continue  # non-ASCII either way: becomes part of a space run
        elif len(dec) == 1:
            singles_from.append(ch)
            singles_to.append(dec)
        else:
            expansions.append((ch, dec))
    return "".join(singles_from) + "".join(deletions), "".join(singles_to), tuple(expansions)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_lit(s: str) -> str:
    """Spark SQL string literal (backslash escapes are on by default)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@functools.lru_cache(maxsize=None)
def _folded_sql(x: str) -> str:
    """SQL text of the folded ``x`` with its white space as it was.

    Built as one SQL string so the JVM parses the 2,500-character table and
    the 492 expansion pairs in one call, instead of thousands of py4j calls."""
    src, dst, expansions = fold_tables()
    pairs = ", ".join(f"named_struct('f', {sql_lit(a)}, 't', {sql_lit(b)})" for a, b in expansions)
    exp_chars = sql_lit("".join(a for a, _ in expansions))
    # Presence test by deleting the expanding characters from the other than ASCII ones: a hash lookup per
    # character (a 492-character regex class is a linear scan per character).
    expanding = (f"exists(array(regexp_replace(ft, {sql_lit(ASCII_RUN)}, '')),"
                 f" fr -> length(translate(fr, {exp_chars}, '')) < length(fr))")
    t = (f"transform(array(translate({x}, {sql_lit(src)}, {sql_lit(dst)})), ft -> CASE WHEN {expanding}"
         f" THEN aggregate(array({pairs}), ft, (acc, p) -> replace(acc, p.f, p.t)) ELSE ft END)[0]")
    # text of ASCII characters has nothing to fold: translate looks up every character
    t = f"CASE WHEN {x} RLIKE {sql_lit(NON_ASCII_RUN)} THEN regexp_replace({t}, {sql_lit(NON_ASCII_RUN)}, ' ') ELSE {x} END"
    return f"regexp_replace({t}, {sql_lit(ILLEGAL_CHAR)}, '')"


@functools.lru_cache(maxsize=None)
def fold_ascii_sql(x: str) -> str:
    """SQL text of :func:`fold_ascii` over the SQL expression ``x``."""
    return f"trim(regexp_replace({_folded_sql(x)}, {sql_lit(WS_RUN)}, ' '))"


def fold_ascii(text: str) -> Column:
    """ASCII folding of a string column given by name (null stays null)."""
    return F.expr(fold_ascii_sql(_ident(text)))


@functools.lru_cache(maxsize=None)
def preprocess_sql(x: str, stop_words: tuple[str, ...] | None = None) -> str:
    stops = stop_words if stop_words is not None else DEFAULT_STOP_WORDS
    t = f"lower({fold_ascii_sql(x)})"
    t = f"regexp_replace({t}, {sql_lit(PUNCT_CLASS)}, ' ')"
    t = f"regexp_replace({t}, {sql_lit(DIGIT_RUN)}, ' ')"
    words = f"split(trim(regexp_replace({t}, {sql_lit(WS_RUN)}, ' ')), ' ')"
    keep = "length(w) > 1"
    if stops:
        keep += " AND NOT w IN (" + ", ".join(sql_lit(w) for w in stops) + ")"
    return f"array_join(filter({words}, w -> {keep}), ' ')"


def preprocess_text(text: str, stop_words: Iterable[str] | None = None) -> Column:
    """Full cleaning: fold, lower, punctuation/digits to space, drop stop words
    and one-character words, single-space join.  ``stop_words=()`` disables the
    stop-word step; ``None`` uses the default list."""
    stops = tuple(stop_words) if stop_words is not None else None
    return F.expr(preprocess_sql(_ident(text), stops))


@functools.lru_cache(maxsize=None)
def preprocess_tokens_sql(x: str, stop_words: tuple[str, ...] | None = None, min_len: int = 2) -> str:
    """SQL text of the token array of :func:`preprocess_text` (the same words,
    in order) without building the cleaned string: after folding and lower
    case, punctuation, digits and whitespace all separate words, so the words
    are exactly the runs of ``[a-z]``."""
    stops = stop_words if stop_words is not None else DEFAULT_STOP_WORDS
    words = f"split(regexp_replace(lower({_folded_sql(x)}), '[^a-z]+', ' '), ' ')"
    keep = f"length(w) >= {max(min_len, 2)}"
    if stops:
        keep += " AND NOT w IN (" + ", ".join(sql_lit(w) for w in stops) + ")"
    return f"filter({words}, w -> {keep})"


def preprocess_tokens(text: str, stop_words: Iterable[str] | None = None, min_len: int = 2) -> Column:
    """Token array of the fully cleaned text of a column given by name; ``min_len``: shorter words are left out, too."""
    stops = tuple(stop_words) if stop_words is not None else None
    return F.expr(preprocess_tokens_sql(_ident(text), stops, min_len))


def word_tokens(text: Column | str) -> Column:
    """Whitespace tokens of already-cleaned text; empty strings dropped."""
    return F.filter(F.split(_col(text), " +"), lambda w: w != "")


# ---- fixed values: HTML cleaning ---------------------------------------------
# Elements whose content is not text, removed with their content.
HTML_DROP = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>|<!--.*?-->"
# Block-level tags become a line break (a fragment boundary), other tags vanish.
HTML_BLOCK = (r"(?i)</?(p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|article|section"
              r"|nav|header|footer|title|head|body|html|blockquote|pre)\b[^>]*>")
HTML_TAG = r"<[^>]*>"
# Character references decoded; &amp; last so '&amp;lt;' stays '&lt;'.
HTML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# ------------------------------------------------------------------------------


def strip_html_sql(x: str, dialect: str = "spark") -> str:
    """SQL text removing markup from the HTML expression ``x``."""
    if dialect == "spark":
        def sub(t, p, r):
            return f"regexp_replace({t}, {sql_lit(p)}, {sql_lit(r)})"
        lit = sql_lit
    else:
        def sub(t, p, r):
            return f"regexp_replace({t}, '{p.replace(chr(39), chr(39) * 2)}', '{r}', 'g')"

        def lit(v):
            return "'" + v.replace("'", "''") + "'"
    t = sub(x, HTML_DROP, " ")
    t = sub(t, HTML_BLOCK, "\n")
    t = sub(t, HTML_TAG, "")
    for ent, ch in HTML_ENTITIES:
        t = f"replace({t}, {lit(ent)}, {lit(ch)})"
    return t


def strip_html(html: str) -> Column:
    """Text of an HTML column given by name (scripts, styles and comments
    dropped, block tags to line breaks, entities decoded)."""
    return F.expr(strip_html_sql("`" + html + "`"))
