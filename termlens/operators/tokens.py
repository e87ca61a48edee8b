"""Token cleaning: tokenise, drop unwanted words, stem or lemmatise.

Tokens: words (letters, digits, underscore), the clitics ``n't`` and
``'s 'm 'd 'll 're 've`` split off their word, and every other non-space
character on its own.  Stemming applies the Porter rules to every token inside
the row (a Catalyst expression).  Lemmatising needs the vocabulary: tokens are
exploded with their position, distinct tokens are mapped to lemmas once (see
:func:`termlens.operators.cooccurrence.lemma_map`), and each document's tokens
are put back in order — one group per document, bounded by its length.

:func:`clean_tokens_by_tag` lemmatises by part of speech: sentences (cut into runs
of at most ``RUN`` tokens) are tagged inside their row, different (word, tag) pairs
are mapped to lemmas once - a user's table first, then the tag's detachment rules
with the corpus vocabulary as the judge.  Lemmas go to the runs, not tokens to the
lemmas: frequent pairs are looked up inside the row, tokens of rare ones are joined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.constants import DEFAULT_UNWANTED_WORDS
from termlens.functions.porter import porter_sql
from termlens.functions.tagging import RULES, RUN, candidates_sql, tags_sql
from termlens.llm.common import likely
from termlens.operators.cooccurrence import lemma_map
from termlens.session import cut_lineage

TOKEN_PATTERN = r"n't|'[a-z]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def split_clitics(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), "n't", " n't")
    return F.regexp_replace(t, r"'(s|m|d|ll|re|ve)\b", " '$1")


def tokens(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(split_clitics(c), F.lit(TOKEN_PATTERN), 0)


def clean_tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 unwanted: Iterable[str] | None = None, use_stemming: bool = True) -> DataFrame:
    """id, cleaned (tokens joined by one space)."""
    bad = tuple(unwanted) if unwanted is not None else DEFAULT_UNWANTED_WORDS
    toks = F.filter(tokens(text_col), lambda w: ~w.isin(*bad)) if bad else tokens(text_col)
    t = docs.select(id_col, toks.alias("_t"))
    if use_stemming:
        stemmed = F.expr(f"transform(_t, tk -> {porter_sql('tk')})")
        return t.select(id_col, F.array_join(stemmed, " ").alias("cleaned"))
    pos = t.select(id_col, F.posexplode("_t").alias("_pos", "word"))
    words = pos.select("word").distinct()
    lm = lemma_map(words, words)
    folded = pos.join(lm, "word")
    g = folded.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_pos", "lemma"))).alias("_s"))
    out = g.select(id_col, F.array_join(F.col("_s.lemma"), " ").alias("cleaned"))
    empty = t.where(F.size("_t") == 0).select(id_col, F.lit("").alias("cleaned"))
    return out.unionByName(empty)


SENTENCE = r"[^.!?]+[.!?]*|[.!?]+"
HEAD = 1 << 16                # pairs of word and tag that every task looks up
LAST = sorted({e[-1] for rules in RULES.values() for e, _ in rules})      # a word that ends otherwise is its lemma
SLOT = "cast(pmod(xxhash64({}, {}), {}) AS int)"


def tagged_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", unwanted: Iterable[str] | None = None) -> DataFrame:
    """id, run, words, tags: a row for each run of tokens, with a letter for each token's part of speech."""
    bad = tuple(unwanted) if unwanted is not None else DEFAULT_UNWANTED_WORDS
    sentences = F.transform(F.regexp_extract_all(split_clitics(F.col(text_col)), F.lit(SENTENCE), 0), lambda s: F.filter(
        F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), 0), lambda w: ~w.isin(*bad) if bad else F.lit(True)))
    rows = docs.select(F.col(id_col).alias("id"), sentences.alias("_s"))
    runs = rows.select("id", F.posexplode(F.expr(
        f"flatten(transform(filter(_s, t -> size(t) > 0), t -> transform(sequence(0, (size(t) - 1) div {RUN}),"
        f" k -> slice(t, cast(k * {RUN} + 1 AS int), {RUN}))))")).alias("run", "words"))
    return runs.withColumn("tags", F.expr(tags_sql("words")))


def run_tokens(runs: DataFrame, *cols: str) -> DataFrame:
    """cols, i, word, tag: a row for each token of the runs."""
    return runs.select(*cols, "tags", F.posexplode("words").alias("i", "word")).select(
        *cols, "i", "word", F.expr("substring(tags, i + 1, 1)").alias("tag"))


def tagged_tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", unwanted: Iterable[str] | None = None) -> DataFrame:
    """id, run, i, word, tag: the tokens in order with their part of speech."""
    return run_tokens(tagged_runs(docs, text_col, id_col, unwanted), "id", "run")


def tag_lemmas(tokens: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """(word, tag, lemma) of the different (word, tag) pairs of tagged tokens; ``lemmas``: a user's (form, pos, lemma),
    null pos for any tag."""
    pairs = cut_lineage(tokens.select("word", "tag").distinct())
    known = pairs.select(F.col("word").alias("cand")).distinct()
    cand = pairs.select("word", "tag", F.explode(F.expr(candidates_sql("word", "tag"))).alias("cand"))
    best = cand.join(known, "cand", "left_semi").groupBy("word", "tag").agg(
        F.min_by("cand", F.struct(F.length("cand"), F.col("cand"))).alias("lemma"))
    out = pairs.join(best, ["word", "tag"], "left")
    if lemmas is not None:
        own = lemmas.where("pos IS NOT NULL").groupBy(F.col("form").alias("word"), F.col("pos").alias("tag")).agg(F.min("lemma").alias("_own"))
        some = lemmas.where("pos IS NULL").groupBy(F.col("form").alias("word")).agg(F.min("lemma").alias("_any"))
        out = out.join(own, ["word", "tag"], "left").join(some, "word", "left").withColumn("lemma", F.coalesce("_own", "_any", "lemma"))
    return out.select("word", "tag", F.coalesce("lemma", "word").alias("lemma"))


def lemma_table(lemmas: DataFrame, slots: int) -> Column:
    """(word, tag, lemma) as one value: an array of ``slots`` lists, a pair in that of its hash."""
    at = lemmas.groupBy(F.expr(SLOT.format("word", "tag", slots)).alias("slot")).agg(
        F.collect_list(F.struct("word", "tag", "lemma")).alias("found"))
    every = lemmas.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(at, "slot", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("slot", "found"))).alias("x")).select("x.found").scalar()


def clean_tokens_by_tag(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", unwanted: Iterable[str] | None = None,
                        lemmas: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """id, cleaned (lemmas by part of speech, joined by one space).  Rows of one id are one text; null text: empty.

    Tokens stay in their run.  The ``head`` most frequent pairs whose lemma differs from the word are looked up in a
    table that every task has; only tokens of rarer ones are joined, and meet their run where runs meet their id."""
    runs = cut_lineage(tagged_runs(docs, text_col, id_col, unwanted).withColumn("row", F.monotonically_increasing_id()), "zstd")
    pairs = cut_lineage(run_tokens(runs).groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n")))
    changed = pairs.join(tag_lemmas(pairs, lemmas).where("lemma <> word"), ["word", "tag"])
    # a word has no white space, a user's lemma may
    changed = cut_lineage(changed.withColumn("lemma", F.replace(F.replace("lemma", F.lit("\t"), F.lit("\t2")), F.lit(" "), F.lit("\t1"))))
    n = changed.count()
    first = cut_lineage(changed.orderBy(F.desc("n"), "word", "tag").limit(head)) if n > head else changed
    slots = max(1, min(n, head))
    can = f"substr(w, -1) IN ({', '.join(repr(x) for x in LAST)})" if lemmas is None else "true"
    tag = "substr(tags, i + 1, 1)"
    fold = (f"transform(words, (w, i) -> CASE WHEN {can} THEN coalesce(get(filter(t[{SLOT.format('w', tag, slots)}],"
            f" e -> e.word = w AND e.tag = {tag}), 0).lemma, w) ELSE w END)")
    # the table is bound outside of the lambda over the words: a subquery may not stand in one
    texts = runs.withColumn("_t", F.array(lemma_table(first, slots))).select(
        "id", "row", "run", F.expr(f"array_join(transform(_t, t -> {fold})[0], ' ')").alias("text"))
    whole = texts.unionByName(docs.select(F.col(id_col).alias("id")).distinct(), allowMissingColumns=True)
    if n > head:
        rare = changed.join(first, ["word", "tag"], "left_anti").select("word", "tag", "lemma")
        late = likely(run_tokens(runs, "id", "row"), ["word", "tag"], rare, ["word", "tag"]).join(rare, ["word", "tag"]).select(
            "id", "row", F.struct("i", "lemma").alias("late"))
        # dealt by the id once, for both groupings
        whole = whole.unionByName(late, allowMissingColumns=True).repartition("id").groupBy("id", "row").agg(
            F.max("run").alias("run"), F.max("text").alias("text"), F.collect_list("late").alias("late")).select("id", "run", F.expr(
                "CASE WHEN size(late) = 0 THEN text ELSE array_join(transform(split(text, ' '),"
                " (w, i) -> coalesce(get(filter(late, e -> e.i = i), 0).lemma, w)), ' ') END").alias("text"))
    else:
        whole = whole.repartition("id")
    whole = whole.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("run").isNotNull(), F.struct("run", "text")))).alias("r"))
    # of several rows of one id, the tokens of one place stand in the order of their lemmas
    mixed = ("array_join(transform(array_sort(flatten(transform(r, x -> transform(split(x.text, ' '), (w, i) -> struct("
             "x.run AS run, i AS i, replace(replace(w, '\t1', ' '), '\t2', '\t') AS lemma))))), x -> x.lemma), ' ')")
    plain = "replace(replace(array_join(r.text, ' '), '\t1', ' '), '\t2', '\t')"
    cleaned = F.expr(f"CASE WHEN size(array_distinct(r.run)) = size(r) THEN {plain} ELSE {mixed} END")
    return whole.select(F.col("id").alias(id_col), F.coalesce(cleaned, F.lit("")).alias("cleaned"))
