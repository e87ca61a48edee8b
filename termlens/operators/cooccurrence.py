"""Words co-occurring with each search term, for all terms in one job.

Per term: tokens of the cleaned snippets longer than two characters are
(optionally) folded to their lemma, counted (token count, not document
presence), the term's own words and their ``+s`` forms are dropped, the top
``n`` words by (count desc, word asc) are kept, and among words with the same
Porter stem only the most frequent survives (counts are not added).  The
probability is ``count / (total_docs * TOKENS_PER_DOCUMENT)``.

Plan shape: explode -> partial HashAggregate -> Exchange(term, word) -> final
HashAggregate; the lemma fold and the stem de-duplication run on the
vocabulary (distinct words), never on token occurrences; top-n is computed from
a per-term histogram of counts, so only the one tie group that straddles rank
``n`` is ever sorted, and only when a term has more than ``n`` words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.constants import DEFAULT_TOP_N, TOKENS_PER_DOCUMENT
from termlens.functions.lemma import lemma_candidates
from termlens.functions.porter import porter_stem
from termlens.functions.text import word_tokens
from termlens.session import cut_lineage

TERM = "search_term"


def token_counts(snippets: DataFrame, text_col: str = "processed_text") -> DataFrame:
    """(search_term, word, count) over all tokens of the cleaned snippets."""
    return (snippets.select(TERM, F.explode(word_tokens(text_col)).alias("word"))
            .groupBy(TERM, "word").agg(F.count(F.lit(1)).alias("count")))


def vocabulary(snippets: DataFrame, text_col: str = "processed_text") -> DataFrame:
    """Distinct words of the cleaned snippets (all lengths)."""
    return snippets.select(F.explode(word_tokens(text_col)).alias("word")).distinct()


def lemma_of(words: DataFrame, vocab: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(word, lemma) for the words that have a detachment candidate in
    ``vocab``: the shortest one, ties alphabetical.  With ``key`` every key
    has its own vocabulary.  Neither input needs to be distinct (a semi join
    and an aggregate absorb repeats), which saves two shuffles."""
    cand = words.select(*key, "word", F.explode(lemma_candidates(F.col("word"))).alias("cand"))
    known = cand.join(vocab.select(*key, F.col("word").alias("cand")), [*key, "cand"], "left_semi")
    return known.groupBy(*key, "word").agg(
        F.min_by("cand", F.struct(F.length("cand"), F.col("cand"))).alias("lemma"))


def lemma_map(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, lemma) for every distinct word (the word itself when no
    candidate is known)."""
    w = words.select("word").distinct()
    return w.join(lemma_of(w, vocab), "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))


def fold_lemmas(counts: DataFrame, vocab: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Re-count (search_term, word, count) by lemma: surface forms are counted
    first, then folded, which is the same as lemmatising every token.  A
    candidate must be a word of the same term's snippets (``vocab``:
    search_term, word), so a term's counts do not depend on the terms it runs
    with.  ``lemmas`` (word, lemma) is a user's table that goes before the rules."""
    folded = counts.join(lemma_of(counts, vocab, [TERM]), [TERM, "word"], "left")
    if lemmas is not None:
        given = lemmas.where("lemma IS NOT NULL").groupBy("word").agg(F.min("lemma").alias("_given"))
        folded = folded.join(given, "word", "left").withColumn("lemma", F.coalesce("_given", "lemma"))
    return (folded.groupBy(TERM, F.coalesce("lemma", "word").alias("word"))
            .agg(F.sum("count").alias("count")))


def drop_self(counts: DataFrame) -> DataFrame:
    """Drop each word of the term and that word + 's'."""
    tw = F.split(F.col(TERM), " ")
    return counts.where(~F.array_contains(tw, F.col("word"))
                        & ~F.array_contains(F.transform(tw, lambda x: F.concat(x, F.lit("s"))), F.col("word")))


# Largest tie group one task may rank by word; bigger ones are split first.
EDGE_SORT_MAX = 200_000
# Up to this n a plain row_number() filter is planned with a partial
# WindowGroupLimit before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
WINDOW_LIMIT_MAX = 1000


def top_n_per_key(counts: DataFrame, n: int, key: str = TERM, item: str = "word",
                  score: str = "count", sort_max: int = EDGE_SORT_MAX,
                  window_max: int = WINDOW_LIMIT_MAX) -> DataFrame:
    """Rows ranked within ``key`` by (score desc, item asc), rank <= n.

    Small n (<= ``window_max``): ``row_number() <= n``, which Spark plans as a
    partial WindowGroupLimit on the map side — every task ships at most n rows
    per key, so even a key holding a third of all rows shuffles little.

    A histogram (key, score) -> number of items gives, per key, the score
    groups fully inside the top n, at most one boundary group, and the groups
    outside.  Only the boundary group is ranked by item (see
    :func:`_first_items`, which keeps that bounded too).

    ``counts`` is materialised first (it is read by up to three branches), and
    when no key has more than n items — the usual case for large n — the
    ranking is skipped after one small aggregation."""
    if n <= window_max:
        w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item))
        return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    counts = cut_lineage(counts)
    largest = counts.groupBy(key).agg(F.count(F.lit(1)).alias("_g")).agg(F.max("_g")).first()[0]
    if largest is None or largest <= n:
        return counts
    hist = counts.groupBy(key, score).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(key).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    hist = (hist.withColumn("_upto", F.sum("_k").over(w))
            .withColumn("_before", F.col("_upto") - F.col("_k"))
            .where(F.col("_before") < n).drop("_k"))
    tagged = counts.join(hist, [key, score])
    inside = tagged.where(F.col("_upto") <= n).drop("_upto", "_before")
    edge = (tagged.where(F.col("_upto") > n)
            .withColumn("_need", F.lit(n) - F.col("_before")).drop("_upto", "_before"))
    return inside.unionByName(_first_items(edge, [key, score], item, sort_max)).select(*counts.columns)


def _first_items(edge: DataFrame, group: list[str], item: str, sort_max: int) -> DataFrame:
    """Per group, the ``_need`` smallest rows by ``item`` — without sorting a
    group larger than ``sort_max`` in one task.  Large groups are cut into
    buckets by the item's prefix (one more character per round); buckets
    wholly before the cut are kept, those after it dropped, and only the
    bucket that straddles the cut goes on to the next round."""
    kept = []
    cur = cut_lineage(edge)
    plen = 1
    while True:
        biggest = cur.groupBy(*group).agg(F.count(F.lit(1)).alias("_g")).agg(F.max("_g")).first()[0]
        if biggest is None or biggest <= sort_max:
            break
        pre = F.substring(item, 1, plen)
        hist = cur.groupBy(*group, pre.alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
        w = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_upto", F.sum("_k").over(w)).withColumn("_before", F.col("_upto") - F.col("_k"))
        tag = cur.withColumn("_p", pre).join(hist, [*group, "_p"])
        kept.append(tag.where(F.col("_upto") <= F.col("_need")).drop("_p", "_k", "_upto", "_before", "_need"))
        cur = cut_lineage(tag.where((F.col("_before") < F.col("_need")) & (F.col("_upto") > F.col("_need")))
                          .withColumn("_need", F.col("_need") - F.col("_before"))
                          .drop("_p", "_k", "_upto", "_before"))
        plen += 1
    r = F.row_number().over(Window.partitionBy(*group).orderBy(item))
    last = cur.withColumn("_r", r).where(F.col("_r") <= F.col("_need")).drop("_r", "_need")
    out = last
    for part in kept:
        out = out.unionByName(part)
    return out


def dedup_by_stem(counts: DataFrame, key: str = TERM) -> DataFrame:
    """Keep, per (key, Porter stem), the word with the highest count (ties:
    alphabetical).  An aggregate, so it combines map-side."""
    stems = counts.withColumn("_stem", porter_stem("word"))
    best = stems.groupBy(key, "_stem").agg(
        F.min_by(F.struct("word", "count"), F.struct((-F.col("count")).alias("c"), F.col("word"))).alias("_b"))
    return best.select(key, "_b.word", "_b.count")


def cooccurrence_stats(snippets: DataFrame, total_docs: int, n: int = DEFAULT_TOP_N,
                       lemmatize: bool = True, text_col: str = "processed_text",
                       lemmas: DataFrame | None = None) -> DataFrame:
    """word_1 (term), word_2, count, prob_w1w2 for every term in ``snippets``;
    ``lemmas`` (word, lemma) goes before the lemma rules."""
    # One aggregation feeds the counts, the vocabulary and the lemma map.  It
    # is written once (reliable checkpoint: vocabulary-sized, survives
    # executor loss) so the corpus is scanned exactly once; without it each
    # branch would re-run the extraction with differently pruned columns.
    return stats_of_counts(cut_lineage(token_counts(snippets, text_col)), total_docs, n, lemmatize, lemmas)


def stats_of_counts(all_counts: DataFrame, total_docs: int, n: int = DEFAULT_TOP_N, lemmatize: bool = True,
                    lemmas: DataFrame | None = None) -> DataFrame:
    """:func:`cooccurrence_stats` from written (search_term, word, count) of all tokens."""
    counts = all_counts.where(F.length("word") > 2)
    # Folding only merges words, so the surface vocabulary of a term bounds
    # its folded vocabulary: when no term has more than n surface words the
    # top-n cannot drop anything and is skipped (one aggregate over the
    # written counts decides it).
    widest = counts.groupBy(TERM).agg(F.count(F.lit(1)).alias("_g")).agg(F.max("_g")).first()[0]
    if lemmatize:
        counts = fold_lemmas(counts, all_counts.select(TERM, "word"), lemmas)
    counts = drop_self(counts)
    if widest is not None and widest > n:
        counts = top_n_per_key(counts, n)
    counts = dedup_by_stem(counts)
    denom = float(total_docs) * TOKENS_PER_DOCUMENT
    return counts.select(F.col(TERM).alias("word_1"), F.col("word").alias("word_2"),
                         F.col("count").cast("long").alias("count"),
                         (F.col("count") / F.lit(denom)).alias("prob_w1w2"))


def stem_groups(snippets: DataFrame, text_col: str = "processed_text") -> DataFrame:
    """Stem key of every distinct word: (word, stem, group_size) where
    group_size is the number of distinct words sharing the stem (an aggregate
    joined back, not a window, so a large stem group is not one task's sort)."""
    v = vocabulary(snippets, text_col).withColumn("stem", porter_stem("word"))
    v = cut_lineage(v)
    sizes = v.groupBy("stem").agg(F.count(F.lit(1)).alias("group_size"))
    return v.join(sizes, "stem").select("word", "stem", "group_size")


def top_pairs(stats: DataFrame, k: int = 10) -> DataFrame:
    """The k largest pairs overall (count desc, word_1, word_2): TakeOrdered."""
    return stats.orderBy(F.col("count").desc(), "word_1", "word_2").limit(k)
