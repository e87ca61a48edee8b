"""Entropy, joint entropy, mutual information and PMI.

Entropy measures use document presence: p(w) = documents containing w / N.
For a (term, word) pair the 2x2 presence table is n11 = documents containing
both, n10, n01, n00 from the marginals.  With the matched terms of a document as
an array, one aggregate over one scan counts the pairs and both marginals; from
two presence tables, pairs come from an equi-join on the document.  The work is
(terms matched per document) x (words per document); no pair of words is formed.

PMI uses the pipeline's own probabilities: log2(prob_w1w2 / (p(word_1) *
p(word_2))) with p from ``term_counts``; only pairs whose word_2 is itself a
processed term have both marginals.

Pairs of words of a limited vocabulary have their joint counts from bitmaps: the
documents of a chunk are the bits, a word is one bitmap, and the joint count of
two words is the number of bits of their AND, summed over the chunks.  No pair of
words is made for a document, and what a task passes on is one count per pair.

Logarithms are ln(x) / ln(2) on both engines; values are rounded to 12 decimal
places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.functions.text import preprocess_tokens
from termlens.session import cut_lineage

TERM = "search_term"
CHUNK_DOCS = 1 << 15          # documents (bits) of a bitmap
MAX_VOCABULARY = 2_000        # words whose pairs are formed: 2 million counts a task
LN2 = math.log(2.0)
DIGITS = 12


def plogp(p: Column) -> Column:
    """p * log2(p) with 0 log 0 = 0."""
    return F.when(p > 0, p * F.log(p) / F.lit(LN2)).otherwise(F.lit(0.0))


def binary_entropy(p: Column) -> Column:
    return -(plogp(p) + plogp(1 - p))


def doc_words(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
              min_len: int = 3) -> DataFrame:
    """Distinct (doc, word) presence from the cleaned document text."""
    toks = preprocess_tokens(text_col, min_len=min_len)
    return docs.select(doc_col, F.explode(F.array_distinct(toks)).alias("word"))


def word_entropy(presence: DataFrame, n_docs: int) -> DataFrame:
    """word, df, p, entropy.  ``n_docs``: corpus size (a scalar)."""
    df_ = presence.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    p = F.col("df") / F.lit(float(n_docs))
    return df_.select("word", "df", p.alias("p"), F.round(binary_entropy(p), DIGITS).alias("entropy"))


def term_word_counts(docs: DataFrame, terms: Column, words: Column) -> DataFrame:
    """Written (search_term, word, n): documents that hold both, for the arrays of a document's terms and of its
    different words; null stands for any term or any word.  One aggregate over one scan gives all marginals."""
    none = F.array(F.lit(None).cast("string"))
    # the terms first: an expression beside an explode would be computed for every exploded row; the words inside the
    # explode: of a column, Spark makes a filter on its size and computes it twice
    rows = docs.withColumn("_t", terms).select("_t", F.explode(F.concat(none, words)).alias("word"))
    # counted by the whole list of a document's terms, so a word is one row of a document and not one for each term
    rows = rows.groupBy("_t", "word").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select(F.explode(F.concat(none, "_t")).alias(TERM), "word", "n")
    return cut_lineage(rows.groupBy(TERM, "word").agg(F.sum("n").alias("n")))


def document_information(docs: DataFrame, terms: Column, n_docs: int, text_col: str = "text", min_len: int = 3) -> DataFrame:
    """:func:`pair_information` of documents whose matched terms are an array column."""
    toks = F.array_distinct(preprocess_tokens(text_col, min_len=min_len))
    counts = term_word_counts(docs.where(F.col(text_col).isNotNull()), terms, toks)
    n11 = counts.where(F.col(TERM).isNotNull() & F.col("word").isNotNull()).withColumnRenamed("n", "n11")
    n_term = counts.where(F.col(TERM).isNotNull() & F.col("word").isNull()).select(TERM, F.col("n").alias("n_term"))
    n_word = counts.where(F.col(TERM).isNull() & F.col("word").isNotNull()).select("word", F.col("n").alias("n_word"))
    return _information(n11, n_term, n_word, n_docs)


def pair_information(term_docs: DataFrame, presence: DataFrame, n_docs: int,
                     doc_col: str = "doc_id") -> DataFrame:
    """search_term, word, n11, n_term, n_word, h_term, h_word, joint_entropy,
    mutual_information for every (term, word) found together in a document."""
    # both inputs feed two branches each: written once, read twice
    td = cut_lineage(term_docs.select(TERM, doc_col).distinct())
    presence = cut_lineage(presence)
    n_term = td.groupBy(TERM).agg(F.count(F.lit(1)).alias("n_term"))
    n_word = presence.groupBy("word").agg(F.count(F.lit(1)).alias("n_word"))
    n11 = td.join(presence, doc_col).groupBy(TERM, "word").agg(F.count(F.lit(1)).alias("n11"))
    return _information(n11, n_term, n_word, n_docs)


def _information(n11: DataFrame, n_term: DataFrame, n_word: DataFrame, n_docs: int) -> DataFrame:
    # n_term has one row per search term (bounded by the checked term list)
    j = n11.join(F.broadcast(n_term), TERM).join(n_word, "word").withColumn("n", F.lit(int(n_docs)))
    n = F.col("n").cast("double")
    c11 = F.col("n11") / n
    c10 = (F.col("n_term") - F.col("n11")) / n
    c01 = (F.col("n_word") - F.col("n11")) / n
    c00 = (F.col("n") - F.col("n_term") - F.col("n_word") + F.col("n11")) / n
    h_t = binary_entropy(F.col("n_term") / n)
    h_w = binary_entropy(F.col("n_word") / n)
    h_tw = -(plogp(c11) + plogp(c10) + plogp(c01) + plogp(c00))
    return j.select(TERM, "word", "n11", "n_term", "n_word",
                    F.round(h_t, DIGITS).alias("h_term"), F.round(h_w, DIGITS).alias("h_word"),
                    F.round(h_tw, DIGITS).alias("joint_entropy"),
                    F.round(h_t + h_w - h_tw, DIGITS).alias("mutual_information"))


def vocabulary(presence: DataFrame, size: int) -> DataFrame:
    """(word, df) of the ``size`` words that most documents hold (ties by word)."""
    if size > MAX_VOCABULARY:
        raise ValueError(f"at most {MAX_VOCABULARY} words")
    return presence.groupBy("word").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "word").limit(size)


def joint_counts(docs: DataFrame, words: list[str], tokens: Column) -> DataFrame:
    """(i, j, n): documents that hold words i < j of ``words``, where there are any."""
    places = {w: i for i, w in enumerate(words)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(words), len(words)), np.int64)
        bits, used = np.zeros((len(words), CHUNK_DOCS), bool), 0

        def add() -> None:
            packed = np.packbits(bits[:, :used], axis=1)
            packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
            for i in range(len(words)):
                total[i, i:] += np.bitwise_count(packed[i] & packed[i:]).sum(1, dtype=np.int64)

        for b in batches:
            for held in b["held"]:
                if len(held) < 2:
                    continue
                bits[[places[w] for w in held], used] = True
                used += 1
                if used == CHUNK_DOCS:
                    add()
                    bits[:], used = False, 0
        if used:
            add()
        i, j = np.nonzero(np.triu(total, 1))
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": total[i, j]})

    held = F.array_intersect(tokens, F.array(*[F.lit(w) for w in words])) if words else F.array().cast("array<string>")
    # documents with fewer words are passed over there: a filter here would compute the tokens twice
    return docs.select(F.coalesce(held, F.array().cast("array<string>")).alias("held")).mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(
        F.sum("n").alias("n"))


def word_pair_information(docs: DataFrame, n_docs: int, size: int, doc_col: str = "doc_id", text_col: str = "text",
                          min_len: int = 3) -> DataFrame:
    """word_1 < word_2, n11, n_1, n_2, joint_entropy, mutual_information for the pairs of the ``size`` most frequent
    words that share a document."""
    toks = preprocess_tokens(text_col, min_len=min_len)
    rows = docs.select(toks.alias("toks"))
    top = vocabulary(rows.select(F.explode(F.array_distinct("toks")).alias("word")), size).collect()   # size rows
    top = sorted((r.word, r.df) for r in top)
    table = docs.sparkSession.createDataFrame([(i, w, d) for i, (w, d) in enumerate(top)], "i int, word string, df long")
    pairs = joint_counts(rows, [w for w, _ in top], F.col("toks"))
    j = pairs.join(F.broadcast(table.select("i", F.col("word").alias("word_1"), F.col("df").alias("n_1"))), "i").join(
        F.broadcast(table.select(F.col("i").alias("j"), F.col("word").alias("word_2"), F.col("df").alias("n_2"))), "j")
    n = F.lit(float(n_docs))
    c11, c10 = F.col("n") / n, (F.col("n_1") - F.col("n")) / n
    c01, c00 = (F.col("n_2") - F.col("n")) / n, (n - F.col("n_1") - F.col("n_2") + F.col("n")) / n
    h_12 = -(plogp(c11) + plogp(c10) + plogp(c01) + plogp(c00))
    information = binary_entropy(F.col("n_1") / n) + binary_entropy(F.col("n_2") / n) - h_12
    return j.select("word_1", "word_2", F.col("n").alias("n11"), "n_1", "n_2", F.round(h_12, DIGITS).alias("joint_entropy"),
                    F.round(information, DIGITS).alias("mutual_information"))


def pmi(cooccurrence: DataFrame, counts: DataFrame) -> DataFrame:
    """word_1, word_2, prob_w1w2, p_word_1, p_word_2, pmi."""
    p1 = counts.select(F.col("word").alias("word_1"), F.col("probability").alias("p_word_1"))
    p2 = counts.select(F.col("word").alias("word_2"), F.col("probability").alias("p_word_2"))
    j = cooccurrence.join(p1, "word_1").join(p2, "word_2")
    v = F.log(F.col("prob_w1w2") / (F.col("p_word_1") * F.col("p_word_2"))) / F.lit(LN2)
    return j.select("word_1", "word_2", "prob_w1w2", "p_word_1", "p_word_2", F.round(v, DIGITS).alias("pmi"))
