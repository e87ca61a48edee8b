"""Corpus pipeline: language ID, quality classifier, line dedup, near-dedup, packing.

Every stage takes the documents that its predecessor kept, read again from a
written table, and returns documents with the same columns; the last returns
the packed pieces.  Models are trained within their stage.

Defined results: texts without a letter, null or empty ones among them, have no
language and go in the first stage; without any language or labelled text the
classifiers know nothing, and no document passes them.  Repeated rows are judged
alike, and one of them stays in the near-dedup stage.  Other columns, whatever
their names, are carried as they are up to packing; an empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import bagminhash, langid, linededup, packing, quality_knn
from termlens.llm.common import cut_lineage, release_memory, table

TOKENIZER = "word_bpe_49k.json"
MIN_LANGUAGE_SCORE = 0.4

# The classifiers and the tokenizer can't be written as SQL; tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    model = langid.fit(docs)
    release_memory()    # what training took from the driver
    return langid.keep_identified(docs, model, MIN_LANGUAGE_SCORE)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, as the labels mark it."""
    labelled = quality_knn.labelled_texts(docs, table(spark, sf_dir, "labels"))
    model = quality_knn.fit(docs, labelled)
    release_memory()
    return quality_knn.keep_quality(docs, model, quality_knn.GOOD_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines."""
    out = linededup.dedup_lines(docs, **linededup.ALL_LINES)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return bagminhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed windows of ids."""
    pieces = packing.pack(packing.encode_stream(docs, public_tokenizers.path(TOKENIZER), release=True))
    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", identify_language), ("quality_classifier", classify_quality), ("line_dedup", dedup_lines),
          ("near_dedup", drop_near_copies), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
