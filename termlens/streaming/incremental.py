"""Incremental runs over newly arriving documents (Structured Streaming).

New document files land in a directory; each micro-batch:

1. extracts the snippets of the search terms from the new documents and
   writes them under ``snippets/batch_id=<id>`` (overwrite of that batch's
   own folder: a retried batch rewrites the same files);
2. adds the batch's partial aggregates - tokens per (term, word), snippets per
   (term, document) and per (term, publisher) - to the stored ones;
3. recomputes, from the stored aggregates of the terms it touched, what is not
   additive (top-n, stem de-duplication, probabilities, corpus summary), and
   replaces those terms' rows.  Snippets of earlier batches are never read.

Steps 2 and 3 and the batch's number are one commit of the tables, so a batch
that is run again after a failure is counted once.

The stream's own checkpoint (offsets, committed batches) lives in the shared
checkpoint directory, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from termlens.constants import DEFAULT_FRAGMENT_LIMIT, DEFAULT_TOP_N, TOKENS_PER_DOCUMENT
from termlens.operators.cooccurrence import stats_of_counts, token_counts
from termlens.operators.corpus import corpus_summary_of_state
from termlens.operators.snippets import extract_snippets, with_processed_text
from termlens.operators.store import TableStore, clean_stats
from termlens.session import cut_lineage

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def batch_update(batch: DataFrame, batch_id: int, terms: list[str], root: str, total_docs: int,
                 n: int, fragment_limit: int | None) -> None:
    spark = batch.sparkSession
    docs = batch.select("doc_id", "text", F.col("source").alias("publisher"), "lang")
    snips = with_processed_text(extract_snippets(docs, terms, fragment_limit))
    out = os.path.join(root, "snippets", f"batch_id={batch_id}")
    snips.write.mode("overwrite").partitionBy("search_term").parquet(out)
    written = spark.read.parquet(out)
    touched = sorted(r.search_term for r in written.select("search_term").distinct().collect())
    store = TableStore(spark, os.path.join(root, "tables"))
    if not touched or store.notes().get("batch", -1) >= batch_id:
        return
    with store.change() as c:
        c.note(batch=batch_id)
        c.add("state_words", token_counts(written), "count")
        for name, key in (("state_documents", "doc_id"), ("state_publishers", "publisher")):
            c.add(name, written.groupBy("search_term", key).agg(F.count(F.lit(1)).alias("n")), "n")
        words, documents, publishers = (c.read(f"state_{n}").where(F.col("search_term").isin(touched))
                                        for n in ("words", "documents", "publishers"))
        co = cut_lineage(stats_of_counts(words, total_docs, n))
        counts = documents.groupBy(F.col("search_term").alias("word")).agg(F.sum("n").alias("count")).withColumn(
            "probability", F.col("count") / F.lit(float(total_docs) * TOKENS_PER_DOCUMENT))
        c.replace_groups("term_cooccurrence", clean_stats(co), "word_1", touched)
        c.replace_groups("term_counts", counts, "word", touched)
        c.replace_groups("corpus_stats", corpus_summary_of_state(documents, publishers, co), "search_term", touched)
        c.add_terms(touched)


def start(spark: SparkSession, source_dir: str, terms: Iterable[str], root: str, total_docs: int,
          n: int = DEFAULT_TOP_N, fragment_limit: int | None = DEFAULT_FRAGMENT_LIMIT,
          available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the incremental query over Parquet document files in
    ``source_dir``.  ``available_now`` processes what is there and stops."""
    terms = sorted({t.strip().lower() for t in terms})
    reader = spark.readStream.schema(DOCUMENT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    ckpt = os.path.join(root, "_stream")  # beside the tables it fills: another root is another stream
    w = (stream.writeStream.option("checkpointLocation", ckpt)
         .foreachBatch(lambda df, bid: batch_update(df, bid, terms, root, total_docs, n, fragment_limit)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
