"""Word networks from the co-occurrence table.

Edges: co-occurrence rows at or above a probability threshold, optionally only
the top ``m`` per term (count desc, word asc), optionally the neighbourhood of
given terms.  Nodes: every word on an edge with its degree (edges touching
it), strength (sum of edge counts) and type — ``term`` for a search term,
``word`` otherwise, or the label from an optional lexicon (a left join; the
lexicon is broadcast only when its row count is under a checked bound).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.operators.cooccurrence import top_n_per_key

MAX_BROADCAST_LEXICON = 5_000_000


def network_edges(cooccurrence: DataFrame, min_prob: float = 0.0, top_m: int | None = None,
                  terms: Iterable[str] | None = None) -> DataFrame:
    """source, target, weight, prob."""
    e = cooccurrence.where(F.col("prob_w1w2") >= F.lit(float(min_prob)))
    if terms is not None:
        e = e.where(F.col("word_1").isin([t.strip().lower() for t in terms]))
    if top_m is not None:
        e = top_n_per_key(e, top_m, key="word_1", item="word_2", score="count")
    return e.select(F.col("word_1").alias("source"), F.col("word_2").alias("target"),
                    F.col("count").alias("weight"), F.col("prob_w1w2").alias("prob"))


def network_nodes(edges: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """node, degree, strength, type.  ``lexicon``: (word, type)."""
    both = F.array(F.struct(F.col("source").alias("node"), "weight", F.lit(True).alias("_is_source")),
                   F.struct(F.col("target").alias("node"), "weight", F.lit(False).alias("_is_source")))
    ends = edges.select(F.explode(both).alias("_e")).select("_e.*")
    nodes = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"),
                                     F.sum("weight").alias("strength"),
                                     F.max("_is_source").alias("_term"))
    typ = F.when(F.col("_term"), F.lit("term")).otherwise(F.lit("word"))
    if lexicon is not None:
        lex = lexicon.select(F.col("word").alias("node"), F.col("type").alias("_lex")).dropDuplicates(["node"])
        if lex.count() <= MAX_BROADCAST_LEXICON:
            lex = F.broadcast(lex)
        nodes = nodes.join(lex, "node", "left")
        typ = F.coalesce(F.col("_lex"), typ)
    return nodes.select("node", "degree", "strength", typ.alias("type"))
