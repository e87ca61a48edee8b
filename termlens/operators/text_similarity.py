"""Similar documents by TF-IDF over the whole vocabulary: a prefix-filtered cosine join.

A document is the unit vector of its words' tf * ln(N / (1 + df)).  Words are
ordered from rare to frequent; a document's *prefix* is the shortest part in that
order behind which the rest is shorter than the threshold.  Two documents whose
cosine reaches the threshold share a word of both prefixes (were all common words
behind one of the prefixes, their product could not exceed that rest's length), so
an inverted list of the prefixes finds every pair, and frequent words, which carry
little weight, are hardly ever in one.  Most candidates share little more than that
word: they are passed over by sketches (the lengths of the vectors' parts) that bound
the cosine from above.  The others are verified on the whole vectors.

Equal vectors are one class: pairs are formed between classes, and members are
listed beside them, so copies are never expanded into pairs.  Pairs of a list of
up to ``SHORT`` classes come from a join; a longer list is dealt into blocks, and a
task forms the pairs of two blocks.  Either way only pairs go on that can reach the
threshold if this word is their rarest common one.

Null texts and documents without words have no vector and no pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.functions.text import preprocess_tokens
from termlens.llm.common import likely
from termlens.session import cut_lineage

SHORT = 40                    # classes of an inverted list that is joined with itself
BLOCK = 500                   # classes of a block of an inverted list
SLACK = 1e-9                  # of cosines: rounding
PARTS, MOST = 64, 4096        # of a sketch of a vector, a byte each: least and most
MIX = 0x9E3779B97F4A7C15      # spreads the words' numbers over the parts
GROUPS, GROUP = 4, 125_000    # of classes whose sketches meet in one task: least number, most classes
PAIRS, STEP = 4_000_000, 20_000     # pairs of two groups, and of one step
WORDS = 4_000_000             # of the vectors of a group


def vectors(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", min_len: int = 3) -> tuple[DataFrame, DataFrame]:
    """Written tables (c, terms, weights) of different unit vectors, words from rare to frequent, and (doc, c)."""
    toks = preprocess_tokens(text_col, min_len=min_len)
    # written first: the cleaning would else be computed again for every use
    rows = cut_lineage(docs.select(F.col(doc_col).alias("doc"), F.array_sort(toks).alias("t")), "zstd").where(F.size("t") > 0)
    # documents of equal words in equal numbers are one class
    rows = rows.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")})
    n = rows.count()
    members = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"))
    # classes have their numbers before their words: these are counted where the classes are grouped, without being sent
    names = cut_lineage(members.withColumn("c", F.monotonically_increasing_id()))
    one = rows.groupBy("h1", "h2").agg(F.any_value("t").alias("t")).join(names, ["h1", "h2"])
    counts = cut_lineage(one.select("h1", "h2", "c", "m", F.explode("t").alias("word")).groupBy("h1", "h2", "c", "m", "word").agg(
        F.count(F.lit(1)).alias("tf")).select("c", "m", "word", "tf"), "zstd")
    df = counts.groupBy("word").agg(F.sum("m").alias("df"))
    # a number for each word, rare ones first: the place in one order over the vocabulary
    ranked = cut_lineage(df.repartitionByRange("df", "word").sortWithinPartitions("df", "word").withColumn(
        "term", F.monotonically_increasing_id()))
    weighed = counts.join(ranked, "word").select("c", "term", (F.col("tf") * F.log(F.lit(float(n)) / (F.col("df") + 1))).alias("w")).where("w > 0")
    v = weighed.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("x"))    # the words of one document
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, s: a + s["w"] * s["w"]))
    # the norm is bound once: inside the lambda over the weights it would be summed again for each of them
    unit = F.transform(F.array(norm), lambda n: F.transform("x.w", lambda w: w / n))[0]
    v = v.select("c", F.col("x.term").alias("terms"), unit.alias("weights"))
    return cut_lineage(v, "zstd"), rows.select("doc", "h1", "h2").join(names, ["h1", "h2"]).select("doc", "c")


def _prefixes(threshold: float):
    def run(batches):
        for b in batches:
            out = []
            for c, terms, weights in zip(b["c"], b["terms"], b["weights"], strict=True):
                w = np.asarray(weights)
                rest = np.sqrt(np.maximum(0, 1 - np.cumsum(w * w)))      # length of what is behind each place
                k = min(len(w), int(np.argmax(rest < threshold - SLACK)) + 1) if (rest < threshold - SLACK).any() else len(w)
                # weight of the words up to here, and length behind: what a pair that meets here first can reach
                out.append(pd.DataFrame({"term": terms[:k], "c": c, "w": w[:k], "rest": rest[:k]}))
            yield pd.concat(out) if out else pd.DataFrame({"term": [], "c": [], "w": [], "rest": []}).astype({"term": "int64", "c": "int64"})
    return run


def _meet(threshold: float):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        """Pairs of two blocks of a word's list (or within one) that can reach the threshold if this is their rarest common word."""
        c, w, rest, block = (b[k].to_numpy() for k in ("c", "w", "rest", "block"))
        fine = w[:, None] * w[None, :] + rest[:, None] * rest[None, :] >= threshold - SLACK
        if b["lo"].iloc[0] != b["hi"].iloc[0]:
            fine &= block[:, None] != block[None, :]
        x, y = np.nonzero(fine & (c[:, None] < c[None, :]))
        return pd.DataFrame({"a": c[x], "b": c[y]})
    return run


def _sketches(parts: int):
    def run(batches):
        """Lengths of a vector's parts, rounded up: a word is in the part of its number's hash."""
        for b in batches:
            out = []
            for terms, weights in zip(b["terms"], b["weights"], strict=True):
                part = (np.asarray(terms, dtype=np.int64).view(np.uint64) * np.uint64(MIX) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                length = np.sqrt(np.bincount(part.astype(np.int64), np.square(np.asarray(weights)), parts))
                out.append(np.minimum(np.ceil(length * (1 + SLACK) * 255), 255).astype(np.uint8).tobytes())
            yield pd.DataFrame({"c": b["c"], "sketch": out})
    return run


def _can_reach(threshold: float):
    def run(pairs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Pairs of two groups of classes whose cosine can reach the threshold by the lengths of their parts (Cauchy-Schwarz, part by part)."""
        if not len(pairs):
            return pairs[["a", "b"]]
        known = known.sort_values("c")
        c = known["c"].to_numpy()
        rows = np.frombuffer(b"".join(known["sketch"]), np.uint8).reshape(len(c), -1)
        a, b = (pairs[k].to_numpy() for k in "ab")
        fine = np.zeros(len(a), bool)
        for i in range(0, len(a), STEP):
            x, y = (rows[np.searchsorted(c, k[i:i + STEP])].astype(np.float32) for k in (a, b))
            fine[i:i + STEP] = np.einsum("ij,ij->i", x, y) >= (threshold - SLACK) * 255 ** 2 * (1 - 1e-5)     # 1e-5: single precision
        return pd.DataFrame({"a": a[fine], "b": b[fine]})
    return run


def _cosines(threshold: float):
    def run(pairs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Cosines of the pairs of two groups of classes on their whole vectors."""
        at = {c: (np.asarray(t), np.asarray(w)) for c, t, w in zip(known["c"], known["terms"], known["weights"], strict=True)}
        out = []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            (t, w), (u, x) = at[a], at[b]
            _, i, j = np.intersect1d(t, u, assume_unique=True, return_indices=True)
            out.append(float(w[i] @ x[j]))
        found = pd.DataFrame({"a": pairs["a"], "b": pairs["b"], "cosine": np.asarray(out, dtype=float)})
        return found[found["cosine"] >= threshold - SLACK]
    return run


def _grouped(met: DataFrame, known: DataFrame, groups: int, run, schema: str) -> DataFrame:
    """``run`` over the pairs of two groups of classes and what is ``known`` of these: a class is sent once to each other
    group, not for each of its pairs."""
    of = {k: F.pmod(F.xxhash64(k), F.lit(groups)) for k in "abc"}
    dealt = met.select("a", "b", F.least(of["a"], of["b"]).alias("lo"), F.greatest(of["a"], of["b"]).alias("hi"))
    sent = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        F.least(of["c"], "other").alias("lo"), F.greatest(of["c"], "other").alias("hi"), *known.columns)
    return dealt.groupBy("lo", "hi").cogroup(sent.groupBy("lo", "hi")).applyInPandas(run, schema)


def can_reach(met: DataFrame, v: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``met`` that can reach the threshold by the sketches of their vectors."""
    n, words = v.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).first()
    parts = max(PARTS, 1 << int(np.ceil(np.log2((words or 1) / threshold))))      # few words of a vector share a part
    sketch = cut_lineage(v.select("c", "terms", "weights").mapInPandas(_sketches(min(parts, MOST)), "c long, sketch binary"))
    groups = max(GROUPS, -(-n // GROUP), int(np.ceil(np.sqrt(2 * met.count() / PAIRS))))
    return _grouped(met, sketch, groups, _can_reach(threshold), "a long, b long")


def verified(met: DataFrame, v: DataFrame, threshold: float) -> DataFrame:
    """a, b, cosine: the pairs of ``met`` of at least the threshold."""
    some = cut_lineage(likely(v, ["c"], met.select(F.col("a").alias("c")).union(met.select("b")).distinct(), ["c"]), "zstd")
    groups = max(GROUPS, -(-(some.agg(F.sum(F.size("terms"))).first()[0] or 0) // WORDS), int(np.ceil(np.sqrt(2 * met.count() / PAIRS))))
    return _grouped(met, some, groups, _cosines(threshold), "a long, b long, cosine double")


def similar_pairs(docs: DataFrame, threshold: float = 0.8, doc_col: str = "doc_id", text_col: str = "text",
                  block: int = BLOCK, short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """((a, b, cosine): classes a < b of at least ``threshold``; (doc, c): the class of each document)."""
    v, members = vectors(docs, doc_col, text_col)
    prefix = cut_lineage(v.mapInPandas(_prefixes(threshold), "term long, c long, w double, rest double"))
    lists = cut_lineage(prefix.groupBy("term").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    few = prefix.join(lists.where(F.col("m") <= short).select("term"), "term")
    one, other = (few.select("term", *[F.col(k).alias(f"{k}{i}") for k in ("c", "w", "rest")]) for i in (1, 2))
    met = one.join(other, "term").where((F.col("c1") < F.col("c2")) & (
        F.col("w1") * F.col("w2") + F.col("rest1") * F.col("rest2") >= threshold - SLACK)).select(
        F.col("c1").alias("a"), F.col("c2").alias("b"))
    long = lists.where(F.col("m") > short).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    dealt = prefix.join(long, "term").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "term", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "c", "w", "rest")
    met = met.unionByName(dealt.groupBy("term", "lo", "hi").applyInPandas(_meet(threshold), "a long, b long")).distinct()
    met = cut_lineage(can_reach(cut_lineage(met), v, threshold))
    return cut_lineage(verified(met, v, threshold)), members


def similar_classes(docs: DataFrame, threshold: float = 0.8, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """class_id, n_docs, similar_class_id, similar_n_docs, cosine: pairs of classes, each named by the least id of its documents."""
    pairs, members = similar_pairs(docs, threshold, doc_col, text_col)
    name = cut_lineage(members.groupBy("c").agg(F.min("doc").alias("id"), F.count(F.lit(1)).alias("n")))
    x, y = (name.select(F.col("c").alias(c), F.col("id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    first = F.col("id_a") < F.col("id_b")
    return pairs.join(x, "a").join(y, "b").select(
        F.least("id_a", "id_b").alias("class_id"), F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("n_docs"),
        F.greatest("id_a", "id_b").alias("similar_class_id"), F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("similar_n_docs"),
        "cosine")
