"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Texts become TF-IDF vectors of hashed character-shape n-grams, letter n-grams
and repetition markers (document frequencies counted over all documents); a
truncated SVD of the labelled sample gives ``RANK`` latent directions.  Copies
of a labelled text are one vector, whose label is their mean.  The labelled
vectors (at most ``max_labelled``, those of lowest hash, so ``max_labelled *
RANK`` floats) are broadcast, and every document's cosine with every one of
them is computed exactly in blocks; the ``k`` nearest vote with the power
``SHARPNESS`` of their similarity.

Defined results: null text counts as empty; an empty text has the zero vector,
is equally far from all neighbours and gets the mean label of the sampled rows.  Without labelled
rows every score is 0.5.  Equal texts get equal scores.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import blocks, cut_lineage, free_name, least_hashes, letter_table, ngram_counts, shape_table, word_hashes

SHAPE_BITS, LETTER_BITS = 11, 11
MARKERS = 6
MARKER_WEIGHT = 3.0
DIM = (1 << SHAPE_BITS) + (1 << LETTER_BITS) + MARKERS
RANK = 64
MAX_LABELLED = 4000        # bound of the labelled sample (different texts)
LABEL_ROWS = 16_000        # bound of the labels that it is drawn from
K, SHARPNESS = 7, 4
GOOD_SCORE = 0.7           # a text of good quality scores at least this
BLOCK_DOCS = 64


def counts(texts: list[str]) -> np.ndarray:
    """Term counts of whole texts: shape 2- and 4-grams, letter 3-grams, and
    markers for words that repeat the word one or two places before."""
    doc, h = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    marks = []
    for lag in (1, 2):
        same = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])
        rep = np.bincount(doc[lag:][same], minlength=len(texts))
        marks += [rep * (rep > f * n) for f in (0.02, 0.2, 0.6)]
    tf = ngram_counts(texts, [(shape_table(), (2, 4), SHAPE_BITS), (letter_table(), (3,), LETTER_BITS)], MARKERS)
    tf[:, -MARKERS:] = np.stack(marks, 1)
    return tf


@dataclasses.dataclass(frozen=True)
class NeighbourModel:
    idf: np.ndarray        # [DIM]
    basis: np.ndarray      # [DIM, RANK]
    vectors: np.ndarray    # [labelled, RANK], unit length
    labels: np.ndarray     # [labelled], mean of the copies
    k: int = K
    copies: np.ndarray | None = None  # [labelled], rows of each text (None: one each)

    def project(self, tf: np.ndarray) -> np.ndarray:
        return unit(unit(weigh(tf) * self.idf) @ self.basis)

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        k = min(self.k, len(self.labels))
        mean = float(np.average(self.labels, weights=self.copies))
        for first, block in blocks(texts, BLOCK_DOCS):
            cos = self.project(counts(block)) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, 1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(float) ** SHARPNESS
            total = w.sum(1)
            vote = (w * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            out[first:first + len(block)] = np.where(total > 1e-12, vote, mean)
        return np.clip(out, 0.0, 1.0)


def weigh(tf: np.ndarray) -> np.ndarray:
    x = np.log(1 + tf)
    x[:, -MARKERS:] *= MARKER_WEIGHT
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def labelled_texts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
                   rows: int = LABEL_ROWS) -> DataFrame:
    """Written table (text, label) of the documents of at most ``rows`` labels (``doc_id``, ``label``), those of least
    id hash: they are broadcast to one scan, and no other text is moved."""
    drawn = least_hashes(labels.select(F.col(doc_id).alias("labelled_id"), F.col(label).alias("y")).where("y IS NOT NULL"),
                         "labelled_id", rows)
    return cut_lineage(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(drawn), F.col("id") == F.col("labelled_id")).select("text", F.col("y").alias(label)))


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "quality",
        max_labelled: int = MAX_LABELLED, k: int = K) -> NeighbourModel:
    """Document frequencies from all of ``docs``, neighbours from ``labelled``
    (rows with ``text`` and a 0/1 ``label``; other labels are ignored)."""
    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, total = np.zeros(DIM, np.int64), 0
        for b in batches:
            for _, block in blocks(b["text"].tolist(), BLOCK_DOCS):
                df += (counts(block) > 0).sum(0)
                total += len(block)
        if total:
            yield pd.DataFrame({"term": np.arange(DIM + 1), "df": np.append(df, total)})

    sums = (docs.select(F.col(text).alias("text")).mapInPandas(frequencies, "term int, df long")
            .groupBy("term").agg(F.sum("df").alias("df")).toPandas().set_index("term")["df"].astype(float))
    df = sums.reindex(range(DIM + 1)).fillna(0).to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).where(
        "label IN (0, 1) AND text IS NOT NULL")
    rows = rows.withColumns({"draw": F.xxhash64("text"), "tie": F.xxhash64(F.lit(1), "text")})
    # the texts of lowest hash, their copies counted by hash
    sample = rows.groupBy("draw", "tie").agg(F.count("*").alias("copies"), F.avg("label").alias("label")).orderBy(
        "draw", "tie").limit(max_labelled).toPandas()
    if not len(sample):
        return NeighbourModel(idf, np.zeros((DIM, 1)), np.zeros((0, 1)), np.zeros(0), k)
    last = sample.iloc[-1]
    end = int(last["draw"]), int(last["tie"])
    rows = rows.where((F.col("draw") < end[0]) | ((F.col("draw") == end[0]) & (F.col("tie") <= end[1])))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One vector of each different text of the task."""
        seen: set = set()
        for b in batches:
            b = b[[key not in seen and not seen.add(key) for key in zip(b["draw"], b["tie"], strict=True)]]
            draws, ties = b["draw"].tolist(), b["tie"].tolist()
            for first, block in blocks(b["text"].tolist(), BLOCK_DOCS):
                tf = counts(block)
                nz = [np.flatnonzero(r) for r in tf]
                yield pd.DataFrame({"draw": draws[first:first + len(block)], "tie": ties[first:first + len(block)],
                                    "terms": [z.astype(np.uint16).tobytes() for z in nz],
                                    "tf": [r[z].astype(np.float32).tobytes() for r, z in zip(tf, nz, strict=True)]})

    found = rows.select("text", "draw", "tie").mapInPandas(vectors, "draw long, tie long, terms binary, tf binary").groupBy(
        "draw", "tie").agg(F.first("terms").alias("terms"), F.first("tf").alias("tf")).toPandas()
    sample = sample.merge(found, on=["draw", "tie"]).sort_values(["draw", "tie"])
    x = np.zeros((len(sample), DIM), np.float32)
    for i, (t, v) in enumerate(zip(sample.terms, sample.tf, strict=True)):  # row by row: one matrix in memory
        x[i, np.frombuffer(t, np.uint16)] = np.frombuffer(v, np.float32)
        x[i] = unit(weigh(x[i:i + 1]) * idf)[0]
    basis = latent_basis(x, RANK)
    return NeighbourModel(idf.astype(np.float32), basis, unit(x @ basis), sample.label.to_numpy().astype(float), k,
                          sample.copies.to_numpy())


def latent_basis(x: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of ``x`` by randomised range finding with two power steps."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[0], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x @ (x.T @ q))
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T


def quality(model: NeighbourModel, text: Column | str = "text") -> Column:
    """Score column (0 to 1) for a text column."""
    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(model.score(s.tolist()))

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def add_quality(docs: DataFrame, model: NeighbourModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a quality score; a column of that name is replaced."""
    return docs.withColumn(out, quality(model, text))


def keep_quality(docs: DataFrame, model: NeighbourModel, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """Rows that score at least ``min_score``; columns unchanged."""
    p = free_name(docs, "quality")
    return docs.withColumn(p, quality(model, text)).where(F.col(p) >= min_score).drop(p)
