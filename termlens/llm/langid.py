"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-Proximal)
and elastic-net penalties, then calibrated with one temperature.

Training reads only ``text`` and ``lang`` of the rows it is given.  Document
frequencies are counted over all of them by Spark; the regression itself is
fitted on a bounded hash sample (``rows_per_class`` expected rows a language),
of which ``CALIBRATION_SHARE`` set the temperature.  Prediction is one Arrow
UDF column over whole texts: no shuffle, and a broadcast of
``languages * 2 ** bits`` weights.

Defined results: null text, or text without a letter: ``und``, score 0.  No
training row: every text is ``und``.  Equal texts get equal results.  A column
of the input that has the output's name is replaced.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import blocks, free_name, letter_table, ngram_counts

UNKNOWN = "und"
BITS = 13                 # n-gram buckets: 2 ** BITS
ORDERS = (1, 2, 3)
ROWS_PER_CLASS = 1500     # bound of the training sample, expected rows a language
FULL_LANGUAGES = 200      # with more languages, each has a smaller sample of the same total
CALIBRATION_SHARE = 0.2
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 2
BLOCK_DOCS = 64


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray          # [buckets]
    weights: np.ndarray      # [buckets, languages]
    temperature: float

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for first, block in blocks(texts, BLOCK_DOCS):
            tf = ngram_counts(block, [(letter_table(), ORDERS, BITS)])
            logits = (unit_tfidf(tf, self.idf) @ self.weights).astype(float) / self.temperature
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i in (i for i, t in enumerate(block) if has_letter(t)):
                names[first + i] = self.languages[best[i]]
                scores[first + i] = p[i, best[i]]
        return names, scores


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def unit_tfidf(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log(1 + tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang",
        rows_per_class: int = ROWS_PER_CLASS) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang`` of ``rows``."""
    rows = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.where("text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
             .collect()}
    if not sizes:
        return LanguageModel((), np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), 1.0)
    languages = tuple(sorted(sizes))
    per_class = rows_per_class * min(1.0, FULL_LANGUAGES / len(sizes))
    rate = {g: min(1.0, per_class / n) for g, n in sizes.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Partial document frequencies of the task, and the sampled rows' n-grams."""
        df, total = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            texts, langs, draw = b["text"].tolist(), b["lang"].tolist(), b["draw"].to_numpy()
            for first, block in blocks(texts, BLOCK_DOCS):
                tf = ngram_counts(block, [(letter_table(), ORDERS, BITS)])
                df += (tf > 0).sum(0)
                total += len(block)
                keep = [i for i in range(len(block)) if draw[first + i] < rate.get(langs[first + i], 0)
                        and has_letter(block[i])]
                if keep:
                    nz = [np.flatnonzero(tf[i]) for i in keep]
                    yield pd.DataFrame({
                        "bucket": -1, "df": 0, "lang": [langs[first + i] for i in keep],
                        "draw": draw[[first + i for i in keep]],
                        "grams": [z.astype(np.uint16).tobytes() for z in nz],
                        "tf": [tf[i, z].astype(np.float32).tobytes() for i, z in zip(keep, nz, strict=True)]})
        if total:
            yield pd.DataFrame({"bucket": np.arange(1 << BITS), "df": df, "lang": None, "draw": 0.0,
                                "grams": None, "tf": None})
            yield pd.DataFrame({"bucket": [1 << BITS], "df": [total], "lang": None, "draw": 0.0,
                                "grams": None, "tf": None})

    # a uniform draw in [0, 1) from the text: the same rows whatever the partitioning
    draw = (F.xxhash64("text") / F.lit(float(1 << 63)) + 1) / 2
    got = (rows.where("text IS NOT NULL").withColumn("draw", draw)
           .mapInPandas(count, "bucket int, df long, lang string, draw double, grams binary, tf binary")
           .groupBy("bucket", "lang", "draw", "grams", "tf").agg(F.sum("df").alias("df"), F.count("*").alias("copies")))
    got = got.toPandas()  # 2 ** BITS sums and the bounded sample
    sums = got[got.bucket >= 0].set_index("bucket")["df"].astype(float)
    n_docs = sums.get(1 << BITS, 0.0)
    df = sums.reindex(range(1 << BITS)).fillna(0).to_numpy()
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    sample = got[got.bucket < 0].sort_values(["draw", "lang"])
    x = []
    for g, v in zip(sample.grams, sample.tf, strict=True):
        idx = np.frombuffer(g, np.uint16).astype(np.int64)
        val = np.log1p(np.frombuffer(v, np.float32).astype(float)) * idf[idx]
        x.append((idx, val / max(np.linalg.norm(val), 1e-12)))
    y = sample.lang.map({g: i for i, g in enumerate(languages)}).to_numpy()
    # the order of training is that of another hash, so that languages alternate
    order = np.argsort((sample.draw.to_numpy() * 7919) % 1.0, kind="stable")
    held = order[: int(len(order) * CALIBRATION_SHARE)]
    rest = order[len(held):]
    weights = ftrl([x[i] for i in rest], y[rest], len(languages))
    logits = np.array([weights[x[i][0]].T @ x[i][1] for i in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, idf.astype(np.float32), weights.astype(np.float32), temperature(logits, y[held]))


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> np.ndarray:
    """FTRL-Proximal with per-coordinate rates; L1 and L2 give sparse weights."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))

    def solve(zz, nn):
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (idx, val), label in zip(x, y, strict=True):
            zz, nn = z[idx], n[idx]
            w = solve(zz, nn)
            logit = val @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            g = val[:, None] * p
            g2 = g * g
            z[idx] = zz + g - (np.sqrt(nn + g2) - np.sqrt(nn)) / ALPHA * w
            n[idx] = nn + g2
    return solve(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood (golden section on its logarithm)."""
    if not len(y) or logits.shape[1] < 2:
        return 1.0

    def loss(log_t):
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    lo, hi, r = np.log(0.05), np.log(5.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def language(model: LanguageModel, text: Column | str = "text") -> Column:
    """Struct column (lang_pred, score) for a text column."""
    @F.pandas_udf("lang_pred string, score double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            names, scores = model.predict(s.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def add_language(docs: DataFrame, model: LanguageModel, text: str = "text",
                 out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability."""
    p = free_name(docs, "language")
    return docs.withColumn(p, language(model, text)).withColumns(
        {out[0]: F.col(p)["lang_pred"], out[1]: F.col(p)["score"]}).drop(p)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """Rows whose language is known with at least ``min_score``; columns unchanged."""
    p = free_name(docs, "language")
    return docs.withColumn(p, language(model, text)).where(
        (F.col(p)["lang_pred"] != UNKNOWN) & (F.col(p)["score"] >= min_score)).drop(p)
