"""Toxicity by compression distance: zstandard compresses every window of a text
with two dictionaries, one of them trained on ordinary text, the other that one
behind a contrast lexicon of toxic text; the bytes that the latter saves are
the evidence.

Both dictionaries end in the same core, trained by zstandard on ordinary
windows, so ordinary text compresses alike under both.  In front of it the
toxic one holds the segments whose byte 5-grams are over-represented in toxic
documents (contrast instead of plain frequency, for most text of a toxic
document is ordinary), the other blanks, which keep the core at the same
distance.  Every window is compressed at two levels, whose chance matches
differ.  The two dictionaries differ in the lexicon only, so a window that shares
no ``GRAM`` bytes with it saves nothing and isn't compressed (one vectorised
lookup of a text's byte 5-grams tells which do).  A logistic regression on each
document's histograms of savings sets the calibrated threshold.

Fitting uses bounded hash samples of the labelled rows (``2 * docs_per_class``
expected rows a class).  Half of the ordinary ones train the core, the others
calibrate.  All toxic ones feed the lexicon; they calibrate in ``FOLDS`` folds,
each with a lexicon of the others.  Scoring is one Arrow UDF column over whole texts.

Defined results: null text counts as empty; an empty text has no window and
gets the model's base rate for no evidence.  If a class has no labelled row,
every score is 0.  Equal texts get equal scores.
"""

from __future__ import annotations

import collections
import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import cut_lineage

GRAM = 5
WINDOW_WORDS, STRIDE_WORDS = 8, 6
MAX_WORD_BYTES = 64            # a longer run without white space is cut into overlapping words
LEVELS = (6, 12)
CORE_BYTES = 32 << 10
TOXIC_BYTES = 16 << 10
TRAIN_BYTES = 4 << 20          # ordinary windows that train the core
DOCS_PER_CLASS = 2000          # half of the bound of the sample, expected rows a class
MIN_DOCS, MIN_LIFT = 6, 2.5    # of a contrast 5-gram
MAX_GRAMS = 20_000
FOLDS = 4                      # of the calibration
HIT_BITS = 22                  # of the table of the lexicon's 5-grams
STEPS = np.arange(1, 9)        # bytes saved by a window: histogram


def words_of(text: str | None) -> list[bytes]:
    out = []
    for w in (text or "").lower().encode("utf-8", "replace").split():
        if len(w) <= MAX_WORD_BYTES:
            out.append(w)
        else:
            out += [w[i:i + MAX_WORD_BYTES] for i in range(0, len(w) - GRAM, MAX_WORD_BYTES - 16)]
    return out


def windows_of(text: str | None) -> Iterator[bytes]:
    """Overlapping windows of a few words that together cover the whole text."""
    ws = words_of(text)
    for i in range(0, max(len(ws) - (WINDOW_WORDS - STRIDE_WORDS), min(len(ws), 1)), STRIDE_WORDS):
        yield b" " + b" ".join(ws[i:i + WINDOW_WORDS]) + b" "


def grams_of(word: bytes) -> list[int]:
    """Codes of the byte 5-grams of a word with a space on each side."""
    b = b" " + word + b" "
    return [int.from_bytes(b[i:i + GRAM], "big") for i in range(len(b) - GRAM + 1)]


@functools.lru_cache(maxsize=5)
def _compressors(ordinary: bytes, toxic: bytes):
    made = []
    for level in LEVELS:
        pair = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            pair.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                                 write_checksum=False, write_dict_id=False))
        made.append(pair)
    return made


def gram_codes(data: bytes) -> np.ndarray:
    """``HIT_BITS``-bit hashes of the byte 5-grams of ``data``."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    code = np.zeros(max(len(b) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM):
        code = (code << np.uint64(8)) | b[i:i + len(code)]
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HIT_BITS)


@functools.lru_cache(maxsize=5)
def _hits(lexicon: bytes) -> np.ndarray:
    table = np.zeros(1 << HIT_BITS, bool)
    table[gram_codes(lexicon)] = True
    return table


@dataclasses.dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    coef: np.ndarray        # of features()
    fitted: bool = True
    lexicon: bytes = b""    # what ``toxic`` holds before the common core

    def suspects(self, windows: list[bytes]) -> np.ndarray:
        """Places of the windows that share ``GRAM`` bytes with the lexicon."""
        codes = gram_codes(b"".join(windows))
        if not len(codes):
            return np.zeros(0, np.int64)
        ends = np.cumsum([len(w) for w in windows])
        at = np.flatnonzero(_hits(self.lexicon)[codes])
        place = np.searchsorted(ends, at, side="right")
        return np.unique(place[at + GRAM <= ends[place]])

    def features(self, text: str | None) -> np.ndarray:
        """1 and the log of windows; then per level, of the windows that save
        each step, the log of their number and of their share, and the
        windows' mean and normalised total saving."""
        windows = list(windows_of(text)) or [b""]
        out = [[1.0, np.log1p(len(windows))]]
        some = self.suspects(windows)
        for ordinary, toxic in _compressors(self.ordinary, self.toxic):
            saved = np.zeros(len(windows))
            saved[some] = [len(ordinary.compress(windows[i])) - len(toxic.compress(windows[i])) for i in some]
            hist = (saved[:, None] >= STEPS).sum(0)
            out += [np.log1p(hist), np.log1p(1000 * hist / len(windows)) / 5,
                    [saved.mean(), saved.sum() / np.sqrt(len(windows))]]
        return np.concatenate(out)

    def score(self, texts: list) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        z = np.array([self.features(t) @ self.coef for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
        docs_per_class: int = DOCS_PER_CLASS) -> ToxicityModel:
    """Learn from the texts of ``docs`` that ``labels`` (``key``, 0/1
    ``label``; other labels are ignored) marks.  The sample is drawn from the
    labels alone (at most about ``4 * docs_per_class`` rows) and broadcast to
    the one scan of the texts; its texts are written once."""
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    sizes = {r.label: r.n for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return ToxicityModel(b"", b"", np.zeros(0), False)
    share = {k: min(1.0, 2 * docs_per_class / n) for k, n in sizes.items()}
    u = F.col("draw") / F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    # toxic rows: all train and all calibrate, by folds; ordinary rows: half train (no fold), half calibrate
    at = F.when(F.col("label") == 1, u).otherwise(2 * u - 1)
    marks = marks.withColumn("draw", (F.xxhash64("key") / F.lit(float(1 << 63)) + 1) / 2).where(u < 1).withColumn(
        "fold", F.when(at < 0, -1).otherwise(F.least(F.floor(at * FOLDS), F.lit(FOLDS - 1))).cast("int"))
    rows = cut_lineage(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").join(
        F.broadcast(marks), "key").drop("key"))
    train, check = rows.where("label = 1 OR fold < 0"), rows.where("fold >= 0")
    n_plain = min(float(docs_per_class), sizes[0] / 2)
    n_sample = min(2.0 * docs_per_class, sizes[1])
    # model m leaves out the toxic rows of fold m, the last one none
    n_toxic = [n_sample * (1 - 1 / FOLDS)] * FOLDS + [n_sample]
    need = [min(MIN_DOCS, max(2, n // 20)) for n in n_toxic]

    def document_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = collections.defaultdict(collections.Counter)
        for b in batches:
            for t, k in zip(b["text"], b["fold"], strict=True):
                seen[k].update({g for w in set(words_of(t)) for g in grams_of(w)})
        for k, found in seen.items():
            if found:
                yield pd.DataFrame({"gram": list(found), "fold": k, "n": list(found.values())})

    g = train.mapInPandas(document_grams, "gram long, fold int, n long").groupBy("gram").agg(
        F.sum(F.when(F.col("fold") < 0, F.col("n")).otherwise(0)).alias("plain"),
        F.sum(F.when(F.col("fold") >= 0, F.col("n")).otherwise(0)).alias(f"t{FOLDS}"),
        *[F.sum(F.when(F.col("fold") >= 0, F.col("n")).otherwise(0) - F.when(F.col("fold") == m, F.col("n")).otherwise(0))
          .alias(f"t{m}") for m in range(FOLDS)])

    def contrast(m: int) -> Column:
        lift = F.log((F.col(f"t{m}") + 0.5) / (n_toxic[m] + 1)) - F.log((F.col("plain") + 0.5) / (n_plain + 1))
        return (F.col(f"t{m}") >= need[m]) & (lift > MIN_LIFT)

    models = range(FOLDS + 1)
    g = g.select("gram", *[F.when(contrast(m), F.col(f"t{m}")).otherwise(0).alias(f"t{m}") for m in models])
    g = g.where(" OR ".join(f"t{m} > 0" for m in models)).orderBy(
        F.desc(F.greatest(*[f"t{m}" for m in models])), "gram").limit(MAX_GRAMS * (FOLDS + 1)).toPandas()
    grams = [frozenset(g[g[f"t{m}"] > 0].sort_values([f"t{m}", "gram"], ascending=[False, True]).gram.head(MAX_GRAMS).tolist())
             for m in models]
    # expected windows of the ordinary sample that train the core: about TRAIN_BYTES
    plain_bytes = train.where("label = 0").agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 1
    one_in = max(1, int(plain_bytes // TRAIN_BYTES))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per model the toxic segments (runs of contrast 5-grams) with their counts, and ordinary windows (model -1)."""
        runs: list[collections.Counter] = [collections.Counter() for _ in models]
        plain: list[bytes] = []
        for b in batches:
            for t, k in zip(b["text"], b["fold"], strict=True):
                if k < 0:
                    plain += [w for i, w in enumerate(windows_of(t)) if i % one_in == 0]
                    continue
                for w in set(words_of(t)):
                    spaced, codes = b" " + w + b" ", grams_of(w)
                    for m in models:
                        i = 0
                        while m != k and i < len(codes):
                            j = i
                            while j < len(codes) and codes[j] in grams[m]:
                                j += 1
                            if j > i:
                                runs[m][spaced[i:j + GRAM - 1]] += 1
                            i = j + 1
        for m in models:
            if runs[m]:
                yield pd.DataFrame({"model": m, "piece": list(runs[m]), "n": list(runs[m].values())})
        if plain:
            yield pd.DataFrame({"model": -1, "piece": plain, "n": 1})

    got = train.mapInPandas(pieces, "model int, piece binary, n long").groupBy("model", "piece").agg(
        F.sum("n").alias("n")).toPandas()
    plain = [bytes(p) for p in got[got.model == -1].sort_values("piece").piece]
    plain = [plain[i] for i in np.random.default_rng(7).permutation(len(plain))]
    core = train_core(plain)

    def dictionaries(m: int) -> ToxicityModel:
        toxic = got[(got.model == m) & (got.n >= 2)].sort_values(["n", "piece"], ascending=[False, True])
        size = np.cumsum([len(p) for p in toxic.piece]) if len(toxic) else np.zeros(0)
        special = b"".join(reversed([bytes(p) for p, s in zip(toxic.piece, size, strict=True) if s <= TOXIC_BYTES]))
        return ToxicityModel(b" " * len(special) + core, special + core, np.zeros(0), lexicon=special)

    *crossed, model = [dictionaries(m) for m in models]

    def document_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "draw": b["draw"], "x": [
                crossed[k].features(t).tolist() for t, k in zip(b["text"], b["fold"], strict=True)]})

    f = check.mapInPandas(document_features, "label int, draw double, x array<double>").toPandas()
    if set(f.label) != {0, 1}:
        return ToxicityModel(b"", b"", np.zeros(0), False)
    f = f.sort_values(["draw", "label"])
    # the calibration holds the classes at other rates than the corpus: weigh them back
    y = f.label.to_numpy().astype(float)
    weight = np.where(y == 1, 1 / share[1], 2 / share[0])
    return dataclasses.replace(model, coef=logistic(np.stack(f.x.to_numpy()), y, weight / weight.mean()))


def train_core(windows: list[bytes]) -> bytes:
    """zstandard's own trainer over ordinary windows; a tiny corpus serves as it is."""
    groups = [b"".join(windows[i:i + 4]) for i in range(0, len(windows), 4)]
    try:
        return zstandard.train_dictionary(CORE_BYTES, groups).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(windows)[-CORE_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the constant is not penalised."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity(model: ToxicityModel, text: Column | str = "text") -> Column:
    """Score column (0 to 1) for a text column."""
    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(model.score(s.tolist()))

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def add_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a toxicity score; a column of that name is replaced."""
    return docs.withColumn(out, toxicity(model, text))
