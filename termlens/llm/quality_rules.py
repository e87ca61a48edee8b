"""Quality rules whose thresholds adapt to each language and source.

One pass counts words, symbols, repeated lines and repeated three-word windows
of every whole text.  KLL quantile sketches of the derived ratios are built, over
the texts that pass the base rule, per (language, source) and merged upwards, per language and over all; a group with
fewer than ``MIN_GROUP`` texts uses its language's sketch, a small language
the one over all.  A text is kept unless it fails the base rule or a ratio
lies beyond the fence of its group.  The upper fence is the upper quartile plus
a multiple of the group's spread: the larger of the quartile's distance from the
median and ``TAIL`` of that of the 99th percentile.  Words have a lower fence as
well, by the lower quartile and the first percentile.  No cutoff is fixed: only
where a group has no spread at all (every text without a symbol, say) that of its
language, then that of all texts is taken (``borrowed`` counts these ratios).

Column expressions only.  Defined results: null text has no word; null
language or source is a group of its own; empty input gives no row; repeated
rows are judged each.  Other columns stay as they are; columns with the
outputs' names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import cut_lineage, free_name

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50     # base rule
MIN_GROUP = 200
SKETCH_K = 400                             # rank error about 0.7 %
TAIL = 0.1
# Ratio, and how many spreads beyond the quartile its fence stands.
FENCES = {"symbol_ratio": 2.0, "repeat_ratio": 30.0, "dup_line_ratio": 30.0, "long_word_ratio": 6.0}
TWO_SIDED = ("long_word_ratio",)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# White space between words, symbols.
SPACE, SYMBOLS = r"[\\x20\\x09-\\x0D]+", "[#*$%&|<>]+"
WORD = r"[^\\x20\\x09-\\x0D]"

# Words in three-word windows that occur twice or more: windows are sorted by
# hash, equal neighbours give the repeated places, and the union of the places'
# three words is summed over the sorted places (the first term stands for the
# last window's three words).
_REPEATS = """CASE WHEN size(ws) < 4 THEN 0L ELSE transform(array(sort_array(
    transform(sequence(0, size(ws) - 3), i -> struct(xxhash64(ws[i], ws[i + 1], ws[i + 2]) AS h, i AS p)))), s ->
  aggregate(sort_array(transform(filter(s, (x, i) -> if(i > 0, s[i - 1].h = x.h, false)
        OR if(i < size(s) - 1, s[i + 1].h = x.h, false)), x -> x.p)),
    struct(0L AS total, -3 AS last), (a, p) -> struct(a.total + least(3, p - a.last) AS total, p AS last),
    a -> a.total))[0] END"""


def add_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five counts, ``n_lines`` (lines with a word) and ``base_failed``."""
    t = free_name(docs, "t")
    x = f"coalesce(`{text}`, '')"
    docs = docs.withColumn(t, F.expr(f"""struct(
        transform(array(filter(split({x}, '{SPACE}', -1), w -> w <> '')), ws -> struct(
            cast(size(ws) AS bigint) AS n_words, aggregate(ws, 0L, (a, w) -> a + char_length(w)) AS word_chars,
            {_REPEATS} AS n_repeat_words))[0] AS w,
        cast(char_length({x}) - char_length(regexp_replace({x}, '{SYMBOLS}', '')) AS bigint) AS n_symbols,
        transform(array(transform(filter(split({x}, '\\n', -1), l -> l rlike '{WORD}'), l -> xxhash64(l))), ls -> struct(
            cast(size(ls) AS bigint) AS n_lines, cast(size(ls) - size(array_distinct(ls)) AS bigint) AS n_dup_lines))[0] AS l)"""))
    c = F.col(t)
    docs = docs.withColumns({"n_words": c["w"]["n_words"], "word_chars": c["w"]["word_chars"],
                             "n_symbols": c["n_symbols"], "n_dup_lines": c["l"]["n_dup_lines"],
                             "n_repeat_words": c["w"]["n_repeat_words"], "n_lines": c["l"]["n_lines"]}).drop(t)
    return docs.withColumn("base_failed", F.expr(
        f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def _ratios() -> dict:
    return {"symbol_ratio": F.expr("n_symbols / greatest(word_chars, 1L)"),
            "repeat_ratio": F.expr("n_repeat_words / greatest(n_words, 1L)"),
            "dup_line_ratio": F.expr("n_dup_lines / greatest(n_lines, 1L)"),
            "long_word_ratio": F.expr("word_chars / greatest(n_words, 1L)")}


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Per (``g_lang``, ``g_source``): the group used (``basis``), the fences of each ratio, and how many are ``borrowed``."""
    rows = counted.where("NOT base_failed").select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"),
                          *[v.cast("double").alias(k) for k, v in _ratios().items()])
    leaf = cut_lineage(rows.groupBy("g_lang", "g_source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in FENCES]))
    merged = [F.kll_merge_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in FENCES]
    whole = leaf.agg(F.sum("n").alias("n"), *merged).first()              # one row of sketches
    over_all = {k: F.lit(whole[k]) if whole["n"] else F.lit(None).cast("binary") for k in FENCES}
    by_lang = leaf.groupBy("g_lang").agg(F.sum("n").alias("n"), *merged).select(
        F.col("g_lang").alias("b_lang"), F.col("n").alias("b_n"), *[F.col(k).alias(f"up_{k}") for k in FENCES])
    own, large = F.col("n") >= MIN_GROUP, F.col("b_n") >= MIN_GROUP
    both = leaf.join(by_lang, F.col("g_lang").eqNullSafe(F.col("b_lang")))

    def q(sketch, at):
        return F.kll_sketch_get_quantile_double(sketch, F.lit(at))

    def spread(sketch, quartile, tail):
        return F.greatest(F.abs(q(sketch, quartile) - q(sketch, 0.5)), TAIL * F.abs(q(sketch, tail) - q(sketch, 0.5)))

    def fence(k, quartile, tail, sign):
        """(place, spread of the group's own basis)"""
        used = F.when(own, F.col(k)).when(large, F.col(f"up_{k}")).otherwise(over_all[k])
        wide = spread(used, quartile, tail)
        up = F.when(large, spread(F.col(f"up_{k}"), quartile, tail))
        some = F.when(wide > 0, wide).when(up > 0, up).otherwise(spread(over_all[k], quartile, tail))
        return q(used, quartile) + sign * FENCES[k] * some, (wide <= 0).cast("int")

    high = {k: fence(k, 0.75, 0.99, 1) for k in FENCES}
    low = {k: fence(k, 0.25, 0.01, -1) for k in TWO_SIDED}
    return both.select("g_lang", "g_source", F.when(own, "source").when(large, "language").otherwise("all").alias("basis"),
                       *[v.alias(f"max_{k}") for k, (v, _) in high.items()], *[v.alias(f"min_{k}") for k, (v, _) in low.items()],
                       sum((b for _, b in [*high.values(), *low.values()]), F.lit(0)).alias("borrowed"))


def judge(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counted`` (see :func:`add_counts`) with ``kept`` and the ``basis`` of its thresholds."""
    limits = thresholds(counted, lang, source)
    taken = {c: free_name(counted, c) for c in ("g_lang", "g_source", *[f"max_{k}" for k in FENCES], *[f"min_{k}" for k in TWO_SIDED])}
    limits = limits.drop("borrowed").withColumnsRenamed(taken)
    joined = counted.drop("basis", "kept").join(
        limits, F.col(lang).eqNullSafe(F.col(taken["g_lang"])) & F.col(source).eqNullSafe(F.col(taken["g_source"])), "left")
    fine = ~F.col("base_failed")
    for k, v in _ratios().items():
        fine = fine & (v <= F.col(taken[f"max_{k}"]))
        if k in TWO_SIDED:
            fine = fine & (v >= F.col(taken[f"min_{k}"]))
    return joined.withColumn("kept", F.coalesce(fine, F.lit(False))).drop(*taken.values())


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Verdict per row with the ``keep`` columns.  The counts are written once,
    without the texts, and read for the sketches and for the verdict."""
    columns = list(dict.fromkeys([*keep, lang, source]))
    counted = cut_lineage(add_counts(docs.select(*columns, F.col(text).alias("__text")), "__text").drop("__text"))
    return judge(counted, lang, source).select(*keep, *COUNTS, "base_failed", "kept", "basis")
