"""Line dedup by distinct-site spread.

Every line is hashed; lines met on one site only are dropped by a plain
minimum/maximum aggregate.  For the others a HyperLogLog sketch per line hash
merges the sites (partial sketches per task, so a line in a third of all rows
costs a sketch a task).  Lines whose estimate is near ``min_sites`` get an
exact distinct count.  A line on at least ``min_sites`` sites is boilerplate:
its first occurrence (least document id, then line number) stays, so its
content is kept once, and every other one is removed.

Lines shorter than ``min_chars`` code points, which may be ordinary sentences,
need ``short_sites`` sites instead; without that number they are never
boilerplate.

Defined results: null text stays null and has no line; a short
line without a letter or digit is never boilerplate; a null site counts as one
site of its own; repeated rows are equal copies, of which each keeps the first
occurrence; null ids come last.  Columns of the input stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import cut_lineage, free_name

MIN_SITES = 10
MIN_CHARS = 20
LOG_K = 12                 # sketch size; relative error about 0.83 / 2 ** (LOG_K / 2)
NO_SITE = "\x00"
ALL_LINES = {"min_sites": 5, "short_sites": 10}    # every line that holds a letter or digit (op6 and the pipeline)
MAX_BROADCAST_LINES = 200_000                      # boilerplate lines broadcast to their occurrences, some 60 bytes each


def near_margin(min_sites: int, log_k: int = LOG_K) -> float:
    """Estimates this close to the threshold are counted exactly (over four standard errors)."""
    return max(1.0, 4 * 0.83 / 2 ** (log_k / 2) * min_sites)


def _lines(docs: DataFrame, text: str, site: str, doc_id: str, min_sites: int, min_chars: int,
           short_sites: int | None) -> DataFrame:
    """The lines that count, with the number of sites that each ``need``s."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("tk"),
                       F.coalesce(F.col(site).cast("string"), F.lit(NO_SITE)).alias("site"),
                       F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "line"))
    long = F.length("line") >= min_chars
    counts = long if short_sites is None else long | F.col("line").rlike(r"[\p{L}\p{N}]")
    need = F.lit(min_sites) if short_sites is None else F.when(long, min_sites).otherwise(short_sites)
    return rows.where(counts).select(
        "id", "tk", "site", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), need.alias("need"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, text: str = "text",
                site: str = "source", doc_id: str = "doc_id", short_sites: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(line hashes on as many sites as they need, occurrences of lines on two sites or more)."""
    lines = _lines(docs, text, site, doc_id, min_sites, min_chars, short_sites)
    spread = lines.select("h1", "h2", F.xxhash64("site").alias("s")).groupBy("h1", "h2").agg(
        F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("h1", "h2")
    met = cut_lineage(lines.join(spread, ["h1", "h2"], "left_semi"))
    sketch = met.groupBy("h1", "h2", "need").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sk"))
    margin = F.lit(near_margin(min_sites))
    if short_sites is not None:
        margin = F.when(F.col("need") == short_sites, near_margin(short_sites)).otherwise(margin)
    est = cut_lineage(sketch.select("h1", "h2", "need", F.hll_sketch_estimate("sk").alias("sites"), margin.alias("margin"))
                      .where(F.col("sites") >= F.col("need") - F.col("margin")))
    sure = est.where(F.col("sites") > F.col("need") + F.col("margin")).select("h1", "h2")
    exact = (met.join(est.where(F.col("sites") <= F.col("need") + F.col("margin")), ["h1", "h2"], "left_semi")
             .groupBy("h1", "h2", "need", "site").agg(F.lit(1).alias("one"))
             .groupBy("h1", "h2", "need").agg(F.count("*").alias("n")).where("n >= need").select("h1", "h2"))
    return cut_lineage(sure.unionByName(exact)), met


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, text: str = "text",
                  site: str = "source", doc_id: str = "doc_id", short_sites: int | None = None) -> DataFrame:
    """Per document (``id``, hash ``tk`` of its text): the numbers of the lines to remove."""
    lines, met = boilerplate(docs, min_sites, min_chars, text, site, doc_id, short_sites)
    hits = met.join(lines, ["h1", "h2"], "left_semi")
    place = F.struct(F.col("id").isNull().alias("z"), "id", "tk", "i")
    first = hits.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    if lines.count() <= MAX_BROADCAST_LINES:      # so that a line's many occurrences needn't meet in one task
        first = F.broadcast(first)
    return (hits.withColumn("place", place).join(first, ["h1", "h2"]).where("NOT (place <=> first)")
            .groupBy("id", "tk").agg(F.collect_set("i").alias("removed")))


def _remaining(text: Column, removed: Column) -> Column:
    """The text without the numbered lines (each line array is made once)."""
    return F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), removed), lambda i: ls[i]), "\n"))[0]


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, text: str = "text",
                site: str = "source", doc_id: str = "doc_id", removed_count: str | None = None,
                short_sites: int | None = None) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; ``removed_count``
    names a further column for the number of removed lines."""
    gone = removed_lines(docs, min_sites, min_chars, text, site, doc_id, short_sites)
    a, b, r = free_name(docs, "id"), free_name(docs, "tk"), free_name(docs, "removed")
    gone = gone.select(F.col("id").alias(a), F.col("tk").alias(b), F.col("removed").alias(r))
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col(a)) & (F.xxhash64(F.col(text)) == F.col(b)), "left")
    out = joined.withColumn(text, F.when(F.col(r).isNull(), F.col(text)).otherwise(_remaining(F.col(text), F.col(r))))
    if removed_count:
        out = out.withColumn(removed_count, F.coalesce(F.size(r), F.lit(0)).cast("long"))
    return out.drop(a, b, r)
