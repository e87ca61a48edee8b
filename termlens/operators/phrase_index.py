"""Positional phrase index: term search without rescanning the corpus.

Three Parquet tables under one folder, written once per corpus:

``postings``    word, n, and arrays of its n places in a block of documents: doc,
                pos (the word's place in the document), frag (its fragment); in
                ``buckets`` directories by the word's hash, sorted by word, so a
                search reads the directories of its words and in them the row
                groups that may hold them.  A block has ``BLOCK_WORDS`` words, or
                one longer document, so a row is bounded, and a word has a row a
                block instead of one an occurrence.
``vocabulary``  word, occurrences; sorted, for prefixes and for the rarest word.
``fragments``   document, frag, highlight, tail (the marks and blanks behind it)
                and the carried columns; in directories by the document's hash.

A term is a phrase of words.  ``*`` after a word, also inside the phrase, stands
for any ending.  A sentence mark followed by a blank inside the term (``mt.
etna``) lets the phrase run over that fragment border; all other neighbours have
to stand in one fragment.  Marks without a blank (``3.5 ma``) separate words as
they do in the text.

A phrase is a group of consecutive positions: every occurrence of a term's i-th
word gives the start ``pos - i``; a phrase begins where the occurrences of one
(term, document, start) fill all of the term's places.  Writing splits large
hash buckets by size (``rebalance``), so a word that is a third of all tokens is
spread over tasks.

Null texts have no words.  Repeated rows of a document (id and text) are matched each,
phrases over a border once.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.constants import DEFAULT_FRAGMENT_LIMIT, FRAGMENT_SPLIT
from termlens.operators.snippets import WILDCARD_KEY_LEN, check_wildcards
from termlens.session import cut_lineage

WORD = r"[\p{L}\p{N}]+"
# A term's words (with their wildcard) and its sentence marks before a blank.
TERM_PIECES = r"[\p{L}\p{N}]+\*?|[.!?]+(?=[\t-\r ])"
BLOCK_WORDS = 1 << 20
MAX_BROADCAST_WORDS = 1_000_000
MASK_WORDS = 62                # of a phrase whose places are bits of a long
MAX_PUSHED_WORDS = 1_000       # words named in the scan's filter
MAX_PUSHED_DOCS = 10_000


def _bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _literals(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, words of each fragment) to rows (word, n, doc, pos, frag): the places of a word in a block."""
    for b in batches:
        ends = np.cumsum(_words_per_row(b.column(1)))
        lo = 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK_WORDS, side="right")))
            yield _block(b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo))
            lo = hi


def _words_per_row(words: pa.ListArray) -> np.ndarray:
    frags = words.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(words.flatten().value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
    last = np.cumsum(frags, dtype=np.int64)
    return ends[last] - ends[last - frags]


def _block(doc: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    def count_up(sizes):
        return np.arange(sizes.sum(), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    per_row, frags = _words_per_row(words), words.flatten()
    frag = np.repeat(count_up(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)),
                     frags.value_lengths().to_numpy(zero_copy_only=False))
    coded = frags.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    by_word = np.argsort(codes, kind="stable")
    n = np.bincount(codes, minlength=len(coded.dictionary))
    ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
    row = np.repeat(np.arange(len(doc)), per_row)

    def places(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(ends, values)

    return pa.RecordBatch.from_arrays([
        coded.dictionary, pa.array(n, pa.int64()), places(doc.take(pa.array(row[by_word]))),
        places(pa.array(count_up(per_row)[by_word], pa.int32())), places(pa.array(frag[by_word], pa.int32()))],
        ["word", "n", "doc", "pos", "frag"])


class PhraseIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, name))

    @classmethod
    def build(cls, docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text",
              carry: Iterable[str] | None = None, buckets: int = 64) -> PhraseIndex:
        """Index ``docs``; ``carry``: columns that snippets bring along (default: all others)."""
        index = cls(docs.sparkSession, path, buckets)
        carry = [c for c in (carry if carry is not None else docs.columns) if c not in (doc_col, text_col)]
        cut = docs.where(F.col(text_col).isNotNull()).select(
            F.col(doc_col).alias("doc"), *carry, F.split(F.regexp_replace(text_col, FRAGMENT_SPLIT, "\n"), "\n").alias("_f"),
            F.regexp_extract_all(text_col, F.lit(FRAGMENT_SPLIT), 0).alias("_s"))
        words = cut.select("doc", F.transform("_f", lambda f: F.regexp_extract_all(F.lower(f), F.lit(WORD), 0)).alias("words"))
        ints = T.ArrayType(T.IntegerType())
        postings = words.mapInArrow(_postings, T.StructType().add("word", "string").add("n", "long").add(
            "doc", T.ArrayType(words.schema["doc"].dataType)).add("pos", ints).add("frag", ints))
        postings.withColumn("bucket", _bucket("word", buckets)).hint("rebalance", "bucket").sortWithinPartitions(
            "bucket", "word").write.partitionBy("bucket").parquet(os.path.join(path, "postings"))
        index._table("postings").groupBy("word").agg(F.sum("n").alias("n")).sort("word").write.parquet(
            os.path.join(path, "vocabulary"))
        frags = cut.select("doc", *carry, F.posexplode(F.arrays_zip("_f", "_s")).alias("frag", "z")).select(
            "doc", "frag", *carry, F.col("z._f").alias("highlight"), F.coalesce("z._s", F.lit("")).alias("tail"))
        frags.withColumn("bucket", _bucket("doc", buckets)).hint("rebalance", "bucket").sortWithinPartitions(
            "bucket", "doc", "frag").write.partitionBy("bucket").parquet(os.path.join(path, "fragments"))
        return index

    # ---- terms ---------------------------------------------------------------

    def term_words(self, terms: Iterable[str] | DataFrame) -> DataFrame:
        """(search_term, i, k, cross, word, n): the words that may stand at place i of a term of k words; n of a place."""
        if isinstance(terms, DataFrame):
            given = terms.select(F.trim(F.lower(F.col(terms.columns[0]))).alias("search_term")).distinct()
        else:
            terms = sorted({t.strip().lower() for t in terms if t and t.strip()})
            check_wildcards(terms)
            given = self.spark.createDataFrame([(t,) for t in terms], "search_term string")
        el = given.select("search_term", F.regexp_extract_all("search_term", F.lit(TERM_PIECES), 0).alias("el"))
        pieces = F.filter(F.transform("el", lambda e, j: F.struct(
            e.alias("token"), (F.element_at("el", F.when(j > 0, j).otherwise(1)).rlike("^[.!?]")).alias("cross"))),
            lambda s: ~s["token"].rlike("^[.!?]"))
        t = el.select("search_term", F.size(pieces).alias("k"), F.posexplode(pieces).alias("i", "p")).select(
            "search_term", "i", "k", F.col("p.cross").alias("cross"), F.col("p.token").alias("token"))
        vocabulary = self._table("vocabulary")
        exact = t.where("NOT endswith(token, '*')").withColumnRenamed("token", "word").join(vocabulary, "word", "left")
        # a prefix is found by its first letters, then compared whole
        prefix = t.where("endswith(token, '*')").withColumn("token", F.expr("left(token, length(token) - 1)")).withColumn(
            "key", F.substring("token", 1, WILDCARD_KEY_LEN))
        keys = vocabulary.withColumn("key", F.explode(F.array_distinct(F.array(
            *[F.substring("word", 1, j) for j in range(1, WILDCARD_KEY_LEN + 1)]))))
        wild = prefix.join(keys, "key").where(F.startswith("word", "token"))
        cols = ["search_term", "i", "k", "cross", "word", "n"]
        found = exact.select(*cols).unionByName(wild.select(*cols))
        n = F.coalesce(F.sum("n").over(Window.partitionBy("search_term", "i")), F.lit(0))
        return cut_lineage(found.withColumn("n", n))

    # ---- search --------------------------------------------------------------

    def occurrences(self, words: DataFrame) -> DataFrame:
        """Postings of the words of terms, with the start that their phrase would have."""
        rows = self._table("postings")
        size = words.count()
        if size <= MAX_BROADCAST_WORDS:
            buckets = [r[0] for r in words.select(_bucket("word", self.buckets)).distinct().collect()]    # at most self.buckets
            rows = rows.where(F.col("bucket").isin(buckets))
            if size <= MAX_PUSHED_WORDS:
                rows = rows.where(F.col("word").isin([r.word for r in words.select("word").distinct().collect()]))
            words = F.broadcast(words)
        places = rows.join(words.withColumnRenamed("n", "_n"), "word").select(
            "search_term", "i", "k", "cross", F.inline(F.arrays_zip("doc", "pos", "frag")))
        return places.select(
            "search_term", "doc", (F.col("pos") - F.col("i")).alias("start"), "i", "k", "cross", "frag")

    def matches(self, terms: Iterable[str] | DataFrame) -> DataFrame:
        """(search_term, doc, frag_idx, last_frag): fragments where a term's phrase begins, and where it ends."""
        words = self.term_words(terms)
        # terms with a word that never occurs have no match; the rarest place of the others leads
        rank = words.groupBy("search_term").agg(F.min(F.struct("n", "i")).alias("m")).where("m.n > 0").select(
            "search_term", F.col("m.i").alias("lead"))
        words = cut_lineage(words.join(rank, "search_term"))
        terms = words.where("k > 1").groupBy("search_term", "k", "lead").agg(F.max("cross").alias("crosses"))
        # a repeated document has each place as often as it occurs
        inside = words.join(terms.where(f"crosses OR k > {MASK_WORDS}"), "search_term", "left_anti").where("k > 1")
        across = words.join(terms.where(f"crosses OR k > {MASK_WORDS}"), "search_term", "left_semi")
        # within a fragment all places have one frag: a bit for each place
        full = self.occurrences(inside.drop("lead")).groupBy("search_term", "doc", "start", "frag", "k").agg(
            F.bit_or(F.expr("shiftleft(1L, i)")).alias("places")).where("places = shiftleft(1L, k) - 1").select(
            "search_term", "doc", F.col("frag").alias("frag_idx"), F.col("frag").alias("last_frag"))
        held = self.occurrences(across.drop("lead")).groupBy("search_term", "doc", "start").agg(
            F.collect_set(F.struct("i", "frag", "cross")).alias("s"))
        whole = held.join(terms.select("search_term", "k", "lead"), "search_term").where("size(s) >= k").select(
            "search_term", "doc", "k", F.explode(F.expr("filter(s, x -> x.i = lead)")).alias("p"),
            F.expr("filter(s, x -> x.i <> lead)").alias("qs")).where("size(qs) = k - 1").select(
            "search_term", "doc", "k", F.array_sort(F.concat(F.array("p"), "qs")).alias("s"))
        whole = whole.where("forall(sequence(1, k - 1), x -> s[x].cross OR s[x].frag = s[x - 1].frag)").select(
            "search_term", "doc", F.col("s")[0]["frag"].alias("frag_idx"), F.element_at("s", -1)["frag"].alias("last_frag"))
        single = self.occurrences(words.where("k = 1").drop("lead")).select(
            "search_term", "doc", F.col("frag").alias("frag_idx"), F.col("frag").alias("last_frag"))
        return whole.unionByName(full).unionByName(single).groupBy("search_term", "doc", "frag_idx").agg(F.max("last_frag").alias("last_frag"))

    def snippets(self, terms: Iterable[str] | DataFrame, fragment_limit: int | None = DEFAULT_FRAGMENT_LIMIT,
                 doc_col: str = "doc_id") -> DataFrame:
        """Snippet rows as of :func:`termlens.operators.snippets.extract_snippets`: search_term, ``doc_col``, frag_idx,
        carried columns, highlight (whole fragments, with what stands between them if there are several)."""
        found = self.matches(terms)
        if fragment_limit is not None:
            nth = F.row_number().over(Window.partitionBy("search_term", "doc").orderBy("frag_idx"))
            found = found.withColumn("_nth", nth).where(F.col("_nth") <= int(fragment_limit)).drop("_nth")
        found = cut_lineage(found)
        frags = self._table("fragments")
        carry = [c for c in frags.columns if c not in ("doc", "frag", "highlight", "tail", "bucket")]
        frags = frags.where(F.col("bucket").isin(
            [r[0] for r in found.select(_bucket("doc", self.buckets)).distinct().collect()])).drop("bucket")
        docs = [r.doc for r in found.select("doc").distinct().limit(MAX_PUSHED_DOCS + 1).collect()]
        if len(docs) <= MAX_PUSHED_DOCS and None not in docs:
            frags = frags.where(F.col("doc").isin(docs))
        asked = found.select("search_term", "doc", "frag_idx", "last_frag", F.explode(F.sequence("frag_idx", "last_frag")).alias("frag"))
        both = asked.join(frags, asked["doc"].eqNullSafe(frags["doc"]) & (asked["frag"] == frags["frag"])).select(
            "search_term", asked["doc"].alias(doc_col), "frag_idx", "last_frag", asked["frag"], *carry, "highlight", "tail")
        one = both.where("frag_idx = last_frag").drop("last_frag", "frag", "tail")
        said = F.struct("frag", F.when(F.col("frag") < F.col("last_frag"), F.concat("highlight", "tail")).otherwise(F.col("highlight")).alias("x"))
        many = both.where("frag_idx < last_frag").groupBy("search_term", doc_col, "frag_idx", *carry).agg(
            F.array_join(F.array_sort(F.collect_set(said))["x"], "").alias("highlight"))
        return one.unionByName(many.select(*one.columns))
