"""Result tables with idempotent upserts, incremental runs and term removal.

Four tables: ``term_counts`` (word), ``term_cooccurrence`` (word_1, word_2),
``processed_terms`` (term), ``similarity_results`` (doc_id, similar_doc_id); and
the additive state of incremental runs (see :mod:`termlens.streaming.incremental`).
The merge logic is one union and one aggregation per key, in which incoming
rows win, and is what a MERGE statement would do.  :class:`TableStore` keeps the
tables as Parquet files in key buckets: a merge rewrites the buckets that hold an
incoming key, and one manifest names what is current of all tables, so a change
of several tables is one commit and a failed one leaves everything as it was
(every operation here is idempotent and can be repeated).
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.session import cut_lineage

KEYS = {
    "term_counts": ("word",),
    "term_cooccurrence": ("word_1", "word_2"),
    "processed_terms": ("term",),
    "similarity_results": ("doc_id", "similar_doc_id"),
    "corpus_stats": ("search_term",),
    "state_words": ("search_term", "word"),
    "state_documents": ("search_term", "doc_id"),
    "state_publishers": ("search_term", "publisher"),
}


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` replace rows of ``existing`` with the same key;
    other rows of both are kept.  Rows of one side that repeat a key keep one
    row (the largest by all columns, so the choice does not depend on order).
    One aggregation over both sides: each is computed once and shuffled once."""
    return _merged(existing, incoming, keys, 1)


def _merged(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], incoming_rank: int) -> DataFrame:
    """One row per key, from the side of the higher rank (``existing`` has 0)."""
    keys, cols = list(keys), existing.columns
    other = [c for c in cols if c not in keys]
    both = existing.select(*cols, F.lit(0).alias("_rank")).unionByName(
        incoming.select(*cols, F.lit(incoming_rank).alias("_rank")))
    best = both.groupBy(*keys).agg(F.max(F.struct("_rank", *other)).alias("_v"))
    return best.select(*keys, *[F.col("_v")[c].alias(c) for c in other])


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger insert: rows with a new key are added, existing rows untouched."""
    return _merged(existing, incoming, keys, -1)


def pending(candidates: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Candidates whose key is not in ``done`` (skip finished work)."""
    done_key = done_key or key
    return candidates.join(done.select(F.col(done_key).alias(key)).distinct(), key, "left_anti")


def clean_stats(stats: DataFrame) -> DataFrame:
    """Drop co-occurrence rows whose word_2 is null, empty or all spaces."""
    return stats.where(F.col("word_2").isNotNull() & (F.trim("word_2") != ""))


def remove_term(ledger: DataFrame, cooccurrence: DataFrame, counts: DataFrame, term: str
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without ``term`` (trimmed, lower-cased): ledger rows
    with it, co-occurrence rows with it as word_1 or word_2, its count row."""
    gone = removal(term)
    return (ledger.where(~gone["processed_terms"]), cooccurrence.where(~gone["term_cooccurrence"]),
            counts.where(~gone["term_counts"]))


def removal(term: str) -> dict[str, Column]:
    """Per table, the condition on its rows that go with ``term`` (trimmed, lower-cased)."""
    t = term.strip().lower()

    def hit(c: str) -> Column:
        return F.col(c).eqNullSafe(F.lit(t))

    return {"processed_terms": hit("term"), "term_cooccurrence": hit("word_1") | hit("word_2"), "term_counts": hit("word")}


class CommitConflict(RuntimeError):
    """Another writer has committed since this change began."""


class TableStore:
    """The result tables under one root (a path on the cluster's file system).

    A table is a set of hash buckets of its key, each a folder of Parquet files
    that is never changed.  ``manifests/<n>.json`` names the folders of all
    tables; the highest ``n`` is current.  A change writes folders for the
    buckets it touches, then one new manifest by an atomic rename that fails if
    that number exists.  So several tables change together or not at all, a
    change that breaks off leaves everything as it was, and of two writers that
    began with the same manifest the second is refused."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(os.path.join(self.root, folder))
        return [st.getPath().getName() for st in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self._names("manifests") if re.fullmatch(r"\d+\.json", n)), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{table: {"schema", "buckets", "parts": {bucket: folder}}} of a version (default: the current one)."""
        version = self.version() if version is None else version
        if not version:
            return {}
        name = os.path.join(self.root, "manifests", f"{version:09d}.json")
        return json.loads("".join(r.value for r in self.spark.read.text(name, wholetext=True).collect()))

    def _publish(self, version: int, tables: dict) -> None:
        fs, path = self._fs()
        final, draft = (path(os.path.join(self.root, "manifests", n)) for n in (f"{version:09d}.json", f".{uuid.uuid4().hex}"))
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), gateway.new_array(option, 0))   # never over an existing file
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise CommitConflict(f"version {version} is there already: read again and repeat the change") from e
            raise

    def _frame(self, entry: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        at = [os.path.join(self.root, p) for b, p in sorted(entry["parts"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def exists(self, name: str) -> bool:
        return name in self.manifest()

    def notes(self) -> dict:
        """Small facts that were committed together with the tables."""
        return self.manifest().get("_notes", {})

    def read(self, name: str) -> DataFrame:
        tables = self.manifest()
        if name not in tables:
            raise FileNotFoundError(name)
        return self._frame(tables[name])

    @contextlib.contextmanager
    def change(self) -> Iterator[Change]:
        """Several changes as one: ``with store.change() as c: c.merge(..); c.remove_term(..)``."""
        c = Change(self)
        yield c
        self._publish(c.base + 1, c.tables)

    def write(self, name: str, df: DataFrame) -> None:
        with self.change() as c:
            c.write(name, df)

    def merge(self, name: str, incoming: DataFrame) -> None:
        with self.change() as c:
            c.merge(name, incoming)

    def replace_groups(self, name: str, incoming: DataFrame, column: str, values: list[str]) -> None:
        with self.change() as c:
            c.replace_groups(name, incoming, column, values)

    def add_terms(self, terms: Iterable[str]) -> None:
        with self.change() as c:
            c.add_terms(terms)

    def remove_term(self, term: str) -> None:
        with self.change() as c:
            c.remove_term(term)


class Change:
    """Tables as they are to be after one commit; reads see the changes made so far."""

    def __init__(self, store: TableStore):
        self.store, self.base = store, store.version()
        self.tables = store.manifest(self.base)

    def exists(self, name: str) -> bool:
        return name in self.tables

    def read(self, name: str) -> DataFrame:
        return self.store._frame(self.tables[name])

    def _bucket(self, name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(n)).cast("int")

    def _touched(self, name: str, *frames: DataFrame) -> set[int]:
        """Buckets that hold a row of the frames (at most all of the table's)."""
        n = self.tables[name]["buckets"]
        return {r[0] for f in frames for r in f.select(self._bucket(name, n)).distinct().collect()}

    def _put(self, name: str, df: DataFrame, buckets: set[int] | None) -> None:
        """``df`` becomes the content of ``buckets`` (None: of the whole table)."""
        if buckets is not None and not buckets:
            return
        entry = self.tables.get(name)
        if buckets is None:
            entry = {"schema": df.schema.jsonValue(), "buckets": self.store.buckets, "parts": {}}
        folder, column = f"data/{name}/{uuid.uuid4().hex}", "__bucket"
        # a task a bucket; one that is large is split by size
        df.withColumn(column, self._bucket(name, entry["buckets"])).hint("rebalance", column).write.partitionBy(column).parquet(
            os.path.join(self.store.root, folder))
        new = {n.partition("=")[2]: f"{folder}/{n}" for n in self.store._names(folder) if n.startswith(f"{column}=")}
        old = {b: p for b, p in entry["parts"].items() if buckets is not None and int(b) not in buckets}
        self.tables[name] = {**entry, "parts": old | new}

    def write(self, name: str, df: DataFrame) -> None:
        """``df`` becomes the table."""
        self._put(name, df, None)

    def merge(self, name: str, incoming: DataFrame) -> None:
        """Upsert; only buckets that hold an incoming key are read and written."""
        if not self.exists(name):
            self._put(name, upsert(incoming.limit(0), incoming, KEYS[name]), None)
            return
        incoming = cut_lineage(incoming)
        hit = self._touched(name, incoming)
        self._put(name, upsert(self.store._frame(self.tables[name], hit), incoming, KEYS[name]), hit)

    def add(self, name: str, delta: DataFrame, value: str) -> None:
        """Add ``value`` of ``delta`` to the stored one, key by key; only buckets that hold a key of it are read and written."""
        keys = list(KEYS[name])
        delta = cut_lineage(delta.select(*keys, value).groupBy(*keys).agg(F.sum(value).alias(value)))
        if not self.exists(name):
            self._put(name, delta, None)
            return
        hit = self._touched(name, delta)
        both = self.store._frame(self.tables[name], hit).select(*keys, value).unionByName(delta)
        self._put(name, both.groupBy(*keys).agg(F.sum(value).alias(value)), hit)

    def note(self, **facts) -> None:
        self.tables["_notes"] = {**self.tables.get("_notes", {}), **facts}

    def replace_groups(self, name: str, incoming: DataFrame, column: str, values: list[str]) -> None:
        """Replace every row whose ``column`` is in ``values`` by ``incoming``
        (a term's statistics recomputed from scratch)."""
        if not self.exists(name):
            self._put(name, incoming, None)
            return
        incoming = cut_lineage(incoming)
        hit = self._touched(name, incoming, self.read(name).where(F.col(column).isin(values)))
        kept = self.store._frame(self.tables[name], hit).where(
            F.col(column).isNull() | ~F.col(column).isin(values))
        self._put(name, kept.unionByName(incoming.select(*kept.columns)), hit)

    def _remove(self, name: str, gone: Column) -> None:
        hit = self._touched(name, self.read(name).where(gone))
        self._put(name, self.store._frame(self.tables[name], hit).where(~gone), hit)

    def add_terms(self, terms: Iterable[str]) -> None:
        """Ledger insert-if-absent."""
        name = "processed_terms"
        inc = self.store.spark.createDataFrame([(t.strip().lower(),) for t in terms], "term string").distinct()
        if not self.exists(name):
            self._put(name, inc, None)
            return
        hit = self._touched(name, inc)
        self._put(name, insert_if_absent(self.store._frame(self.tables[name], hit), inc, ["term"]), hit)

    def remove_term(self, term: str) -> None:
        """Remove a term from the ledger, the co-occurrence table and the counts."""
        for name, gone in removal(term).items():
            if self.exists(name):
                self._remove(name, gone)
