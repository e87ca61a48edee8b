"""Packing: concatenate the documents' ids and cut the stream into fixed windows.

Pass one encodes every document once and writes its ids with their place in
the stream of their own partition.  The partitions' totals (one row each) are
summed up into the partitions' places in the whole stream.  Pass two gives
every document its global place and cuts it at the window borders; a document
across a border leaves a boundary record in each window.  Only the last window
can be short.  No document is gathered with another; nothing is shuffled but
the totals.

Defined results: null text counts as empty, and an empty document is its end
id alone; repeated rows are packed each; an empty table has no piece.  Columns
of the input other than ``keep`` are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.bpe import CACHE_PIECES, encoder
from termlens.llm.common import cut_lineage, release_memory

LENGTH = 4096
END_ID = 2
RELEASED_PIECES = 200_000    # bound of a generation of the cache that is released
MAX_PARTITIONS = 1_000_000   # of one input; their totals are collected, 16 bytes each


def encode_stream(docs: DataFrame, path: str, text: str = "text", end_id: int = END_ID,
                  keep: tuple[str, ...] = ("doc_id",), release: bool = False) -> DataFrame:
    """Written table: ``keep``, ``ids`` with the end id, ``n_ids``, the
    partition and the place ``at`` in its stream.  ``release`` keeps a
    smaller cache of pieces in the worker and, after each partition, empties it
    and gives the memory back to the system, for jobs whose other stages need
    the memory of the same workers."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema
    for name, kind in (("ids", "binary"), ("n_ids", "long"), ("part", "integer"), ("at", "long")):
        schema = schema.add(name, kind)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, at = encoder(path, RELEASED_PIECES if release else CACHE_PIECES), TaskContext.get().partitionId(), 0
        for b in batches:
            out = b.drop(columns="__text")
            out["ids"] = [enc.encode(t or "") + end for t in b["__text"]]
            n = out["ids"].map(len).astype("int64") // 4
            out["n_ids"], out["part"], out["at"] = n, part, at + n.cumsum() - n
            at += int(n.sum())
            yield out
        if release:
            b = out = n = None
            enc.forget()
            release_memory()

    return cut_lineage(rows.mapInPandas(run, schema))


def pack(stream: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of the encoded stream: the document's columns, ``sequence_id``,
    ``offset`` (place in the sequence), ``start`` (place in the document),
    ``length``, ``doc_tokens``, ``ids`` (binary), ``first`` and ``last``."""
    totals = stream.groupBy("part").agg(F.max(F.expr("at + n_ids")).alias("total")).orderBy("part").limit(
        MAX_PARTITIONS + 1).collect()
    if len(totals) > MAX_PARTITIONS:
        raise ValueError(f"more than {MAX_PARTITIONS} input partitions: coalesce the input first")
    places, place = [], 0
    for r in totals:
        places.append((r["part"], place))
        place += r["total"]
    bases = stream.sparkSession.createDataFrame(places, "part int, base long")
    keep = [c for c in stream.columns if c not in ("ids", "n_ids", "part", "at")]
    cut = f"""inline(transform(sequence((base + at) div {length}, (base + at + n_ids - 1) div {length}), w ->
        named_struct('sequence_id', w,
                     'offset', greatest(w * {length}, base + at) - w * {length},
                     'start', greatest(w * {length}, base + at) - base - at,
                     'length', least((w + 1) * {length}, base + at + n_ids) - greatest(w * {length}, base + at),
                     'ids', substring(ids, cast(4 * (greatest(w * {length}, base + at) - base - at) + 1 as int),
                        cast(4 * (least((w + 1) * {length}, base + at + n_ids) - greatest(w * {length}, base + at)) as int)))))"""
    return (stream.join(F.broadcast(bases), "part")
            .selectExpr(*[f"`{c}`" for c in keep], "n_ids AS doc_tokens", cut)
            .selectExpr(*[f"`{c}`" for c in keep], "sequence_id", "offset", "start", "length", "doc_tokens", "ids",
                        "start = 0 AS first", "start + length = doc_tokens AS last"))
