"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation once per turn, each time with all turns so
far.  Rolling hashes of every conversation's turn prefixes tell which logged
conversations are prefixes of longer ones: conversations with equal content
become one (the least id names it), an anti-join against all proper prefixes
leaves the maximal ones, and only these are rendered.

The rolling hash at a turn is the sum, over the turns up to it, of two 62-bit
hashes of (place, role, text).  Places come from one sort over all partitions
(a turn's place in its partition, plus its conversation's turns in the partitions
before), whatever the turn numbers are.  Sums are built in segments of ``SEGMENT``
places and the segments' totals on top, so a conversation that holds a third of
all rows is spread over many tasks, and it is rendered in as many parts.

Defined results: turns are ordered by turn (nulls first), role and text's MD5;
repeated rows are turns of their own; marks of the rendered form in a role or text
are split, so that they can't end a turn; null role counts as ``user`` and null
text as empty; rows without a conversation id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import cut_lineage

SEGMENT = 256                     # turns
# The marks of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"
BITS = (1 << 62) - 1


def _placed(rows: DataFrame) -> DataFrame:
    """Written rows with ``place`` in their conversation, from 0, and ``seg``, the segment of that place."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "t"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(
        "pos", F.monotonically_increasing_id())).withColumn("piece", F.shiftright("pos", 33))
    # a conversation has few pieces: one for each partition that it reaches into
    pieces = rows.groupBy("conv", "piece").agg(F.min("pos").alias("start"), F.count("*").alias("n")).selectExpr(
        "conv AS oc", "piece AS op", "sum(n) OVER (PARTITION BY conv ORDER BY piece) - n - start AS shift")
    return rows.join(pieces, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("piece") == F.col("op"))).withColumn(
        "place", F.col("pos") + F.col("shift")).withColumn("seg", F.expr(f"place div {SEGMENT}")).drop("pos", "piece", "oc", "op", "shift")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Per turn (``conv``, ``seg``, ``place``): the rolling hash (``p1``, ``p2``) of the prefix that it ends."""
    a = turns.withColumns({"h1": F.expr(f"cast(xxhash64(place, role, t) & {BITS}L AS decimal(20, 0))"),
                           "h2": F.expr(f"cast(xxhash64(t, role, place, 1) & {BITS}L AS decimal(20, 0))")})
    inner = "OVER (PARTITION BY conv, seg ORDER BY place)"
    a = a.select("conv", "seg", "place", F.expr(f"sum(h1) {inner}").alias("s1"), F.expr(f"sum(h2) {inner}").alias("s2"))
    outer = "OVER (PARTITION BY conv ORDER BY seg)"
    totals = a.groupBy("conv", "seg").agg(F.max(F.struct("place", "s1", "s2")).alias("x")).selectExpr(
        "conv AS oc", "seg AS os", f"sum(x.s1) {outer} - x.s1 AS b1", f"sum(x.s2) {outer} - x.s2 AS b2")
    modulus = f"cast({BITS + 1} AS decimal(20, 0))"
    return a.join(totals, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("seg") == F.col("os"))).selectExpr(
        "conv", "seg", "place", f"cast((s1 + b1) % {modulus} AS bigint) AS p1", f"cast((s2 + b2) % {modulus} AS bigint) AS p2")


def maximal(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept conversations: ``conv``, ``n_turns``, ``n_copies``; all turns with
    their ``place``: ``conv``, ``seg``, ``place``, ``role``, ``t`` the text's MD5, ``turn``)."""
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                                F.coalesce(F.col(role), F.lit("user")).alias("role"),
                                F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("t"))
    turns = cut_lineage(_placed(rows))
    prefixes = cut_lineage(prefix_hashes(turns).select("conv", "place", "p1", "p2"))
    last = prefixes.groupBy("conv").agg(F.max(F.struct("place", "p1", "p2")).alias("x")).selectExpr(
        "conv", "x.place AS place", "x.p1 AS p1", "x.p2 AS p2")
    whole = last.groupBy("place", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    proper = prefixes.join(last.selectExpr("conv AS lc", "place AS lp"), F.col("conv").eqNullSafe(F.col("lc"))).where(
        "place < lp").select("place", "p1", "p2").distinct()
    kept = whole.join(proper, ["place", "p1", "p2"], "left_anti").selectExpr("conv", "place + 1 AS n_turns", "n_copies")
    return cut_lineage(kept), turns


def _safe(x: str) -> str:
    """A text's own marks are split, so that they can't end a turn."""
    return f"replace(replace({x}, '{START}', '<| im_start|>'), '{END}', '<| im_end|>')"


def render(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Maximal conversations as text: ``conv_id``, ``part`` (from 0, of at most
    ``SEGMENT`` turns), ``n_parts``, ``n_turns``, ``n_copies``, ``rendered``.
    A conversation's parts in order are its whole rendering."""
    kept, turns = maximal(conversations, conv, turn, role, text)
    kept = kept.selectExpr("conv AS kc", "n_turns", "n_copies", f"(n_turns + {SEGMENT - 1}) div {SEGMENT} AS n_parts")
    # the texts of kept conversations only, numbered as above
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                                F.coalesce(F.col(role), F.lit("user")).alias("role"),
                                F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "t", F.md5(F.col("text").cast("binary")))
    texts = rows.join(kept, F.col("conv").eqNullSafe(F.col("kc")), "left_semi")
    numbered = _placed(texts)
    part = numbered.withColumn("part", F.expr(f"place div {SEGMENT}")).withColumn("line", F.expr(
        f"concat('{START}', {_safe('role')}, '\\n', {_safe('text')}, '{END}\\n')"))
    parts = part.groupBy("conv", "part").agg(F.expr(
        "array_join(transform(sort_array(collect_list(struct(place, line))), x -> x.line), '')").alias("rendered"))
    return parts.join(kept, F.col("conv").eqNullSafe(F.col("kc"))).selectExpr(
        "conv AS conv_id", "part", "n_parts", "n_turns", "n_copies", "rendered")
