"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Every paragraph (line) is hashed to a wide vector; a text's fingerprint is the
sum of its paragraphs' vectors, lane by lane, modulo powers of two.  So equal
multisets of paragraphs have equal fingerprints in whatever order, and a
paragraph is inserted or deleted by adding or subtracting its vector
(:func:`combine`).  The vector has

* ``EQUAL_LANES`` lanes hashed from the paragraph's SHA-256, which tell
  different multisets apart, and
* ``LIKE_LANES`` lanes that count one hash bit of each of its clauses (two
  30-bit lanes to a number, more than a text can have clauses), and the number of clauses: their centred values
  are random projections of the multiset of clauses, whose cosine estimates
  how alike two texts are (:func:`likeness`).

All of it is column expressions.  Defined results: null text counts as empty;
the empty text is one empty paragraph; likeness is 1 for equal fingerprints
and 0 if only one of two texts has a clause.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import free_name

EQUAL_LANES = 8
LIKE_BITS, PACKED = 30, 2                  # width of a likeness lane, lanes to a number
SEEDS, SHIFTS = 4, LIKE_BITS               # LIKE_LANES = SEEDS * SHIFTS * PACKED
MODULUS = (1 << 60) - 1                    # lanes are summed modulo 2 ** 60
BIT_MASK = sum(1 << LIKE_BITS * i for i in range(PACKED))
CLAUSE_END = "[.,;:!?\\n]+"
LANES = EQUAL_LANES + SEEDS * SHIFTS + 1
ROWS_PER_RANGE = 500
MAX_RANGES = 1 << 16                       # bound of the range table that is broadcast


def fingerprint_sql(text: str) -> str:
    """SQL of the lane array of a text expression (each array is made once)."""
    add = f"(s + ({{}})) & {MODULUS}L"
    equal = (f"transform(sequence(0, {EQUAL_LANES - 1}), k -> aggregate(ps, 0L, (s, p) -> "
             + add.format(f"xxhash64(k, p) & {MODULUS}L") + "))")
    like = ", ".join(
        f"transform(array(transform(cs, c -> xxhash64({seed}, c))), hs -> transform(sequence(0, {SHIFTS - 1}), k -> "
        f"aggregate(hs, 0L, (s, h) -> {add.format(f'shiftright(h, k) & {BIT_MASK}L')})))[0]" for seed in range(SEEDS))
    return (f"transform(array(struct(transform(split({text}, '\\n', -1), p -> sha2(p, 256)) AS ps,"
            f" filter(split({text}, '{CLAUSE_END}', -1), c -> trim(c) <> '') AS cs)), v ->"
            f" concat({equal.replace('(ps,', '(v.ps,')}, {like.replace('(cs,', '(v.cs,')},"
            f" array(cast(size(v.cs) AS bigint))))[0]")


def combine_sql(a: str, b: str, sign: str = "+") -> str:
    """Lanes of two texts' paragraphs together (``+``), or without the second's (``-``)."""
    return f"zip_with({a}, {b}, (x, y) -> (x {sign} y) & {MODULUS}L)"


def text_sql(lanes: str) -> str:
    """Fixed-width lowercase hex of the lanes."""
    return f"lower(array_join(transform({lanes}, x -> lpad(hex(x), 15, '0')), ''))"


def likeness_sql(a: str, b: str) -> str:
    """Cosine of the centred clause lanes, 0 to 1."""
    n = SEEDS * SHIFTS * PACKED

    def lane(v):
        return (f"2 * (shiftright({v}[{EQUAL_LANES} + k div {PACKED}], {LIKE_BITS} * cast(k % {PACKED} AS int))"
                f" & {(1 << LIKE_BITS) - 1}L) - {v}[{LANES - 1}]")

    lanes = f"transform(sequence(0, {n - 1}), k -> struct(cast({lane(a)} AS double) AS x, cast({lane(b)} AS double) AS y))"
    sums = (f"aggregate({lanes}, struct(0D AS xy, 0D AS xx, 0D AS yy), (s, l) -> "
            "struct(s.xy + l.x * l.y AS xy, s.xx + l.x * l.x AS xx, s.yy + l.y * l.y AS yy),"
            " s -> CASE WHEN s.xx = 0 OR s.yy = 0 THEN 0D ELSE greatest(0D, least(1D, s.xy / sqrt(s.xx * s.yy))) END)")
    return f"CASE WHEN {a} = {b} THEN 1D ELSE {sums} END"


def fingerprint(docs: DataFrame, text: str = "text", out: str = "lanes") -> DataFrame:
    """``docs`` with the fingerprint lanes (a column of that name is replaced)."""
    return docs.withColumn(out, F.expr(fingerprint_sql(f"coalesce(`{text}`, '')")))


def with_next(rows: DataFrame, order: str, columns: tuple[str, ...], out: str = "next") -> DataFrame:
    """``rows`` with the struct ``out`` of the next row's ``columns``: the order
    is descending ``order``, the last is followed by the first.  Nulls come
    last; ties are ordered by the columns' hash.

    Rows are dealt into ranges of the key, and each range's top row also goes,
    as a ghost, to the end of the range above it, so one shuffle by range
    serves all.  The ranges' borders and tops (at most ``MAX_RANGES`` rows,
    from the keys alone) are broadcast.
    """
    key, ghost, rng, tie = (free_name(rows, x) for x in ("key", "ghost", "range", "tie"))
    rows = rows.withColumn(key, F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63))))
    n = rows.count()
    want = max(1, min(MAX_RANGES, math.ceil(n / ROWS_PER_RANGE)))
    if want > 1:
        at = "array(" + ", ".join(f"{i / want!r}D" for i in range(1, want)) + ")"
        borders = sorted(set(rows.select(F.expr(f"percentile_approx(`{key}`, {at}, {max(10_000, 4 * want)})").alias("b"))
                             .first()["b"]))
        # two levels, so that a row is compared with twice the root of the number of borders
        step = max(1, math.isqrt(len(borders)))
        groups = [borders[i:i + step] for i in range(0, len(borders), step)]
        coarse = "array(" + ", ".join(f"{g[-1]}L" for g in groups[:-1]) + ")" if len(groups) > 1 else "array()"
        fine = "array(" + ", ".join("array(" + ", ".join(f"{b}L" for b in g) + ")" for g in groups) + ")"
        range_sql = (f"transform(array(size(filter({coarse}, b -> b < `{key}`))), g ->"
                     f" g * {step} + size(filter({fine}[g], b -> b < `{key}`)))[0]")
    else:
        range_sql = "0"
    rows = rows.withColumn(rng, F.expr(range_sql))
    tops = sorted((r[0], r[1]) for r in rows.groupBy(rng).agg(F.max(key)).collect())
    above = [(r, top, tops[(i + 1) % len(tops)][0]) for i, (r, top) in enumerate(tops)]
    table = rows.sparkSession.createDataFrame(above, f"`{rng}` int, top long, up int")
    dealt = rows.join(F.broadcast(table), rng).withColumn(rng, F.explode(F.expr(
        f"CASE WHEN `{key}` = top THEN array(struct(`{rng}` AS r, false AS g), struct(up AS r, true AS g))"
        f" ELSE array(struct(`{rng}` AS r, false AS g)) END"))).drop("top", "up")
    dealt = dealt.withColumn(ghost, F.col(rng)["g"]).withColumn(rng, F.col(rng)["r"]).withColumn(
        tie, F.xxhash64(*columns))
    lead = F.expr(f"lead(struct({', '.join(f'`{c}`' for c in columns)})) OVER"
                  f" (PARTITION BY `{rng}` ORDER BY `{ghost}`, `{key}` DESC, `{tie}`)")
    return dealt.withColumn(out, lead).where(~F.col(ghost)).drop(key, ghost, rng, tie)


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: its id, ``n_chars``, ``lanes`` of its text, the ``edited``
    text (its last half replaced by the first characters of the next document,
    descending id), ``edited_lanes`` and ``next_lanes``."""
    rows = fingerprint(docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text")), "text", "lanes")
    rows = with_next(rows, doc_id, ("text", "lanes"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr(
        "concat(substring(text, 1, cast(n_chars - n_chars div 2 AS int)), substring(next.text, 1, cast(n_chars div 2 AS int)))"))
    return fingerprint(rows, "edited", "edited_lanes").selectExpr(
        f"`{doc_id}`", "n_chars", "lanes", "edited", "edited_lanes", "next.lanes AS next_lanes")
