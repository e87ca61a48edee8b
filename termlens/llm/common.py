"""Helpers shared by the operators: Arrow block iteration over whole texts,
vectorised code-point n-grams and word hashes, hash splits, scratch tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.session import cut_lineage, scratch_table_path  # noqa: F401  (re-exported)

# Characters of one n-gram pass; a longer text is counted in several passes.
SEGMENT_CHARS = 1 << 20
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 27     # of a broadcast filter: bits a key, bits in all (16 MB)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64 constants


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def split_remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def least_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of least hash of ``key`` (all rows if there are fewer); null keys are left out.
    A threshold that keeps about twice as many comes first, so the tasks needn't send ``n`` rows each."""
    df = df.where(F.col(key).isNotNull())
    h = F.xxhash64(F.lit("draw"), F.col(key))
    total = df.count()
    if total > 4 * n:
        some = df.where(h <= F.lit(int(2.0 * n / total * 2.0 ** 64) - (1 << 63)))
        df = some if some.count() >= n else df
    return df.orderBy(h, key).limit(n)


def likely(df: DataFrame, keys: list[Column | str], wanted: DataFrame, wanted_keys: list[Column | str]) -> DataFrame:
    """The rows of ``df`` whose keys ``wanted`` has, and a few others, so that an exact join that follows moves only
    these: a bit map of the hashes of ``wanted``'s keys is broadcast, ``FILTER_BITS`` bits a row and at most
    ``MAX_FILTER_BITS`` in all.  The keys' types must be the same; nulls count as equal."""
    b, m = free_name(df, "bucket"), free_name(df, "bits")
    bits = min(MAX_FILTER_BITS, FILTER_BITS * max(wanted.count(), 1))

    def place(cols: list[Column | str]) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(bits)) + 1

    maps = wanted.select(place(wanted_keys).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(b)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(m))
    at = F.bitmap_bit_position(place(keys))
    byte = F.conv(F.hex(F.substring(m, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(maps), (F.bitmap_bucket_number(place(keys)) == F.col(b))
                   & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")


def release_memory() -> None:
    """Give what this process has freed back to the system: else a Python worker stays as large as its largest task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in have:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def blocks(texts: list, max_docs: int, max_chars: int = SEGMENT_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of blocks of at most ``max_docs`` texts and about
    ``max_chars`` characters; a longer text is a block of its own.  Null: ''."""
    start, block, chars = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if block and (len(block) >= max_docs or chars + len(t) > max_chars):
            yield start, block
            start, block, chars = i, [], 0
        block.append(t)
        chars += len(t)
    if block:
        yield start, block


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Per code point: the lower-case letter, or a space for any other."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


@functools.lru_cache(maxsize=1)
def shape_table() -> np.ndarray:
    """Per code point: its shape class; marks and symbols stay themselves."""
    out = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            out[cp] = ord("A") if kind in ("Lu", "Lt") else ord("a")
        elif kind[0] == "N":
            out[cp] = ord("0")
        elif kind[0] == "Z" or cp in (9, 11, 12, 13):
            out[cp] = 32
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_counts(texts: list[str], groups: Iterable[tuple[np.ndarray, tuple[int, ...], int]],
                 spare: int = 0) -> np.ndarray:
    """Counts of hashed code-point n-grams, one float32 row per text.

    ``groups`` are (code table, orders, bits): the n-grams of a group over the
    mapped code points fall into its own ``2 ** bits`` columns; ``spare`` zero
    columns follow.  Whole texts; memory is bounded by the result and one
    segment of characters.  White space is no 1-gram."""
    groups = [(t, sorted(set(o)), bits) for t, o, bits in groups]
    width = sum(1 << bits for _, _, bits in groups) + spare
    top = max(o[-1] for _, o, _ in groups)
    # a text's last n-grams reach into its own white space; those that start there fall into a spare row
    sizes = np.array([s for t in texts for s in (len(t) + 1, top - 1)], np.int64)
    rows = np.array([r for i in range(len(texts)) for r in (i, len(texts))], np.int64)
    cps = code_points("".join(t + " " * top for t in texts))
    row = np.repeat(rows * width, sizes)
    last, out = len(cps) - top + 1, None
    for lo in range(0, max(last, 1), SEGMENT_CHARS):
        hi, found, base = min(last, lo + SEGMENT_CHARS), [], 0
        for codes_of, orders, bits in groups:
            a = codes_of[cps[lo:hi + top - 1]]
            at = row[lo:hi] + base
            h = np.full(hi - lo, 2166136261, np.uint32)
            for n in range(1, orders[-1] + 1):
                h = h * np.uint32(16777619) + a[n - 1:n - 1 + hi - lo]
                if n in orders:
                    bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(2654435769)) >> np.uint32(32 - bits)
                    found.append((at + bucket)[a[:hi - lo] != 32] if n == 1 else at + bucket)
            base += 1 << bits
        got = np.bincount(np.concatenate(found), minlength=(len(texts) + 1) * width)
        out = got if out is None else out + got
    return out[:len(texts) * width].reshape(len(texts), width).astype(np.float32)


def word_hashes(texts: list[str], codes_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of every white-space separated word, in order."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    a = code_points("".join(t + " " for t in texts))
    a = codes_of[a] if codes_of is not None else a
    space = (a == 32) | ((a >= 9) & (a <= 13))
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.flatnonzero(space & np.concatenate(([False], inside[:-1])))
    sizes_w = ends - starts
    before = np.concatenate(([0], starts))  # white space before the first word counts from 0
    pos = np.arange(len(a)) - np.repeat(before, np.diff(np.concatenate((before, [len(a)]))))
    v = a + (pos.astype(np.uint64) << np.uint64(24)) + np.uint64(1)
    v *= MIX1
    v ^= v >> np.uint64(29)
    v *= MIX2
    v[space] = 0
    h = mix64(np.add.reduceat(v, starts) + sizes_w.astype(np.uint64))
    bounds = np.cumsum(sizes)
    return np.searchsorted(bounds, starts, side="right").astype(np.int64), h
