"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the code points cuts every text where its window hashes to
zero, so a passage shared by documents yields the same chunks wherever it
stands.  One pass counts the chunks of all documents; those seen again are
encoded once each, most saved characters first until the table reaches
``table_bytes``, and that table (a proven size) is broadcast.  Any other chunk
is encoded where it stands, with the same result.  The joins of neighbouring
chunks are repaired: the text around a join is encoded again and must agree
with the chunks' own ids on both sides, otherwise the two chunks are encoded
as one.  So the ids are always those of the whole text.

The vocabulary is a file of the ``tokenizers`` library, given by path; it must
exist on every executor.  Defined results: null text counts as empty, an empty
text has no ids and decodes to ''.  A text that holds one of the tokenizer's
added tokens (matched before any splitting) is encoded whole by the library.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import blocks, code_points

WINDOW = 32                           # code points of the rolling hash
CUT_BITS = 7                          # a cut every 2 ** CUT_BITS code points on average
MIN_CHUNK, MAX_CHUNK = 48, 2048
TABLE_BYTES = 16 << 20                # bound of the broadcast table: UTF-8 text of its chunks
CACHE_PIECES = 500_000                # bound of each of a worker's two generations of cached pieces
BLOCK_DOCS = 256                      # texts (and about a million characters) whose pieces are learnt together
MAX_CACHED = 48                       # longer pieces are not cached
PRIME, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
# The tokenizer always splits at white space, and between a letter and ASCII that is no letter or apostrophe.
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"[A-Za-z]+|[^A-Za-z]+")


class PieceEncoder:
    """Ids of whole texts through a cache of pieces (what stands between spaces
    and line ends) that the tokenizer always encodes on their own.  Unseen
    pieces are taken apart once more, and only unseen parts reach the library.
    The cache has two generations, so that frequent pieces outlive rare ones."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.cache_pieces = cache_pieces
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends_word[ends] = True
        self.decimal = [str(i) for i in range(len(self.ends_word))]
        # without a decoder the library joins the tokens by spaces
        self.tokens = ([self.tokenizer.id_to_token(i) or "" for i in range(len(self.ends_word))]
                       if self.tokenizer.decoder is None else None)
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        if self.tokens is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))

    def has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def encode(self, text: str) -> bytes:
        if self.has_added(text):
            return self.whole(text)
        return b"".join(self.pieces(text.replace("\n", " ").split(" ")))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each piece."""
        ids = [*map(self.new.get, pieces)]
        if None in ids:
            self._fill({p for p, i in zip(pieces, ids, strict=True) if i is None})
            ids = [i if i is not None else self.new.get(p) or self._apart([p])[0]
                   for p, i in zip(pieces, ids, strict=True)]
            if len(self.new) > self.cache_pieces:
                self.old, self.new = self.new, {"": b""}
        return ids

    def learn(self, texts: list[str]) -> None:
        """Put the pieces of all these texts into the cache, many to a library
        call, for a call costs as much as a dozen words."""
        for _, some in blocks(texts, len(texts)):
            if len(self.new) > self.cache_pieces:
                self.old, self.new = self.new, {"": b""}
            self._fill(set(" ".join(some).replace("\n", " ").split(" ")).difference(self.new))

    def _fill(self, pieces: set[str]) -> None:
        """Put the pieces into the cache."""
        new, old, word = self.new, self.old, LATIN.fullmatch
        parts, words, rest = {}, [], set()
        for p in pieces:
            if (known := old.get(p)) is not None:
                new[p] = known
            elif word(p):
                if len(p) <= MAX_CACHED:
                    words.append(p)
            elif len(p) <= MAX_CACHED:
                core = p.rstrip(".,")
                if word(core):
                    parts[p] = [core, p[len(core):]]
                else:
                    parts[p] = PARTS.findall(p) if p.isascii() and "'" not in p else [p]
        for x in {x for split in parts.values() for x in split}.difference(new, words):
            if (known := old.get(x)) is not None:
                new[x] = known
            elif word(x):
                words.append(x)
            else:
                rest.add(x)
        if words:  # one pre-token each, ended by its only id with a word end
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            raw, last = ids.tobytes(), 0
            for p, e in zip(words, ends, strict=True):
                new[p] = raw[last:e]
                last = e
        if rest:
            rest = sorted(rest)
            new.update(zip(rest, self._apart(rest), strict=True))
        for p, split in parts.items():
            new[p] = b"".join([new[x] for x in split])

    def _apart(self, pieces: list[str]) -> list[bytes]:
        """One library call for many pieces, dealt out by their offsets."""
        e = self.tokenizer.encode("\n".join(pieces), add_special_tokens=False)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        owner = np.searchsorted(ends, [o[0] for o in e.offsets], side="right")
        ids, cut = np.asarray(e.ids, "<u4"), np.searchsorted(owner, np.arange(len(pieces) + 1))
        return [ids[cut[i]:cut[i + 1]].tobytes() for i in range(len(pieces))]


@functools.lru_cache(maxsize=2)
def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One per Python worker and cache size."""
    return PieceEncoder(path, cache_pieces)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)
    return run(PRIME), run(INVERSE)


def cut_points(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text (the last is its length)."""
    n, cuts, last = len(text), [], 0
    if n > MIN_CHUNK:
        step = 1 << 18
        power, inverse = _powers(step + WINDOW)
        found = []
        for lo in range(0, n, step):  # segments overlap by one window
            a = code_points(text[lo:lo + step + WINDOW - 1]).astype(np.uint64)
            if len(a) < WINDOW:
                break
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(a * power[:len(a)], dtype=np.uint64)))
            h = (total[WINDOW:] - total[:-WINDOW]) * inverse[:len(a) - WINDOW + 1]
            h *= np.uint64(PRIME)
            found.append(np.flatnonzero((h ^ (h >> np.uint64(32))) * np.uint64(INVERSE) >> np.uint64(64 - CUT_BITS) == 0) + lo + WINDOW)
        for c in np.concatenate(found).tolist() if found else ():
            while c - last > MAX_CHUNK:
                last += MAX_CHUNK
                cuts.append(last)
            if c - last >= MIN_CHUNK and c < n:
                cuts.append(c)
                last = c
        while n - last > MAX_CHUNK:
            last += MAX_CHUNK
            cuts.append(last)
    return [*cuts, n]


def chunks_of(text: str) -> list[str]:
    ends = cut_points(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_key(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass"))


def encode_chunk(enc: PieceEncoder, chunk: str) -> tuple[bytes, int, int, int, int, int, int]:
    """Ids of a chunk on its own; the end of its second piece, the bytes of ids
    up to there and of that piece alone; the same from the start of its last
    but one piece.  A chunk of fewer than five pieces has -1 for both places."""
    pieces = chunk.replace("\n", " ").split(" ")
    ids = enc.pieces(pieces)
    if len(pieces) < 5:
        return b"".join(ids), -1, 0, 0, -1, 0, 0
    k_head, k_tail = len(ids[1]), len(ids[-2])
    return (b"".join(ids), len(pieces[0]) + 1 + len(pieces[1]), len(ids[0]) + k_head, k_head,
            len(chunk) - len(pieces[-1]) - 1 - len(pieces[-2]), len(ids[-1]) + k_tail, k_tail)


def join_piece(left: str, right: str) -> str:
    """The piece that two neighbouring chunks share (a longer one is not cached)."""
    return (left[-MAX_CACHED:].replace("\n", " ").rpartition(" ")[2]
            + right[:MAX_CACHED].replace("\n", " ").partition(" ")[0])


def encode_texts(enc: PieceEncoder, texts: list, table: dict[bytes, tuple]) -> Iterator[bytes]:
    """Ids of each whole text; the pieces of a block's chunks outside the
    table, and of all joins, are learnt together."""
    for _, block in blocks(texts, BLOCK_DOCS):
        cut = [None if enc.has_added(t) else chunks_of(t) for t in block]
        known = [[table.get(chunk_key(c)) for c in cs] if table and cs else [None] * len(cs or ()) for cs in cut]
        enc.learn([c for cs, ks in zip(cut, known, strict=True) if cs for c, k in zip(cs, ks, strict=True) if k is None]
                  + [join_piece(*pair) for cs in cut if cs for pair in itertools.pairwise(cs)])
        for t, cs, ks in zip(block, cut, known, strict=True):
            yield enc.whole(t) if cs is None else join_chunks(enc, cs, ks)


def encode_by_chunks(enc: PieceEncoder, text: str, table: dict[bytes, tuple]) -> bytes:
    """Ids of one whole text from its chunks."""
    return next(encode_texts(enc, [text], table))


def join_chunks(enc: PieceEncoder, chunks: list[str], known: list[tuple | None]) -> bytes:
    """Ids of the chunks' whole text, each join repaired by re-encoding;
    ``known`` holds what the table has of each chunk."""
    out: list[bytes] = []
    left, left_text, waiting = None, "", []   # waiting: texts to be encoded as one with what follows
    for chunk, right in zip(chunks, known, strict=True):
        right = right or encode_chunk(enc, chunk)
        if waiting:
            waiting.append(chunk)
            if right[1] >= 0:
                left_text, waiting = "".join(waiting), []
                left = encode_chunk(enc, left_text)
            continue
        if left is None:
            left, left_text = right, chunk
        elif left_text[-1:] in " \n" or chunk[:1] in " \n":  # the tokenizer itself splits here
            out.append(left[0])
            left, left_text = right, chunk
        else:
            ids, head, n_head, k_head, _, _, _ = right
            _, _, _, _, tail, n_tail, k_tail = left
            if head >= 0 and tail >= 0:
                kept, end = left[0][:len(left[0]) - n_tail], left[0][len(left[0]) - n_tail:]
                joined = b"".join(enc.pieces((left_text[tail:] + chunk[:head]).replace("\n", " ").split(" ")))
                if joined[:k_tail] == end[:k_tail] and joined[len(joined) - k_head:] == ids[n_head - k_head:n_head]:
                    out += [kept, joined]
                    left, left_text = (ids[n_head:], -1, 0, 0, right[4] - head, right[5], right[6]), chunk[head:]
                    continue
            waiting = [left_text, chunk]      # no agreement: encode both as one
            left = None
            if head >= 0:
                left_text, waiting = "".join(waiting), []
                left = encode_chunk(enc, left_text)
    if waiting:
        out.append(enc.encode("".join(waiting)))
    return b"".join(out) + (left[0] if left else b"")


def reuse_table(docs: DataFrame, path: str, text: str = "text", table_bytes: int = TABLE_BYTES) -> dict[bytes, tuple]:
    """The chunks that all documents share most, each encoded once."""
    texts = docs.select(F.col(text).alias("text")).where("text IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[bytes, list[int]] = {}
            for t in b["text"]:
                for c in chunks_of(t):
                    raw = c.encode("utf-8", "surrogatepass")
                    seen.setdefault(xxhash.xxh3_128_digest(raw), [0, len(raw)])[0] += 1
            if seen:
                yield pd.DataFrame({"key": list(seen), "n": [v[0] for v in seen.values()],
                                    "size": [v[1] for v in seen.values()]})

    shared = (texts.mapInPandas(count, "key binary, n long, size int").groupBy("key")
              .agg(F.sum("n").alias("n"), F.max("size").alias("size")).where("n > 1"))
    # at least 32 bytes a chunk, so this many rows hold any table of that size
    best = shared.orderBy(F.desc(F.expr("(n - 1) * size")), "key").limit(table_bytes // 32 // 4).toPandas()
    best = best[best["size"].cumsum() <= table_bytes]
    wanted = frozenset(bytes(k) for k in best["key"])
    names = ["key", "ids", "head", "n_head", "k_head", "tail", "n_tail", "k_tail"]
    if not wanted:
        return {}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[bytes] = set()
        for b in batches:
            new = {}
            for t in b["text"]:
                for c in chunks_of(t):
                    k = chunk_key(c)
                    if k in wanted and k not in met:
                        met.add(k)
                        new[k] = c
            if new:
                yield pd.DataFrame({"key": list(new), "chunk": list(new.values())})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            enc.learn(b["chunk"].tolist())
            rows = [encode_chunk(enc, c) for c in b["chunk"]]
            yield pd.DataFrame([(k, *r) for k, r in zip(b["key"], rows, strict=True)], columns=names)

    once = texts.mapInPandas(find, "key binary, chunk string").groupBy("key").agg(F.min("chunk").alias("chunk"))
    rows = once.mapInPandas(encode, "key binary, ids binary, " + ", ".join(f"{c} int" for c in names[2:])).toPandas()
    return {bytes(r[0]): (bytes(r[1]), *map(int, r[2:])) for r in rows.itertuples(index=False)}


def encode_documents(docs: DataFrame, path: str, text: str = "text", table_bytes: int = TABLE_BYTES,
                     decode: bool = True, digest: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the ``keep`` columns, ``n_tokens``, ``ids`` (binary,
    little-endian unsigned 32-bit) and, with ``decode``, the decoded text.
    ``digest`` gives the SHA-256 of both instead (``ids_sha256`` of the decimal
    ids joined by spaces, ``decoded_sha256``), so that they need not leave the
    worker."""
    spark: SparkSession = docs.sparkSession
    table = spark.sparkContext.broadcast(reuse_table(docs, path, text, table_bytes))
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", "long")
    for name, kind in ([("ids_sha256", "string"), ("decoded_sha256", "string")] if digest
                       else [("ids", "binary"), ("decoded", "string")][:1 + decode]):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shared = encoder(path), table.value
        for b in batches:
            made: dict[str, list] = {c: [] for c in schema.names[len(keep):]}
            for ids in encode_texts(enc, b["__text"].tolist(), shared):
                row = [len(ids) // 4]
                if digest or decode:
                    listed = np.frombuffer(ids, "<u4").tolist()
                    decoded = enc.decode(listed)
                if digest:
                    row += [hashlib.sha256(" ".join(map(enc.decimal.__getitem__, listed)).encode()).hexdigest(),
                            hashlib.sha256(decoded.encode()).hexdigest()]
                else:
                    row += [ids, decoded][:1 + decode]
                for c, v in zip(made, row, strict=True):
                    made[c].append(v)
            out = b.drop(columns="__text")
            for c, v in made.items():
                out[c] = v
            yield out

    return rows.mapInPandas(run, schema)
