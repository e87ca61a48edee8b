"""Packing and BPE against the tokenizers library itself."""
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from termlens.llm import bpe, packing
from termlens.llm.common import release_memory

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_and_chunks_are_exact_on_odd_texts(library):
    enc, rnd = bpe.PieceEncoder(PATH), random.Random(5)
    parts = ["a", "B", "'s", "'", " ", "\n", "\t", ".", ",", "é", "é", "Σ", "ς", "İ", "ß", "中文", "١2", "²", " ",
             "\x1c", "!!", "###", "don't", "<|endoftext|>", "😀", "ﬁ", "word", "º"]
    for k in range(600):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 500 if k % 10 == 0 else 40)))
        want = np.asarray(library(text), "<u4").tobytes()
        assert enc.encode(text) == want, text
        assert bpe.encode_by_chunks(enc, text, {}) == want, text


def test_decoding_is_the_library_s(library):
    enc = bpe.PieceEncoder(PATH)
    for text in ("", "Hello, World! it's 42 <|endoftext|> ñandú 😀 中文", "a  b\n\nc"):
        ids = library(text)
        assert enc.decode(ids) == enc.tokenizer.decode(ids, skip_special_tokens=False)


def test_long_run_without_separators(library):
    enc, rnd = bpe.PieceEncoder(PATH), random.Random(6)
    text = "".join(rnd.choice("abcdefg") for _ in range(8000))
    assert bpe.encode_by_chunks(enc, text, {}) == np.asarray(library(text), "<u4").tobytes()


def test_chunks_are_content_defined():
    passage = " ".join(f"w{i * 7919 % 1000}" for i in range(900))
    a, b = bpe.chunks_of("start " + passage), bpe.chunks_of("another beginning of a text " + passage)
    assert "".join(a) == "start " + passage
    assert len(set(a) & set(b)) >= len(a) - 4 > 3


def test_encode_documents_edge(spark, edge, library):
    rows = bpe.encode_documents(edge, PATH).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    want = edge.select("doc_id", "text").collect()
    assert len(rows) == len(want)
    for w in want:
        assert all(r.n_tokens == len(r.ids) // 4 for r in by_id[w.doc_id])
        assert np.frombuffer(by_id[w.doc_id][0].ids, "<u4").tolist() == library(w.text)


def test_reuse_table_gives_the_same(spark, docs, library):
    twice = docs.limit(40).union(docs.limit(40))
    assert len(bpe.reuse_table(twice, PATH)) > 10
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode_documents(twice, PATH).collect()}
    assert all(got[r.doc_id] == library(r.text) for r in twice.select("doc_id", "text").collect())


def test_empty_tables(spark, empty):
    assert bpe.encode_documents(empty, PATH).count() == 0
    assert packing.pack(packing.encode_stream(empty, PATH)).count() == 0


@pytest.mark.parametrize("length", [7, 4096])
def test_packing_covers_every_id_once(spark, edge, library, length):
    pieces = packing.pack(packing.encode_stream(edge.repartition(3), PATH), length).collect()
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length
    for k, v in seqs.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == length or k == max(seqs)
    want = sum(len(library(r.text)) + 1 for r in edge.select("text").collect())
    assert sum(p.length for p in pieces) == want and sorted(seqs) == list(range(len(seqs)))
    one = [p for p in pieces if p.doc_id == 8]
    whole = b"".join(p.ids for p in sorted(one, key=lambda p: p.start))
    text = next(r.text for r in edge.collect() if r.doc_id == 8)
    assert zlib.crc32(whole) == zlib.crc32(np.asarray(library(text) + [2], "<u4").tobytes())


def test_a_small_cache_is_bounded_and_exact(library):
    """The stage that releases its memory keeps fewer pieces than the operator alone."""
    enc = bpe.PieceEncoder(PATH, cache_pieces=100)
    for k in range(50):
        text = " ".join(f"w{k * 20 + i}ord.{i}" for i in range(20)) + "\nend"
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library(text)
        assert len(enc.new) <= 200 and len(enc.old) <= 200
    assert packing.RELEASED_PIECES < bpe.CACHE_PIECES


def test_freed_memory_goes_back_to_the_system():
    """Blocks freed below one that lives on stay with the process until they are released."""
    def anon():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    kept = [bytes(1000) for _ in range(200_000)]
    full = anon()
    kept = kept[::40]
    release_memory()
    assert len(kept) == 5000 and full - anon() > 100
