"""Conversation repair, whitening and WARC archives against brute force and the standard library."""
import base64
import gzip
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.llm import chat_repair, warc, whitening
from termlens.llm.common import scratch_table_path

# ---- conversation repair -----------------------------------------------------


def exhaustive(codes):
    """Least (cost, audit) over every edit string with at most two insertions in a place."""
    best, ins = None, ["", "u", "a", "ua", "au"]
    own = []
    for c in codes:
        extra = 5 * c.isupper()
        own.append([(2, "D", "")] + ([] if c.isdigit() else [(extra, "K", c.lower()), (1 + extra, "R", "u"), (1 + extra, "R", "a")]))
    for edits in itertools.product(*own):
        for gaps in itertools.product(ins, repeat=len(codes) + 1):
            roles = "".join(g + e[2] for g, e in itertools.zip_longest(gaps, edits, fillvalue=(0, "", "")))
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = sum(e[0] for e in edits) + 5 * sum(map(len, gaps))
                audit = "".join("I" * len(g) + e[1] for g, e in itertools.zip_longest(gaps, edits, fillvalue=(0, "", "")))
                best = min(best or (cost, audit), (cost, audit))
    return best


def folded(parts):
    fold = chat_repair.Fold()
    for p in parts:
        fold.add(chat_repair.summary(p))
    cost, audits = fold.result()
    return cost, "".join(a for _, a in audits)


def by_rows(codes):
    """Least (cost, audit) row by row: a table of states, no bounds and no search."""
    front = {0: (0, "")}
    for c in [*codes, None]:
        for _ in range(3):
            for q, (cost, audit) in list(front.items()):
                p = chat_repair.NEXT[q, chat_repair.WANTED[q]]
                front[p] = min(front.get(p, (10**9, "")), (cost + 5, audit + "I"))
        if c is None:
            return min(front[q] for q in (0, 3) if q in front)
        after = {}
        for q, (cost, audit) in front.items():
            for e, p, more in chat_repair.steps(c, q):
                after[p] = min(after.get(p, (10**9, "")), (cost + more, audit + e))
        front = after


def test_search_is_optimal():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3):
        for codes in {"".join(rnd.choice("suaxSUAX0123") for _ in range(n)) for _ in range(14)}:
            assert folded([codes] if codes else []) == exhaustive(codes), codes
    for _ in range(300):
        codes = "".join(rnd.choice("suauauauaxUA12") for _ in range(rnd.randrange(1, 40)))
        want = by_rows(codes)
        assert folded([codes]) == want, codes
        cut = sorted(rnd.sample(range(len(codes) + 1), min(3, len(codes))))
        assert folded([codes[a:b] for a, b in itertools.pairwise([0, *cut, len(codes)]) if a < b]) == want, (codes, cut)


def test_search_on_a_long_segment():
    rnd = random.Random(4)
    codes = "".join(rnd.choice("uauauauauax1U") for _ in range(256))
    assert folded([codes]) == by_rows(codes)


def reference(rows):
    """(conv, turn, role, text) after damage -> the report of one conversation, in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes, faults = set(), "", []
    for _, role, text in rows:
        last = re.findall("[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        i = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "suax".index(i).__str__() if fault in ("blank", "duplicate") else i.upper() if fault else i
    cost, audit = by_rows(codes)
    lines, state, at = [], 0, 0
    for e in audit:
        if e in "IR":
            who = {"u": "user", "a": "assistant"}[chat_repair.WANTED[state]]
            lines.append(f"{who}:{rows[at][2] if e == 'R' else ''}")
            state = chat_repair.NEXT[state, chat_repair.WANTED[state]]
        elif e == "K":
            lines.append(f"{rows[at][1]}:{rows[at][2]}")
            state = chat_repair.NEXT[state, rows[at][1][0]]
        at += e != "I"
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            out += [(conv, row)] * (2 if fate == 3 else 1)
    return out


def edge_turns():
    rnd = random.Random(8)
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t}.") for c in range(60) for t in range(rnd.randrange(1, 9))]
    rows += [(100, t, rnd.choice(["user", "assistant", "tool", "system", "", None]), rnd.choice([f"x{t}!", "same.", "cut", " \n", None, "😀?\t"]))
             for t in range(900)]                                                    # several segments
    rows += [(101, None, "user", "a."), (101, None, "assistant", "b."), (101, 5, "user", "c."), (101, 2, None, None)]
    rows += [(102, 7, "user", "again.")] * 3 + [(102, 7, "assistant", "again.")] * 2  # ties and repeated rows
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"no id {t}.") for t in range(30)]
    rows += [(None, None, None, None), (103, 1, "system", "only."), (104, 1, "user", "w " * 300_000)]
    rows += [(c, 0, "user", "lost.") for c in range(200, 260)]                        # some lose their only row
    return rows


@pytest.mark.parametrize("bits", [8, 2])
def test_repair_report_matches_plain_python(spark, monkeypatch, bits):
    monkeypatch.setattr(chat_repair, "SEGMENT_BITS", bits)
    rows = edge_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumns({"key": F.lit("x"), "seg": F.lit(1), "pos": F.lit(2), "cost": F.lit(3)})
    got = {r[0]: tuple(r)[1:] for r in chat_repair.repair_report(chat_repair.damage(df), df).collect()}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = [r for c, r in after if c == conv]
        assert got[conv] == reference(own), conv
    assert len(got) == len({r[0] for r in rows}) and any(v[6] == "" for v in got.values())


def test_repaired_turns_alternate(spark):
    rows = edge_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    put = chat_repair.placed(chat_repair.damage(df))
    plan = chat_repair.repair_plan(put, chat_repair.coded(put))
    said = {}
    for r in chat_repair.repaired_turns(put, plan).orderBy("key", "place").collect():
        assert r.place == len(said.setdefault(r.key, []))
        said[r.key].append((r.role, r.text))
    report = {r.conv_id: r for r in chat_repair.repair_report(chat_repair.damage(df), df).collect()}
    for conv, r in report.items():
        turns = said.get("" if conv is None else f"={conv}", [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x, _ in turns))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest() == r.repaired_sha256


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_repair.repair_report(chat_repair.damage(df), df).count() == 0


# ---- whitening ---------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_whitening_against_numpy(spark):
    rnd = np.random.default_rng(1)
    data = (rnd.standard_normal((300, 12)) @ rnd.standard_normal((12, 12))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(i % 7, data[0].tolist()) for i in range(200)]  # copies don't weigh
    rows += [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11),
             (904, [1.0, 2.0]), (905, []), (906, [1e30] * 12)]
    df = vectors(spark, rows).withColumns({"x": F.lit("own"), "white": F.lit("old"), "n": F.lit(1)})
    x = np.unique(np.floor(256 * data.astype(float)).astype(np.int64), axis=0)
    n, sums = len(x), x.sum(0)
    cov = (x - sums / n).T @ (x - sums / n) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    model = whitening.fit(df)
    assert model.n == n and model.sums == sums.tolist() and model.identity_error < 1e-10
    assert np.allclose(model.eigenvalues, e, rtol=1e-12) and np.isclose(model.trace, np.trace(cov), rtol=1e-13)
    assert np.allclose(np.abs((u * model.basis).sum(0)), 1, atol=1e-11)
    got = whitening.add_whitened(df, model).collect()
    assert len(got) == 500 and {r.x for r in got} == {"own"}
    for r in got:
        v = np.floor(256 * np.array(r.embedding)).astype(np.int64)
        assert r.white.deviation == int(((n * v - sums) ** 2).sum())
        assert np.allclose(r.white.whitened, (v - sums / n) @ (model.basis / np.sqrt(model.eigenvalues)), atol=1e-12)


def test_jacobi_on_graded_and_deficient_matrices():
    rnd = np.random.default_rng(3)
    q, _ = np.linalg.qr(rnd.standard_normal((20, 20)))
    want = 10.0 ** -np.arange(20)
    values, basis = whitening.eigen((q * want) @ q.T)
    assert np.allclose(values[:8], want[:8], rtol=1e-7) and np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-12)
    low = rnd.standard_normal((15, 3))
    values, basis = whitening.eigen(low @ low.T)
    assert len(values) == 3 and np.allclose(basis * values @ basis.T, low @ low.T, atol=1e-10)
    factor, order = whitening.pivoted_cholesky(low @ low.T)
    assert factor.shape == (15, 3) and np.allclose(np.triu(factor, 1), 0) and np.allclose(factor @ factor.T, (low @ low.T)[np.ix_(order, order)])
    for n in (0, 1, 2, 3, 7, 8):
        pairs = sorted((int(a), int(b)) for p, r in whitening._rounds(n) for a, b in zip(p, r, strict=True)) if n > 1 else []
        assert pairs == list(itertools.combinations(range(n), 2))


def test_whitening_edge(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])]):
        df = vectors(spark, rows)
        model = whitening.fit(df)
        assert len(model.eigenvalues) == 0 and whitening.add_whitened(df, model).count() == 0
    line = vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)] + [(None, [3.0, 6.0, 0.0])])
    model = whitening.fit(line)
    assert len(model.eigenvalues) == 1 and whitening.add_whitened(line, model).count() == 10
    big = vectors(spark, [(i, [i * 1e15, 0.5]) for i in range(4)])
    model = whitening.fit(big)
    assert {r.white.deviation for r in whitening.add_whitened(big, model).collect()} == {None}


# ---- WARC --------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def expected(rows, min_bytes=0):
    out, last = [], {}
    for i, u, h in rows:
        last[h or ""] = max(last.get(h or "", (-1, "")), (-1 if i is None else i, u or f"urn:page:{'null' if i is None else i}"))
    used = set()
    for i, u, h in rows:
        data = (h or "").encode()
        me = (-1 if i is None else i, u or f"urn:page:{'null' if i is None else i}")
        revisit = len(data) >= min_bytes and (me != last[h or ""] or (h or "") in used)
        if len(data) >= min_bytes and me == last[h or ""]:
            used.add(h or "")
        refers = last[h or ""][0] if revisit else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                    None if refers == -1 else refers))
    return sorted(out, key=repr)


def odd_pages():
    rnd = random.Random(6)
    hot = "<p>copied</p>" * 40
    rows = [(i, f"http://h{i % 9}.example.org:80{i % 3}/p/{i}?q=ä {i}#top", f"<b>{rnd.random()}</b>\r\n\r\n{'x' * rnd.randrange(300)}") for i in range(120)]
    rows += [(1000 + i, f"https://www.example.com/{i % 5}", hot) for i in range(60)]        # one group of copies, few URLs
    rows += [(2000, "https://same.example.com/", "twice")] * 3                              # repeated rows
    rows += [(3000, None, None), (3001, "", ""), (None, "http://no.id/", "<i>no id</i>"), (None, None, "neither"),
             (3002, "http://a.b/\n x", "ÄÖ 😀\x00"), (3003, "not a url", "WARC/1.1\r\n"), (3004, "http://big.example/", "long " * 400_000)]
    return rows


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_round_trip(spark, monkeypatch, min_bytes):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = odd_pages()
    df = spark.createDataFrame(rows, PAGES).withColumns({"type": F.lit("x"), "data": F.lit(1), "n": F.lit(2), "copy": F.lit(3)}).repartition(4)
    got = sorted(((None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.type,
                   None if r.response_id is None else int(r.response_id)) for r in warc.round_trip(df, min_bytes).collect()), key=repr)
    assert got == expected(rows, min_bytes)


def test_files_are_plain_gzip_warc(spark):
    rows, path = odd_pages(), scratch_table_path(spark, "archive")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), path)
    types, payloads = [], set()
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            rest = gzip.open(os.path.join(path, name)).read()
            while rest:
                head, _, tail = rest.partition(b"\r\n\r\n")
                assert head.startswith(b"WARC/1.1\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                block, rest = tail[:int(fields["Content-Length"])], tail[int(fields["Content-Length"]) + 4:]
                types.append(fields["WARC-Type"])
                if types[-1] == "response":
                    payloads.add(block.partition(b"\r\n\r\n")[2].decode())
    assert types.count("response") + types.count("revisit") == len(rows) and "warcinfo" in types
    assert payloads == {h or "" for _, _, h in rows}


def test_index_finds_what_a_scan_finds(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    rows = odd_pages()
    path, index = scratch_table_path(spark, "archive"), scratch_table_path(spark, "captures")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    found = warc.cut_lineage(warc.records(spark, path).withColumn("key", warc.url_key(F.col("uri"))))
    warc.write_index(found, index, shards=4)
    loaded = warc.Index.load(spark, index)
    assert 1 < len(loaded.shards) <= 4
    keys = ["com,example,www)/3", "org,example,h1:801)/p/10?q=ä_10", "com,example,absent)/", "", "zz)/"]
    for k in keys:
        want = {r.record_id for r in found.where(F.col("key") == k).collect()}
        assert {r.record_id for r in warc.lookup(spark.createDataFrame([(k,)] * 2, "key string"), loaded).collect()} == want
    whole = warc.lookup(found.select("key"), loaded)
    assert sorted(r.record_id for r in whole.collect()) == sorted(r.record_id for r in found.collect())
    one = warc.fetch(warc.lookup(spark.createDataFrame([("example,big)/",)], "key string"), loaded), payload=True).first()
    assert one.payload == b"long " * 400_000


def test_url_keys(spark):
    urls = {"https://www.Example.com:443/a/B?x=1#f": "com,example,www)/a/B?x=1", "http://u@h.org:8080": "org,h:8080)/",
            "host.net?q": "net,host)/?q", "": ")/", "urn:page:7": "urn)/page:7"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.url_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in got} == urls


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
