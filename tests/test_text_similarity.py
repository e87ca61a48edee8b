"""Prefix-filtered cosine join against all pairs."""
import collections
import math
import random
import re

import pytest

from termlens.operators import text_similarity
from termlens.operators.text_similarity import similar_classes, similar_pairs


def brute(texts, t):
    words = {i: [w for w in re.findall("[a-z]+", x or "") if len(w) > 2 and w != "here"] for i, x in texts.items()}
    bags = {i: collections.Counter(w) for i, w in words.items() if w}
    n = len(bags)
    df = collections.Counter(w for b in bags.values() for w in b)
    vec = {}
    for i, b in bags.items():
        v = {w: c * math.log(n / (df[w] + 1)) for w, c in b.items() if df[w] + 1 < n}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {w: x / norm for w, x in v.items()} if norm else {}
    first = {}
    for i in sorted(bags):
        first.setdefault(frozenset(bags[i].items()), i)
    names = sorted(first.values())
    out = {}
    for k, a in enumerate(names):
        for b in names[k + 1:]:
            c = sum(x * vec[b].get(w, 0) for w, x in vec[a].items())
            if c >= t - 1e-9:
                out[a, b] = c
    return out


def texts_like(rnd, n):
    base = [[f"{a}{b}{c}" for a, b, c in zip(rnd.choices("kljpz", k=30), rnd.choices("aeiou", k=30), rnd.choices("rstvz", k=30))] for _ in range(12)]
    out = {}
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 12)):
            words[rnd.randrange(len(words))] = rnd.choice(["mup", "kuz", f"new{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}"])
        rnd.shuffle(words)
        out[i] = " ".join(words)
    return out


@pytest.mark.parametrize(("threshold", "block", "short"), [(0.8, 500, 40), (0.5, 7, 3), (0.95, 7, 1)])
def test_pairs_match_brute_force(spark, threshold, block, short):
    rnd = random.Random(9)
    texts = texts_like(rnd, 150) | {500: None, 501: "", 502: "...", 503: "lonely words here", 504: "here lonely words"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    pairs, members = similar_pairs(df, threshold, block=block, short=short)
    name = {}
    for r in members.collect():
        name[r.c] = min(name.get(r.c, 10**9), r.doc)
    got = {tuple(sorted((name[r.a], name[r.b]))): r.cosine for r in pairs.collect()}
    want = brute(texts, threshold)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want) and len(want) > 5


def test_copies_are_not_expanded(spark):
    rows = [(i, "some text that many documents share entirely") for i in range(300)]
    rows += [(1000, "some text that many documents share mostly"), (1001, "other content stands alone")]
    rows += [(2000 + i, f"filler number {chr(97 + i)}{chr(98 + i)}x {chr(99 + i)}{chr(97 + i)}y") for i in range(20)]
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), 0.1).collect()
    pair = [r for r in got if (r.class_id, r.similar_class_id) == (0, 1000)]
    assert len(got) < 300 and (not pair or (pair[0].n_docs, pair[0].similar_n_docs) == (300, 1))
    assert similar_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_candidates_are_verified_on_whole_vectors(spark, monkeypatch):
    """the vectors of both sides were sent for every candidate."""
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bcdfghklmnprst" for b in "aeiou" for c in "bdgkmnprstvz"]
    texts = {i: " ".join(rnd.choices(words, k=60)) for i in range(300)}
    texts |= {300 + i: " ".join(texts[i].split()[:-4] + [f"other{chr(97 + i)}"]) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    seen, pruned = [], text_similarity.can_reach

    def counting(met, *args):
        out = pruned(met, *args)
        seen.append((met.count(), out.count()))
        return out

    monkeypatch.setattr(text_similarity, "can_reach", counting)
    pairs, members = similar_pairs(df, 0.5)
    name = {r.c: r.doc for r in members.collect()}
    got = {tuple(sorted((name[r.a], name[r.b]))) for r in pairs.collect()}
    assert got == brute(texts, 0.5).keys() and len(got) >= 20
    assert seen[0][1] < seen[0][0] / 3
