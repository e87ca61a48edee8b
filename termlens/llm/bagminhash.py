"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A text is the multiset of its five-word shingles (lower case, white-space
words; a shorter text is one shingle).  Weights are the counts.  For every
shingle the weight axis is cut into the dyadic blocks [0,1), [1,2), [2,4), ...;
each block has its own Poisson process over time, drawn from the shingle's
hash alone, whose points carry a slot and a level.  A point counts if its
level lies under the weight; a slot's signature is the first such point.  So
two texts agree in a slot with the probability of their weighted Jaccard
similarity, and a process stops as soon as it is later than every slot.

Signatures are banded (``BANDS`` x ``ROWS``).  Texts that meet in a band are
verified exactly on their multisets: every bucket's members against a centre
(a star, never all pairs), with a new centre each round for what is still
apart: a random one, then the one with most links so far.  What is still apart
after that, unless an exact bound on common elements rules a text out, is
compared bucket by bucket: the elements of a bucket's texts are dealt into
chunks of bounded size, a task counts the common elements of two chunks' texts
by matrix products and returns one link for each text and other class.  So every
pair of different classes that shares a bucket is verified, whatever the size of
the bucket, and no pairs are written.  Verified links give the classes (connected
components).  Exact copies are one node throughout.

Defined results: null, empty and wordless texts have no shingle and each is a
class of its own; copies (equal texts) are one class; a class is named by its
least document id; rows with a null id name a class only if no other can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import blocks, cut_lineage, free_name, likely, mix64, word_hashes

SHINGLE = 5
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
THRESHOLD = 0.8
STAR_ROUNDS = 4
PRUNE_ROUNDS = 3
MOST_LEFT = 0.8               # share of the rows that a round of pruning leaves, if another one follows
BLOCK_DOCS = 256
CHUNK_ELEMENTS = 1 << 20      # elements of a chunk of a bucket's texts
COLUMNS = 2048                # elements of a matrix product
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every shingle occurrence."""
    doc, h = word_hashes([t.lower() for t in texts])
    if not len(doc):
        return doc, h
    n = np.bincount(doc, minlength=len(texts))
    size = np.minimum(n, SHINGLE)[doc]                     # words of a shingle of that text
    end = np.cumsum(n)[doc]
    starts = np.flatnonzero(np.arange(len(doc)) + size <= end)
    out = size[starts].astype(np.uint64)
    for k in range(SHINGLE):
        at = np.minimum(starts + k, len(h) - 1)
        out = np.where(k < size[starts], mix64(out * GOLDEN + h[at]), out)
    return doc[starts], out


def multiset(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count), sorted by text and shingle."""
    doc, h = shingles(texts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(doc) else doc
    return doc[new], h[new], np.diff(np.append(new, len(doc)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """BagMinHash signatures [n_docs, SLOTS]: the times of first points; infinity without a shingle."""
    sig = np.full(n_docs * SLOTS, np.inf)
    parts, low = [], 0
    while len(weight) and (live := weight > low).any():     # dyadic blocks [low, low + width)
        width = max(low, 1)
        seed = mix64(shingle[live] ^ mix64(np.full(1, low + 1, np.uint64)))
        parts.append((doc[live], seed, np.full(len(seed), width), weight[live] - low))
        low += width
    if not parts:
        return sig.reshape(n_docs, SLOTS)
    d, seed, width, room = (np.concatenate(x) for x in zip(*parts, strict=True))
    t, step = np.zeros(len(d)), 0
    while len(d):
        k = int(np.clip(8192 // len(d), 1, 64))             # points drawn at once
        u = mix64(seed[:, None] + GOLDEN * np.arange(step + 1, step + k + 1, dtype=np.uint64))
        gap = -np.log(((u >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / width[:, None]
        when = t[:, None] + np.cumsum(gap, 1)
        v = mix64(u ^ GOLDEN)
        slot = (v % np.uint64(SLOTS)).astype(np.int64) + d[:, None] * SLOTS
        level = ((v >> np.uint64(32)) % width[:, None].astype(np.uint64)).astype(np.int64)
        hit = level < room[:, None]
        np.minimum.at(sig, slot[hit], when[hit])
        t, step = when[:, -1], step + k
        limit = sig.reshape(n_docs, SLOTS).max(1)
        on = t < limit[d]
        d, seed, width, room, t = d[on], seed[on], width[on], room[on], t[on]
    return sig.reshape(n_docs, SLOTS)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band, the band's number mixed in."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        h = mix64(h * GOLDEN + bits[:, :, r])
    return h.view(np.int64)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["text"].tolist()
        for first, block in blocks(texts, BLOCK_DOCS):
            doc, sh, w = multiset(block)
            n = np.bincount(doc, weights=w, minlength=len(block)).astype(np.int64)
            hashes = band_hashes(signatures(doc, sh, w, len(block)))
            part = b.iloc[first:first + len(block)][["id", "k1", "k2"]].copy()
            part["n"] = n
            part["bands"] = [h if k else None for h, k in zip(hashes, n, strict=True)]
            yield part


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Multisets as sets: the j-th occurrence of a shingle is an element of its own."""
    for b in batches:
        for first, block in blocks(b["text"].tolist(), BLOCK_DOCS):
            doc, sh, w = multiset(block)
            nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            el = np.where(nth == 0, np.repeat(sh, w), mix64(np.repeat(sh, w) + GOLDEN * nth.astype(np.uint64)))
            cut = np.searchsorted(np.repeat(doc, w), np.arange(len(block) + 1))
            part = b.iloc[first:first + len(block)][["node"]].copy()
            part["el"] = [el[cut[i]:cut[i + 1]].view(np.int64) for i in range(len(block))]
            yield part


def verified(pairs: DataFrame, elements: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of at least ``threshold`` multiset Jaccard similarity."""
    ea = elements.select(F.col("node").alias("a"), F.col("el").alias("ea"))
    eb = elements.select(F.col("node").alias("b"), F.col("el").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(ea, "a").join(eb, "b").where(
        both >= threshold * (F.size("ea") + F.size("eb") - both) - 1e-9).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with the least node of each connected component: labels,
    the least neighbours at first, spread along the links and jump to their
    label's label until none changes."""
    sym = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    least = sym.groupBy("a").agg(F.min("b").alias("near"))
    lab = cut_lineage(nodes.join(least, nodes["node"] == least["a"], "left").select(
        "node", F.least("node", F.coalesce("near", "node")).alias("label")))
    while True:
        near = sym.join(lab.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(
            F.min("label").alias("near"))
        step = lab.join(near, lab["node"] == near["a"], "left").select(
            "node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = lab.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut_lineage(step.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")))
        if new.where("label <> was").limit(1).count() == 0:
            return new.select("node", "label")
        lab = new.select("node", "label")


def relabel(lab: DataFrame, links: DataFrame) -> DataFrame:
    """``lab`` with the classes joined that verified links connect."""
    a = lab.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = lab.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = cut_lineage(links.join(a, "a").join(b, "b").where("la <> lb").select(
        F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    nodes = between.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    merged = components(nodes, between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return cut_lineage(lab.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def one_of_each(member: DataFrame) -> DataFrame:
    """``member`` (h, node, ...) without the buckets that have the same nodes as another one: they give the same pairs."""
    sets = member.groupBy("h").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("s1"),
                                   F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2"))
    return member.join(sets.groupBy("c", "s1", "s2").agg(F.min("h").alias("h")).select("h"), "h", "left_semi")


def _fits(threshold: float):
    return F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
            threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``id``, the text's hashes ``k1`` and ``k2``, ``n``
    shingles, ``class_id`` and ``n_texts`` (different texts of the class)."""
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("k1"),
                        F.xxhash64(F.lit(1), F.col(text)).alias("k2"))
    sketch = cut_lineage(keyed.mapInPandas(_sketch, "id long, k1 long, k2 long, n long, bands array<long>"))
    nodes = cut_lineage(sketch.where("n > 0").groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.max("n").alias("n"), F.any_value("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()))
    member = nodes.select("node", "n", F.explode("bands").alias("h"))
    shared = nodes.select(F.explode("bands").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    member = cut_lineage(one_of_each(cut_lineage(member.join(shared, "h", "left_semi"))))
    met = cut_lineage(nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", "rep", "k1", "k2"))
    # only the texts that are met by others are moved, one of each
    few = likely(keyed, [F.col("id").cast("long"), "k1", "k2"], met, ["rep", "k1", "k2"])
    source = few.join(met, ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("rep"))).dropDuplicates(["k1", "k2"])
    elements = cut_lineage(source.select("node", "text").mapInPandas(_elements, "node long, el array<long>"))
    lab = cut_lineage(met.select("node", F.col("node").alias("label")))
    degree = lab.select("node", F.lit(0).cast("long").alias("deg")).limit(0)
    for r in range(STAR_ROUNDS):
        # by turns a random centre and the one with most links, which is near the middle of its texts
        now = member.join(lab, "node").join(degree, "node", "left")
        rank = F.struct((F.coalesce("deg", F.lit(0)) * -(r % 2)).alias("d"), F.xxhash64(F.lit(r), "node"), "node", "n", "label")
        centre = now.groupBy("h").agg(F.min(rank).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(
            "lo < hi").select("h", F.col("c.node").alias("b"), F.col("c.n").alias("m"), F.col("c.label").alias("lb"))
        pairs = now.join(centre, "h").where((F.col("label") != F.col("lb")) & _fits(threshold)).select(
            F.col("node").alias("a"), "b").distinct()
        links = cut_lineage(verified(pairs, elements, threshold))
        if r % 2 and links.limit(1).count() == 0:
            break
        lab = relabel(lab, links)
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    links = cut_lineage(_apart(member, lab, elements, threshold))
    if links.limit(1).count():
        lab = relabel(lab, links)
    named = nodes.select("node", "k1", "k2", "rep").join(lab, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    size = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.count("*").alias("n_texts"))
    named = named.join(size, "label").select("k1", "k2", "class_id", "n_texts")
    alone = sketch.where("n = 0").select("id", "k1", "k2", "n", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_texts"))
    return sketch.where("n > 0").select("id", "k1", "k2", "n").join(named, ["k1", "k2"]).select(
        "id", "k1", "k2", "n", "class_id", "n_texts").unionByName(alone)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every two of the sets."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = times[column] > 1                               # elements of one set only have no column
    owner, column = owner[met], np.unique(column[met], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32 if max(map(len, sets)) < 1 << 24 else float)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        m = np.zeros((len(sets), COLUMNS), out.dtype)
        m[owner[part], column[part] - lo] = 1
        out += m @ m.T
    return out


def _bucket_links(threshold: float):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        """Links between different classes of two chunks of a bucket (or within one), one for each text and other class."""
        node, label, chunk = (b[c].to_numpy() for c in ("node", "label", "chunk"))
        both = _common([np.asarray(x) for x in b["el"]])
        n = b["n"].to_numpy().astype(float)
        near = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
        near &= label[:, None] != label[None, :]
        if b["lo"].iloc[0] != b["hi"].iloc[0]:
            near &= chunk[:, None] != chunk[None, :]
        x, y = np.nonzero(near & (node[:, None] < node[None, :]))
        return pd.DataFrame({"a": node[x], "b": node[y], "l": label[y]}).drop_duplicates(["a", "l"])[["a", "b"]]

    return run


def _apart(member: DataFrame, lab: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Links between texts of different classes that share a bucket; one at least for each text and class.

    Texts that cannot be alike drop out first: what two texts of different
    classes have in common lies among the elements that each shares with another
    class, so the many texts near a large class that differ too much go alone."""
    now = member.join(lab, "node")
    rows = None
    for _ in range(PRUNE_ROUNDS):     # what dropped out is no longer shared with
        mixed = now.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
        now = cut_lineage(now.select("h", "node", "n", "label").join(mixed, "h", "left_semi"))
        el = elements.join(now.select("node", "label").distinct(), "node").select("node", "label", F.explode("el").alias("e"))
        spread = el.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("e")
        common = el.join(spread, "e", "left_semi").groupBy("node").agg(F.count("*").alias("sh"))
        now = cut_lineage(now.join(common, "node").where(F.col("sh") >= threshold * F.col("n") - 1e-9))
        left, rows = rows, now.count()
        if left is not None and rows > MOST_LEFT * left:     # another round wouldn't pay
            break
    now = one_of_each(now.select("h", "node", "n", "label"))
    sizes = now.groupBy("h").agg(F.ceil(F.sum("n") / CHUNK_ELEMENTS).cast("int").alias("chunks"),
                                 F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("h", "chunks")
    dealt = now.select("h", "node", "n", "label").join(sizes, "h").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # a chunk meets itself and every other one
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("h", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "n", "label")
    return dealt.join(elements, "node").groupBy("h", "lo", "hi").applyInPandas(_bucket_links(threshold), "a long, b long").distinct()


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class (the one that names it); columns unchanged.
    Of repeated rows (equal id and text) one stays."""
    found = classes(docs, text, doc_id, threshold)
    head = cut_lineage(found.where("id <=> class_id").groupBy("id", "k1", "k2").agg(F.count("*").alias("rows")))
    a, b, c, r = (free_name(docs, x) for x in ("id", "k1", "k2", "rows"))
    kept = docs.join(head.select(F.col("id").alias(a), F.col("k1").alias(b), F.col("k2").alias(c), F.col("rows").alias(r)),
                     F.col(doc_id).eqNullSafe(F.col(a)) & (F.xxhash64(F.col(text)) == F.col(b))
                     & (F.xxhash64(F.lit(1), F.col(text)) == F.col(c)))
    if head.where("rows > 1").limit(1).count():
        kept = kept.dropDuplicates([doc_id, b, c])
    return kept.drop(a, b, c, r)
