"""Conversation structure repair: the cheapest edits that make the roles alternate.

A row is blank (no visible character), a duplicate (role and text seen earlier
in its conversation) or truncated (its last visible character ends no sentence);
the first that holds counts.  Edits: (K)eep costs 0, (R)erole to user or
assistant 1, (D)elete 2 - the only edit of blank and duplicate rows -, (I)nsert
an empty user or assistant turn 5; a truncated row that isn't deleted adds 5.
The initials of the repaired roles must be ``(s?(ua)+)?``; of the cheapest edit
strings the least in ASCII order is taken.

Search: depth-first branch and bound with an explicit stack over nodes (rows
done, state of the role pattern).  The bound of a node is its cost so far plus
the least cost of the rest, whatever its edit string; a node is cut if its bound
exceeds the cost of the incumbent (cost, audit) or equals it with a greater
string.  A table per node keeps the best prefix that reached it; equal or worse
ones are dominated.  (Two strings of equal cost at a node are never prefixes of
each other, so their order holds for every continuation.)  The stack runs empty:
nothing better is left.

Scale: rows are sorted over all partitions by (conversation, turn) and written
with their places, so no task has to hold a conversation.  From then on a row is
one letter.  Segments of at most ``SEGMENT`` rows are solved where they are, for
every pair of entry and exit states; a conversation folds the results of its
segments as a stream and keeps four candidate strings, a byte a row each.  Its
repaired turns and their hash, sequential by nature, are a stream as well.

Defined results: nulls in any column read as one space.  A null conversation id
is a conversation of its own.  Rows of one turn are ordered by role, then text;
null turns come first.  A conversation without rows has cost 0, an empty audit
and the hash of the empty string; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import cut_lineage

SEGMENT_BITS = 8              # a segment has at most 2 ** SEGMENT_BITS rows
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States of the role pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = (0, 1, 2, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}     # the turn that a rerole or an insertion gives
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}     # insertions after the last row
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
FAR = 1 << 40                 # cost of what can't be reached
# A row's letter: s, u, a or x (any other initial), in upper case if truncated; 0 to 3 for those that must go.
GONE = ("suax", "0123")
VISIBLE = r"[^\x20\x09-\x0D]"


def steps(code: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, next state, cost) of a row's own edits in a state."""
    out = [("D", state, DELETE)]
    if code.isdigit():
        return out
    extra = TRUNCATED if code.isupper() else 0
    kept = NEXT.get((state, code.lower()))
    if kept is not None:
        out.append(("K", kept, KEEP + extra))
    return [*out, ("R", NEXT[state, WANTED[state]], REROLE + extra)]


def suffix_bounds(codes: str, ends: tuple[int, ...]) -> list[list[int]]:
    """Least cost of the rows from i on, from each state to one of ``ends``."""
    rest = [0 if q in ends else FAR for q in STATES]
    table = [rest]
    for code in reversed(codes):
        rest = [min(c + rest[p] for _, p, c in steps(code, q)) for q in STATES]
        for _ in range(2):                     # more insertions in a row lead back to a state
            rest = [min(rest[q], INSERT + rest[NEXT[q, WANTED[q]]]) for q in STATES]
        table.append(rest)
    return table[::-1]


def solve(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the best edits from ``start`` to one of ``ends``, insertions
    before rows only; None if there are none."""
    bound = suffix_bounds(codes, ends)
    if bound[0][start] >= FAR:
        return None
    n, best = len(codes), (FAR, "")
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        low = cost + bound[i][q]
        if low > best[0] or low == best[0] and audit > best[1][:len(audit)]:
            continue
        if (i, q) in seen and seen[i, q] <= (cost, audit):
            continue
        seen[i, q] = (cost, audit)
        if i == n:
            if q in ends:
                best = min(best, (cost, audit))
            continue
        after = [("I", i, NEXT[q, WANTED[q]], INSERT)] + [(e, i + 1, p, c) for e, p, c in steps(codes[i], q)]
        # the most promising comes on top, among equals the least edit
        after.sort(key=lambda x: (x[3] + bound[x[1]][x[2]], x[0]), reverse=True)
        stack += [(j, p, cost + c, audit + e) for e, j, p, c in after]
    return best


@functools.lru_cache(maxsize=20_000)
def summary(codes: str) -> str:
    """JSON list of (entry, exit, cost, audit): a segment's best edits for every pair of states."""
    found = ((p, q, solve(codes, p, (q,))) for p in STATES for q in STATES)
    return json.dumps([(p, q, *s) for p, q, s in found if s])


class Fold:
    """Best edits of a conversation, from its segments in order."""

    def __init__(self) -> None:
        self.front = {0: (0, 0)}               # state: cost, rank of its string among the states' strings
        self.trace: list[dict[int, tuple]] = []

    def add(self, parts: str) -> None:
        reached: dict[int, tuple] = {}
        for p, q, cost, audit in json.loads(parts):
            if p in self.front:
                so_far, rank = self.front[p]
                key = (so_far + cost, rank, audit, p)
                if q not in reached or key < reached[q]:
                    reached[q] = key
        # the strings end in a row's own edit, so none is a prefix of another
        order = sorted(reached, key=lambda q: reached[q][1:3])
        self.front = {q: (reached[q][0], rank) for rank, q in enumerate(order)}
        self.trace.append(reached)

    def result(self) -> tuple[int, list[tuple[int, str]]]:
        """(cost, [(entry state, audit) of each segment])."""
        cost, _, q = min((c + INSERT * len(CLOSING[q]), rank, q) for q, (c, rank) in self.front.items())
        out, audit_end = [], CLOSING[q]
        for reached in reversed(self.trace):
            _, _, audit, p = reached[q]
            out.append((p, audit + audit_end))
            q, audit_end = p, ""
        return cost, out[::-1]


def repaired(state: int, edits: str, role: str, text: str) -> tuple[int, list[tuple[str, str]]]:
    """The state after a row's edits (insertions, then its own) and the turns that they give."""
    out = []
    for e in edits:
        if e in "IR":
            out.append((ROLE[WANTED[state]], text if e == "R" else ""))
            state = NEXT[state, WANTED[state]]
        elif e == "K":
            out.append((role, text))
            state = NEXT[state, role[0]]
    return state, out


def pieces(edits: str) -> list[str]:
    """A segment's edits cut by row; the last piece holds insertions after all rows."""
    out = [""]
    for e in edits:
        out[-1] += e
        if e != "I":
            out.append("")
    return out


def said(c: str) -> Column:
    """A column's value as text, null as one space."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def conversation_key(c: str) -> Column:
    """A conversation id as a string that tells null from any value."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the hash of each row's id and turn decides."""
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate"))
    return out.where("fate <> 0").select(
        "conv_id", "turn", F.expr("CASE WHEN fate = 4 THEN 'user' ELSE role END AS role"),
        F.expr("CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text"),
        F.explode(F.expr("CASE WHEN fate = 3 THEN array(1, 2) ELSE array(1) END")).alias("copy")).drop("copy")


def placed(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, pos, seg): ``rows`` written in order; ``pos`` is a row's place among all."""
    keys = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(conversation_key(conv).alias("key"), F.col(turn).cast("long").alias("turn"),
                       said(role).alias("role"), said(text).alias("text"))
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    return cut_lineage(rows).withColumn("seg", F.shiftright("pos", SEGMENT_BITS))


def coded(rows: DataFrame) -> DataFrame:
    """(key, turn, pos, seg, fault, code) of placed rows; fault: blank, duplicate, truncated or null."""
    last = F.regexp_extract("text", rf"({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    slim = rows.select("key", "turn", "pos", "seg", "role", F.xxhash64("text").alias("h1"),
                       F.xxhash64(F.lit(1), "text").alias("h2"), last.alias("last"))
    # where first said, of what is said more than once; the tasks pre-aggregate a hot text
    again = slim.groupBy("key", "role", "h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1")
    fault = F.expr("CASE WHEN last = '' THEN 'blank' WHEN pos > first THEN 'duplicate'"
                   " WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END")
    initial = F.expr("CASE WHEN substring(role, 1, 1) IN ('s', 'u', 'a') THEN substring(role, 1, 1) ELSE 'x' END")
    code = F.expr(f"CASE WHEN fault IN ('blank', 'duplicate') THEN translate(i, '{GONE[0]}', '{GONE[1]}')"
                  " WHEN fault = 'truncated' THEN upper(i) ELSE i END")
    return slim.join(again.drop("c"), ["key", "role", "h1", "h2"], "left").select(
        "key", "turn", "pos", "seg", fault.alias("fault"), initial.alias("i")).withColumn("code", code).drop("i")


def _solve_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(parts=[summary(c) for c in b["codes"]])


PLAN = "key string, seg long, cost long, illegal long, state int, audit string"


def _fold_conversations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments sorted by (key, seg): per conversation a row of each segment and one (seg -1) of the whole."""
    key = None

    def finish() -> list[tuple]:
        cost, audits = fold.result()
        out = [(key, s, None, None, p, a) for s, (p, a) in zip(segs, audits, strict=True)]
        return [*out, (key, -1, cost, illegal, 0, "".join(a for _, a in audits))]

    for b in batches:
        out: list[tuple] = []
        for k, seg, codes, parts in zip(b["key"], b["seg"], b["codes"], b["parts"], strict=True):
            if k != key:
                out += finish() if key is not None else []
                key, fold, segs, illegal, before = k, Fold(), [], 0, ""
            initials = before + codes.translate(str.maketrans(GONE[1], GONE[0])).lower()
            illegal += sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))
            before = initials[-1:]
            fold.add(parts)
            segs.append(seg)
        yield _planned(out)
    if key is not None:
        yield _planned(finish())


def _planned(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "seg", "cost", "illegal", "state", "audit"])
    return out.astype({"seg": "int64", "cost": "Int64", "illegal": "Int64", "state": "int32"})


def repair_plan(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """The edits of every segment of placed ``rows``, and (seg -1) cost, illegal pairs and audit of every conversation."""
    segs = codes.groupBy("key", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c")).select(
        "key", "seg", F.expr("array_join(transform(c, x -> x.code), '')").alias("codes"))
    segs = segs.mapInPandas(_solve_segments, "key string, seg long, codes string, parts string")
    return cut_lineage(segs.repartition("key").sortWithinPartitions("key", "seg").mapInPandas(_fold_conversations, PLAN))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str, list[tuple[str, str]]]]]:
    """Per batch, (key, repaired turns) of sorted rows: a segment's edits (``pos`` -1) come before its rows."""
    key, state, todo, at = None, 0, [""], 0
    for b in batches:
        out = []
        for k, pos, entry, audit, role, text in zip(*(b[c] for c in ("key", "pos", "state", "audit", "role", "text")), strict=True):
            if pos < 0:
                if key is not None:
                    out.append((key, repaired(state, todo[-1], "", "")[1]))
                key, state, todo, at = k, int(entry), pieces(audit), 0
            else:
                state, turns = repaired(state, todo[at], role, text)
                out.append((key, turns))
                at += 1
        yield out
    if key is not None:
        yield [(key, repaired(state, todo[-1], "", "")[1])]


def _stream(rows: DataFrame, plan: DataFrame) -> DataFrame:
    edits = plan.where("seg >= 0").select("key", "seg", F.lit(-1).cast("long").alias("pos"), "state", "audit",
                                          F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turns = rows.select("key", "seg", "pos", F.lit(0).alias("state"), F.lit("").alias("audit"), "role", "text")
    return edits.unionByName(turns).repartition("key").sortWithinPartitions("key", "seg", "pos")


def repaired_turns(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, place, role, text): the repaired conversations."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, place = None, 0
        for found in _walk(batches):
            out = []
            for k, turns in found:
                if k != key:
                    key, place = k, 0
                out += [(k, place + i, *t) for i, t in enumerate(turns)]
                place += len(turns)
            yield pd.DataFrame(out, columns=["key", "place", "role", "text"])

    return _stream(rows, plan).mapInPandas(run, "key string, place long, role string, text string")


def repaired_hashes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, repaired_sha256): hashes of the repaired ``role:text`` lines."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, said_any = None, None, False
        for found in _walk(batches):
            out = []
            for k, turns in found:
                if k != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest, said_any = k, hashlib.sha256(), False
                for role, text in turns:
                    digest.update(f"{chr(10) * said_any}{role}:{text}".encode())
                    said_any = True
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "repaired_sha256"])

    return _stream(rows, plan).mapInPandas(run, "key string, repaired_sha256 string")


def repair_report(rows: DataFrame, ids: DataFrame, conv: str = "conv_id", **columns: str) -> DataFrame:
    """Per different id of ``ids`` (its column ``conv``): gaps, blank, duplicate, truncated, illegal, cost, audit and
    the repaired conversation's hash, for the conversations in ``rows``."""
    rows = placed(rows, conv, **columns)
    codes = cut_lineage(coded(rows))
    plan = repair_plan(rows, codes)
    counts = codes.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    whole = plan.where("seg < 0").select("key", "illegal", "cost", "audit")
    out = ids.select(conv, conversation_key(conv).alias("key")).distinct()
    for part in (counts, whole, repaired_hashes(rows, plan)):
        out = out.join(part, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(conv, *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
