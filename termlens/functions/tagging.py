"""Part-of-speech tags of a run of tokens, as one SQL expression.

A token's tag is decided together with its neighbours': every tag has a score
from the token's form (a word list, then its ending) and from the tag before it,
and a fold over the run keeps, per tag, the best path that ends there.  Scores are
whole numbers, ties go to the tag that stands first in ``TAGS``, so two engines
agree exactly.

The weights are this module's own small table for English.
"""

from __future__ import annotations

import functools

TAGS = "nvardt"               # noun, verb, adjective, adverb, determiner, to/auxiliary
RUN = 64                      # most tokens of a run

# ---- fixed values: word lists, endings and their scores ------------------------
FORMS = {
    "d": ("the", "a", "an", "this", "that", "these", "those", "each", "every", "some", "any", "no", "its", "their", "our", "his", "her"),
    "t": ("to", "will", "would", "can", "could", "may", "might", "must", "shall", "should", "do", "does", "did", "n't", "not"),
    "v": ("is", "are", "was", "were", "be", "been", "has", "have", "had"),
    "r": ("very", "too", "also", "often", "never", "always", "now", "then", "here", "there"),
}
FORM_SCORE = 20
BASE = {"n": 4, "v": 1, "a": 0, "r": -3, "d": -12, "t": -12}
# (ending, tag, score added); the longest ending that fits counts
ENDINGS = (("ing", "v", 4), ("ed", "v", 5), ("ly", "r", 9), ("ous", "a", 7), ("ful", "a", 7), ("able", "a", 7), ("ible", "a", 7),
           ("ive", "a", 5), ("ical", "a", 6), ("tion", "n", 4), ("ness", "n", 5), ("ment", "n", 4), ("ity", "n", 4), ("er", "n", 1),
           ("est", "a", 5), ("s", "v", 1))
# (tag, next tag): score
FOLLOWS = {"dn": 4, "da": 4, "dv": -5, "dt": -6, "tv": 6, "tn": -3, "ta": -2, "an": 4, "aa": 1, "av": -3, "nv": 2, "nt": 2, "nd": -1,
           "vd": 3, "vr": 2, "va": 2, "vv": -3, "rv": 2, "ra": 2, "rn": -2}
# Detachment rules by tag (ending, replacement).
RULES = {
    "n": (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")),
    "v": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "a": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
}
# --------------------------------------------------------------------------------


def _literal(s: str, dialect: str) -> str:
    quote = "''" if dialect == "duckdb" else "\\'"
    return "'" + s.replace("'", quote) + "'"


def scores_sql(w: str, dialect: str = "spark") -> str:
    """Array of the scores of the form ``w``, one for each tag of ``TAGS``."""
    ends = "suffix" if dialect == "duckdb" else "endswith"
    fit = sorted(ENDINGS, key=lambda e: -len(e[0]))

    def score(tag: str) -> str:
        listed = f"WHEN {w} IN ({', '.join(_literal(x, dialect) for x in FORMS[tag])}) THEN {FORM_SCORE} " if tag in FORMS else ""
        arms = " ".join(f"WHEN {ends}({w}, '{e}') THEN {BASE[tag] + (s if t == tag else 0)}" for e, t, s in fit)
        return f"CASE {listed}{arms} ELSE {BASE[tag]} END"

    items = ", ".join(score(t) for t in TAGS)
    return f"[{items}]" if dialect == "duckdb" else f"array({items})"


def tags_sql(run: str, dialect: str = "spark") -> str:
    """The tags (one letter a token) of the array ``run`` of one form or more."""
    n = len(TAGS)
    follow = [FOLLOWS.get(p + t, 0) for p in TAGS for t in TAGS]
    if dialect == "duckdb":
        scores = f"list_transform({run}, lambda w: {scores_sql('w', dialect)})"
        start = "[" + ", ".join(f"{{'s': sc[1][{p + 1}], 'k': 0, 'path': '{t}'}}" for p, t in enumerate(TAGS)) + "]"
        first = f"{{'e': CAST(NULL AS INTEGER[]), 'acc': {start}}}"
        options = ", ".join(f"{{'s': a[{p + 1}].s + ({follow})[{p * n} + t + 1], 'k': -{p}, 'path': a[{p + 1}].path}}" for p in range(n))
        step = (f"list_transform([0, 1, 2, 3, 4, 5], lambda t: list_transform([list_sort([{options}], 'DESC')[1]], lambda b:"
                f" {{'s': b.s + e[t + 1], 'k': 0, 'path': b.path || '{TAGS}'[t + 1]}})[1])")
        step = f"list_transform([x.acc], lambda a: list_transform([y.e], lambda e: {step})[1])[1]"
        items = "list_transform(sc[2:], lambda z: {'e': z, 'acc': CAST(NULL AS STRUCT(s INTEGER, k INTEGER, path VARCHAR)[])})"
        fold = f"list_reduce([{first}] || {items}, lambda x, y: struct_update(y, acc := {step})).acc"
        fold = f"list_transform([{scores}], lambda sc: {fold})[1]"
        final = ", ".join(f"{{'s': a[{p + 1}].s, 'k': -{p}, 'path': a[{p + 1}].path}}" for p in range(n))
        return f"list_transform([{fold}], lambda a: list_sort([{final}], 'DESC')[1].path)[1]"
    # The fold's table is fixed, so the scores relative to the best can take few values: each combination is a state,
    # found once by walking from all first forms, and a token costs two look-ups.
    ending, vectors, following, before, final = automaton()
    kind = f"transform({run}, w -> {kind_sql('w', ending, vectors)})"
    table, back, last = (f"array({', '.join(map(str, x))})" for x in (following, before, final))
    states = f"aggregate({kind}, array(0), (a, e) -> array_append(a, {table}[element_at(a, -1) * {len(vectors)} + e]))"
    letter = f"substr('{TAGS}', {{}} + 1, 1)"
    end = f"{last}[element_at(f, -1)]"
    earlier = f"{back}[p * {n} + x.t]"
    step = f"struct({earlier} AS t, concat({letter.format(earlier)}, x.path) AS path)"
    path = (f"aggregate(reverse(slice(f, 2, size(f) - 2)), struct({end} AS t, {letter.format(end)} AS path),"
            f" (x, p) -> {step}, x -> x.path)")
    return f"transform(array({states}), f -> {path})[0]"


def form_scores(form: str) -> tuple[int, ...]:
    """Scores of a form, one for each tag of ``TAGS``."""
    fit = max((e for e in ENDINGS if form.endswith(e[0])), key=lambda e: len(e[0]), default=("", "", 0))
    return tuple(FORM_SCORE if form in FORMS.get(t, ()) else BASE[t] + (fit[2] if fit[1] == t else 0) for t in TAGS)


def kind_sql(w: str, ending: dict[str, int], vectors: list[tuple[int, ...]]) -> str:
    """Number of the scores (of ``vectors``) of the form ``w``."""
    forms: dict[int, list[str]] = {}
    for f in sorted({f for words in FORMS.values() for f in words}):
        forms.setdefault(vectors.index(form_scores(f)), []).append(f)
    listed = [_literal(f, "spark") for words in forms.values() for f in words]
    arms = " ".join(f"WHEN {w} IN ({', '.join(_literal(f, 'spark') for f in words)}) THEN {k}" for k, words in forms.items())
    by_letter: dict[str, list[str]] = {}
    for e in sorted((e for e in ending if e), key=lambda e: -len(e)):
        by_letter.setdefault(e[-1], []).append(f"WHEN endswith({w}, '{e}') THEN {ending[e]}")
    ends = " ".join(f"WHEN endswith({w}, '{c}') THEN (CASE {' '.join(a)} ELSE {ending['']} END)" for c, a in by_letter.items())
    return f"CASE WHEN {w} IN ({', '.join(listed)}) THEN (CASE {arms} END) {ends} ELSE {ending['']} END"


@functools.lru_cache(maxsize=1)
def automaton() -> tuple[dict[str, int], list[tuple[int, ...]], list[int], list[int], list[int]]:
    """(kind of each ending, scores of each kind, next state by state and kind, tag before by state and tag, best tag of
    each state); state 0 is before the first form."""
    tags = range(len(TAGS))
    ending = {e: form_scores(e) for e in ["", *(e for e, _, _ in ENDINGS)]}
    forms = {form_scores(f) for words in FORMS.values() for f in words}
    vectors = sorted({*ending.values(), *forms})
    follow = [[FOLLOWS.get(p + t, 0) for t in TAGS] for p in TAGS]
    known: dict[tuple[int, ...], int] = {(): 0}
    order: list[tuple[int, ...]] = [()]
    following, before, final = [], [], []
    for state in order:                                   # grows while it is walked
        best = [max(tags, key=lambda p: (state[p] + follow[p][t], -p)) if state else 0 for t in tags]
        for scores in vectors:
            reached = [scores[t] + (state[best[t]] + follow[best[t]][t] if state else 0) for t in tags]
            now = tuple(s - max(reached) for s in reached)
            if now not in known:
                known[now] = len(order)
                order.append(now)
            following.append(known[now])
        before += best
        final.append(max(tags, key=lambda p: (state[p], -p)) if state else 0)
    return {e: vectors.index(v) for e, v in ending.items()}, vectors, following, before, final


def candidates_sql(word: str, tag: str, dialect: str = "spark") -> str:
    """Array of the detachment candidates of a word with a tag."""
    ends = "suffix" if dialect == "duckdb" else "endswith"
    arms = [f"CASE WHEN {tag} = '{t}' AND {ends}({word}, '{e}') AND length({word}) > {len(e) + 1}"
            f" THEN concat(substr({word}, 1, length({word}) - {len(e)}), '{r}') END" for t, rules in RULES.items() for e, r in rules]
    if dialect == "duckdb":
        return f"list_filter(list_distinct([{', '.join(arms)}]), lambda c: c IS NOT NULL)"
    return f"array_compact(array_distinct(array({', '.join(arms)})))"
