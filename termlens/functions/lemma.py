"""Noun lemma candidates by suffix detachment (no dictionary needed).

WordNet is not available, so a word's lemma is the shortest candidate produced
by the standard English noun detachment rules that is itself a word of the
corpus vocabulary; with no such candidate the word is its own lemma.  The
vocabulary check is a join done by the caller (see
:func:`termlens.operators.cooccurrence.lemma_map`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: noun suffix detachment rules (suffix, replacement) -------
NOUN_RULES = (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
              ("shes", "sh"), ("men", "man"), ("ies", "y"))
# -----------------------------------------------------------------------------


def lemma_candidates(word: Column) -> Column:
    """Array of detachment candidates of ``word`` (possibly empty)."""
    cands = [F.when(word.endswith(suf) & (F.length(word) > len(suf)),
                    F.concat(word.substr(F.lit(1), F.length(word) - len(suf)), F.lit(rep)))
             for suf, rep in NOUN_RULES]
    return F.array_compact(F.array_distinct(F.array(*cands)))


def lemma_candidates_sql(word_sql: str) -> str:
    """DuckDB twin of :func:`lemma_candidates` (for the oracle)."""
    arms = ", ".join(
        f"CASE WHEN suffix({word_sql}, '{suf}') AND length({word_sql}) > {len(suf)}"
        f" THEN substr({word_sql}, 1, length({word_sql}) - {len(suf)}) || '{rep}' END"
        for suf, rep in NOUN_RULES)
    return f"list_filter(list_distinct([{arms}]), lambda c: c IS NOT NULL)"
