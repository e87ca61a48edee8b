"""Porter (1980) suffix-stripping stemmer as a SQL column expression.

The rules of M. F. Porter, "An algorithm for suffix stripping", Program 14(3),
1980, are kept as data below and rendered to one SQL expression, either for
Spark SQL (Java regex) or for DuckDB (RE2), so the Spark job and its oracle
run the same rules with no Python UDF.  Each step binds its input once through
a one-element array + lambda, which keeps the expression linear in the number
of steps.

Letter classes: a ``y`` that starts the word or follows a vowel is a consonant;
it is marked ``Y`` first, so the vowel class is ``[aeiouy]`` and every other
character (``Y`` included) is a consonant.  The marks are lowered at the end.
Within a step the longest matching suffix decides; when its condition fails no
shorter suffix of the step is tried.  Words of one or two letters are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

V = "[aeiouy]"
C = "[^aeiouy]"
# ---- fixed values: Porter (1980) rule table ---------------------------------
# (suffix, replacement, condition on the stem)
STEP1A = (("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None))
STEP2 = (
    ("ational", "ate", "m>0"), ("tional", "tion", "m>0"), ("enci", "ence", "m>0"),
    ("anci", "ance", "m>0"), ("izer", "ize", "m>0"), ("abli", "able", "m>0"),
    ("alli", "al", "m>0"), ("entli", "ent", "m>0"), ("eli", "e", "m>0"),
    ("ousli", "ous", "m>0"), ("ization", "ize", "m>0"), ("ation", "ate", "m>0"),
    ("ator", "ate", "m>0"), ("alism", "al", "m>0"), ("iveness", "ive", "m>0"),
    ("fulness", "ful", "m>0"), ("ousness", "ous", "m>0"), ("aliti", "al", "m>0"),
    ("iviti", "ive", "m>0"), ("biliti", "ble", "m>0"),
)
STEP3 = (
    ("icate", "ic", "m>0"), ("ative", "", "m>0"), ("alize", "al", "m>0"),
    ("iciti", "ic", "m>0"), ("ical", "ic", "m>0"), ("ful", "", "m>0"), ("ness", "", "m>0"),
)
STEP4 = (
    ("al", "", "m>1"), ("ance", "", "m>1"), ("ence", "", "m>1"), ("er", "", "m>1"),
    ("ic", "", "m>1"), ("able", "", "m>1"), ("ible", "", "m>1"), ("ant", "", "m>1"),
    ("ement", "", "m>1"), ("ment", "", "m>1"), ("ent", "", "m>1"), ("ion", "", "m>1 st"),
    ("ou", "", "m>1"), ("ism", "", "m>1"), ("ate", "", "m>1"), ("iti", "", "m>1"),
    ("ous", "", "m>1"), ("ive", "", "m>1"), ("ize", "", "m>1"),
)
DOUBLE_CONSONANTS = ("bb", "cc", "dd", "ff", "gg", "hh", "jj", "kk", "ll", "mm", "nn", "pp",
                     "qq", "rr", "ss", "tt", "vv", "ww", "xx", "zz")
# ------------------------------------------------------------------------------

# last letters of all suffixes: of the tables, of ed, ing and y, and of step 5
LAST_LETTERS = "".join(sorted({r[0][-1] for r in STEP1A + STEP2 + STEP3 + STEP4} | set("dgyYel")))
M_GT0 = "^" + C + "*" + V + "+" + C
M_GT1 = "^" + C + "*" + V + "+" + C + "+" + V + "+" + C
HAS_VOWEL = V
ENDS_DOUBLE = "(" + "|".join(DOUBLE_CONSONANTS) + ")$"
ENDS_CVC = C + V + "[^aeiouwxyY]$"


class _Dialect:
    def __init__(self, name: str):
        self.name = name

    def match(self, s: str, pattern: str) -> str:
        if self.name == "spark":
            return f"({s} RLIKE '{pattern}')"
        return f"regexp_matches({s}, '{pattern}')"

    def sub(self, s: str, pattern: str, repl: str) -> str:
        if self.name == "spark":
            return f"regexp_replace({s}, '{pattern}', '{repl.replace(chr(92) + '1', '$1')}')"
        return f"regexp_replace({s}, '{pattern}', '{repl}', 'g')"

    def bind(self, value: str, var: str, body: str) -> str:
        if self.name == "spark":
            return f"transform(array({value}), {var} -> {body})[0]"
        return f"list_transform([{value}], lambda {var}: {body})[1]"


def _stem(w: str, k: int) -> str:
    return f"substr({w}, 1, length({w}) - {k})" if k else w


def _cond(d: _Dialect, s: str, cond: str | None) -> str:
    if cond is None:
        return "TRUE"
    if cond == "m>0":
        return d.match(s, M_GT0)
    if cond == "m>1":
        return d.match(s, M_GT1)
    if cond == "m>1 st":
        return f"({d.match(s, M_GT1)} AND ({s} LIKE '%s' OR {s} LIKE '%t'))"
    raise ValueError(cond)


def _rule_step(d: _Dialect, w: str, rules) -> str:
    """Longest suffix first; its condition decides, shorter ones are not tried."""
    arms = {}
    for suf, rep, cond in sorted(rules, key=lambda r: -len(r[0])):
        s = _stem(w, len(suf))
        new = f"concat({s}, '{rep}')" if rep else s
        arms.setdefault(suf[-1] if d.name == "spark" else "", []).append(
            f"WHEN {w} LIKE '%{suf}' THEN (CASE WHEN {_cond(d, s, cond)} THEN {new} ELSE {w} END)")
    by_letter = {k: "CASE " + " ".join(a) + f" ELSE {w} END" for k, a in arms.items()}
    if d.name != "spark":
        return by_letter[""]
    # only suffixes with the word's last letter are tried
    return "CASE " + " ".join(f"WHEN {w} LIKE '%{k}' THEN ({a})" for k, a in by_letter.items()) + f" ELSE {w} END"


def _step1b(d: _Dialect, w: str) -> str:
    def tidy(s: str) -> str:
        return (f"(CASE WHEN {s} LIKE '%at' OR {s} LIKE '%bl' OR {s} LIKE '%iz' THEN concat({s}, 'e')"
                f" WHEN {d.match(s, ENDS_DOUBLE)} AND NOT ({s} LIKE '%l' OR {s} LIKE '%s' OR {s} LIKE '%z')"
                f" THEN substr({s}, 1, length({s}) - 1)"
                f" WHEN {d.match(s, M_GT0)} AND NOT {d.match(s, M_GT1)} AND {d.match(s, ENDS_CVC)}"
                f" THEN concat({s}, 'e') ELSE {s} END)")

    eed, ed, ing = _stem(w, 3), _stem(w, 2), _stem(w, 3)
    return (f"CASE WHEN {w} LIKE '%eed' THEN (CASE WHEN {d.match(eed, M_GT0)} THEN concat({eed}, 'ee') ELSE {w} END)"
            f" WHEN {w} LIKE '%ed' THEN (CASE WHEN {d.match(ed, HAS_VOWEL)} THEN {tidy(ed)} ELSE {w} END)"
            f" WHEN {w} LIKE '%ing' THEN (CASE WHEN {d.match(ing, HAS_VOWEL)} THEN {tidy(ing)} ELSE {w} END)"
            f" ELSE {w} END")


def _step1c(d: _Dialect, w: str) -> str:
    s = _stem(w, 1)
    return (f"CASE WHEN ({w} LIKE '%y' OR {w} LIKE '%Y') AND {d.match(s, HAS_VOWEL)}"
            f" THEN concat({s}, 'i') ELSE {w} END")


def _step5(d: _Dialect, w: str) -> str:
    s = _stem(w, 1)
    step5a = (f"CASE WHEN {w} LIKE '%e' AND ({d.match(s, M_GT1)} OR ({d.match(s, M_GT0)}"
              f" AND NOT {d.match(s, ENDS_CVC)})) THEN {s} ELSE {w} END")
    return step5a


def _step5b(d: _Dialect, w: str) -> str:
    return (f"CASE WHEN {w} LIKE '%ll' AND {d.match(w, M_GT1)} THEN substr({w}, 1, length({w}) - 1)"
            f" ELSE {w} END")


def porter_sql(word_sql: str, dialect: str = "spark") -> str:
    """SQL expression stemming ``word_sql`` (lower-case letters)."""
    d = _Dialect(dialect)
    x = d.sub(d.sub(word_sql, "^y", "Y"), "([aeiouy])y", "\\1Y")
    if dialect == "spark":
        x = f"CASE WHEN contains({word_sql}, 'y') THEN {x} ELSE {word_sql} END"
    steps = (
        lambda w: _rule_step(d, w, STEP1A),
        lambda w: _step1b(d, w),
        lambda w: _step1c(d, w),
        lambda w: _rule_step(d, w, STEP2),
        lambda w: _rule_step(d, w, STEP3),
        lambda w: _rule_step(d, w, STEP4),
        lambda w: _step5(d, w),
        lambda w: _step5b(d, w),
    )
    for i, step in enumerate(steps):
        var = f"pw{i}"
        x = d.bind(x, var, step(var))
    # no step changes a word with another last letter
    other = (f" WHEN NOT substr({word_sql}, -1) IN ({', '.join(repr(c) for c in LAST_LETTERS)}) THEN lower({word_sql})"
             if dialect == "spark" else "")
    return f"CASE WHEN length({word_sql}) <= 2 THEN {word_sql}{other} ELSE lower({x}) END"


def porter_stem(word: str) -> Column:
    """Porter stem of a lower-case word column (given by name)."""
    return F.expr(porter_sql(f"`{word}`"))
