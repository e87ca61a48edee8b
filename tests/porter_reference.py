"""Plain-Python Porter (1980) stemmer, written from the paper, used only as a
test oracle for the SQL rendering in termlens.functions.porter."""


def _cons(w, i):
    if w[i] in "aeiou":
        return False
    if w[i] == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(s):
    return _count_vc("".join("c" if _cons(s, i) else "v" for i in range(len(s))))


def _count_vc(forms):
    n, prev = 0, None
    for f in forms:
        if prev == "v" and f == "c":
            n += 1
        prev = f
    return n


def _vowel(s):
    return any(not _cons(s, i) for i in range(len(s)))


def _double(s):
    # a double consonant: the same letter twice, both consonants
    return len(s) >= 2 and s[-1] == s[-2] and _cons(s, len(s) - 1) and _cons(s, len(s) - 2)


def _cvc(s):
    return (len(s) >= 3 and _cons(s, len(s) - 3) and not _cons(s, len(s) - 2)
            and _cons(s, len(s) - 1) and s[-1] not in "wxy")


def _rules(w, rules):
    for suf, rep, cond in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suf):
            s = w[: len(w) - len(suf)]
            if cond(s):
                return s + rep
            return w
    return w


def stem(w):
    if len(w) <= 2:
        return w
    # 1a
    w = _rules(w, [("sses", "ss", lambda s: True), ("ies", "i", lambda s: True),
                   ("ss", "ss", lambda s: True), ("s", "", lambda s: True)])
    # 1b
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suf in ("ed", "ing"):
            if w.endswith(suf):
                s = w[: -len(suf)]
                if _vowel(s):
                    if s.endswith(("at", "bl", "iz")):
                        s += "e"
                    elif _double(s) and s[-1] not in "lsz":
                        s = s[:-1]
                    elif _m(s) == 1 and _cvc(s):
                        s += "e"
                    w = s
                break
    # 1c
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    m0 = lambda s: _m(s) > 0
    m1 = lambda s: _m(s) > 1
    w = _rules(w, [("ational", "ate", m0), ("tional", "tion", m0), ("enci", "ence", m0),
                   ("anci", "ance", m0), ("izer", "ize", m0), ("abli", "able", m0),
                   ("alli", "al", m0), ("entli", "ent", m0), ("eli", "e", m0),
                   ("ousli", "ous", m0), ("ization", "ize", m0), ("ation", "ate", m0),
                   ("ator", "ate", m0), ("alism", "al", m0), ("iveness", "ive", m0),
                   ("fulness", "ful", m0), ("ousness", "ous", m0), ("aliti", "al", m0),
                   ("iviti", "ive", m0), ("biliti", "ble", m0)])
    w = _rules(w, [("icate", "ic", m0), ("ative", "", m0), ("alize", "al", m0), ("iciti", "ic", m0),
                   ("ical", "ic", m0), ("ful", "", m0), ("ness", "", m0)])
    step4 = [(x, "", m1) for x in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement",
                                   "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")]
    step4.append(("ion", "", lambda s: m1(s) and s.endswith(("s", "t"))))
    w = _rules(w, step4)
    if w.endswith("e"):
        s = w[:-1]
        if _m(s) > 1 or (_m(s) == 1 and not _cvc(s)):
            w = s
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w
