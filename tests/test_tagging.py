"""Part-of-speech tags against every possible path; lemmas by tag."""
import itertools

from pyspark.sql import functions as F

from termlens.functions import tagging
from termlens.operators.tokens import clean_tokens_by_tag, tagged_tokens


def form_scores(w):
    out = []
    for t in tagging.TAGS:
        if w in tagging.FORMS.get(t, ()):
            out.append(tagging.FORM_SCORE)
            continue
        fit = max((e for e in tagging.ENDINGS if w.endswith(e[0])), key=lambda e: len(e[0]), default=("", "", 0))
        out.append(tagging.BASE[t] + (fit[2] if fit[1] == t else 0))
    return out


def best_score(words):
    scores = [form_scores(w) for w in words]
    return max(sum(s[tagging.TAGS.index(t)] for s, t in zip(scores, path, strict=True))
               + sum(tagging.FOLLOWS.get(a + b, 0) for a, b in itertools.pairwise(path)) for path in itertools.product(tagging.TAGS, repeat=len(words)))


def test_the_path_is_the_best(spark):
    runs = ["the running rivers", "to run quickly", "they walked the famous walks", "volcanic arcs rise", "it must be very active", "a"]
    df = spark.createDataFrame([(r.split(),) for r in runs], "words array<string>")
    for r in df.select("words", F.expr(tagging.tags_sql("words")).alias("tags")).collect():
        score = sum(form_scores(w)[tagging.TAGS.index(t)] for w, t in zip(r.words, r.tags, strict=True))
        score += sum(tagging.FOLLOWS.get(a + b, 0) for a, b in itertools.pairwise(r.tags))
        assert score == best_score(r.words), r


def test_a_tag_depends_on_its_neighbours(spark):
    docs = spark.createDataFrame([(1, "to walks. the walks."), (2, None), (3, ""), (4, "word " * 200)], "doc_id long, text string")
    got = [(r.id, r.word, r.tag) for r in tagged_tokens(docs).orderBy("id", "run", "i").collect()]
    assert [(w, t) for i, w, t in got if i == 1 and w == "walks"] == [("walks", "v"), ("walks", "n")]
    assert len([1 for i, _, _ in got if i == 4]) == 200


def test_lemmas_by_tag(spark):
    docs = spark.createDataFrame([(1, "to walks the women the woman."), (2, None), (3, "She walked to walking. httpdoc walk walke"),
                                  (4, "the saws to saws")], "doc_id long, text string")
    lemmas = spark.createDataFrame([("saws", "v", "see"), ("saws", "n", "saw"), ("she", None, "they")], "form string, pos string, lemma string")
    got = {r.doc_id: r.cleaned for r in clean_tokens_by_tag(docs, lemmas=lemmas).collect()}
    assert got[1] == "to walk the woman the woman ." and got[2] == "" and got[4] == "the saw to see"
    assert got[3].startswith("they walk to walk .") and "httpdoc" not in got[3]
