"""Classifier parity: Spark ``rlike`` in ``(?dU)^(?:...)`` form against
Python ``re.match`` on generated strings (SURVEY 5, level t5)."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kvlens.functions import classify as C
from kvlens.functions import patterns as P
from kvlens.functions.pyre import match

WORDS = ("when what which how many year years in the of 1998 12th may june 5:30 pm between and after before "
         "last first rank place who team club country money $ % 23 olympic night fiscal 2001 since now, "
         "difference time more than is was did or not yes no true/false 6/6/2020 1789's winter").split()


def _strings(n=1500, seed=7):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(1, 9)
        s = " ".join(rnd.choice(WORDS) for _ in range(k))
        if rnd.random() < 0.1:
            s += "\nsecond line year 1999"
        out.append(s)
    return out


PATTERNS = {
    "explicit": "|".join(P.EXPLICIT_PATTERNS),
    "temporal_answer": "|".join(P.TEMPORAL_ANSWER_PATTERNS),
    "is_temporal_q": C.IS_TEMPORAL_QUESTION,
    "is_temporal_a": C.IS_TEMPORAL_ANSWER,
    "place": P.PLACE_QUESTION,
    "organization": P.ORGANIZATION_QUESTION,
    "ordinal_date": P.ORDINAL_DATE,
    "rank_suffix": P.RANK_SUFFIX,
}


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_rlike_matches_python_re(spark, name):
    pat = PATTERNS[name]
    texts = _strings()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(match(F.col("t"), pat)).collect()]
    want = [re.match(pat, t) is not None for t in texts]
    assert got == want


def test_keyword_rewrite_equals_anchored_form(spark):
    texts = _strings()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words, fn, lower in [(P.MAX_WORDS, C.max_operator, True), (P.BEFORE_WORDS, C.before_related, False),
                             (P.DURATION_WORDS, C.duration_related, False)]:
        got = [r[0] for r in df.select(fn(F.col("t"))).collect()]
        rx = r".*((" + ")|(".join(words) + ")).*"
        want = []
        for t in texts:
            q = t.lower() if lower else t
            hit = re.match(rx, q) is not None
            if fn is C.duration_related:
                hit = hit or (re.match(".*last.*", q) is not None and re.match(".* last .*", q) is None) or \
                    re.match(".*how many ((total|active|more|calendar) )?(year|day|season|month|decade|week|hour|century).*", q) is not None
            want.append(hit)
        assert got == want, fn.__name__


def test_answer_type_examples(spark):
    rows = [("is it open?", "yes"), ("when was it built?", "5 may 1990"), ("how many goals?", "3"),
            ("how old was he?", "40"), ("what was the budget?", "$5"), ("what percent won?", "5%"),
            ("which country hosted?", "peru"), ("who won?", "bob"), ("which team won?", "reds"),
            ("what color is it?", "red"), ("what is the name?", "bob")]
    df = spark.createDataFrame(rows, "q string, a string")
    got = [r[0] for r in df.select(C.answer_type(F.col("q"), F.col("a"))).collect()]
    assert got == ["YES/NO", "TEMPORAL", "COUNT", "AGE", "MONEY", "PERCENTAGE", "PLACE", "PERSON",
                   "ORGANIZATION", "PRODUCT", "UNKNOWN"]


@pytest.mark.parametrize("staged, pattern", [(C.temporal_question, C.IS_TEMPORAL_QUESTION),
                                             (C.temporal_question_answer, C.IS_TEMPORAL_ANSWER)])
def test_staged_temporal_pattern_equals_the_whole_one(spark, staged, pattern):
    extra = "date Mar may, came released first album monday Friday midnight before at noon? 3:30 2pm \u0663 1999-present fiscal now".split()
    rnd = random.Random(11)
    texts = _strings(3000, seed=9) + [" ".join(rnd.choice(extra) for _ in range(rnd.randint(0, 6))) for _ in range(3000)] + ["", "\n1999"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", staged(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [re.match(pattern, r.t) is not None for r in rows]


def test_plain_words_need_no_pattern():
    """month and day names are searched as words; patterns run only on texts that hold what they need."""
    for fn in (C.temporal_question, C.temporal_question_answer):
        assert "ovember).*" not in str(fn(F.col("q"))._jc.toString()).replace(P.IT_DATE10, "")
    assert "yesterday|" not in C.is_temporal(F.col("q"), F.lit(""))._jc.toString()
