"""Native stems, ROUGE and METEOR against the brute-force versions."""

import random

import pytest
from pyspark.sql import functions as F

import text_reference as R
from kvlens.functions import metrics as M
from kvlens.functions.stemming import STEP2, STEP3, STEP4, with_stem
from kvlens.operators import alignment as A
from kvlens.operators import scoring as S


def test_stems_equal_the_reference(spark):
    r = random.Random(1)
    roots = ["", "a", "y", "yy", "tr", "rel", "oper", "hop", "happ", "controll", "fil", "bi", "geo", "sens", "adjust", "see", "cry", "ayy", "lo", "all", "ém", "x9"]
    ends = [s for s, _ in STEP2 + STEP3] + STEP4 + ["s", "ies", "sses", "ss", "ed", "eed", "ied", "ing", "ating", "bled", "ized", "alli", "logi", "y", "e", "ll", "le", ""]
    words = {a + b + c for a in roots for b in ends for c in ("", "s", "ly", "ed", "ing", r.choice(ends))}
    words |= {"".join(r.choice("aeiouybcdlstwxz'") for _ in range(r.randint(1, 9))) for _ in range(3000)}
    words |= set(R._IRREGULAR)
    got = {x["word"]: x["stem"] for x in with_stem(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {w: s for w, s in got.items() if s != R._stem(w)} == {}
    assert len(got) == len(words)


def pairs(seed):
    r = random.Random(seed)
    words = ["run", "running", "runs", "the", "The", "cat", "cats", "a", "relational", "relate", "hope", "hopeful", "big", "large", "é", "end.", "x-y"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(say(r.randint(0, 14)), say(r.randint(0, 14))) for _ in range(150)]
    same = say(12)
    rows += [(same, same), ("", ""), (None, "nan"), (None, None), ("...", "!"), ("a", ""), (say(90), say(400)), (say(300), say(70))] + [("the cat", "cat the")] * 40
    return rows


def test_scores_equal_the_reference(spark):
    rows = pairs(5)
    df = spark.createDataFrame([(i, a, p, 0.5, "k") for i, (a, p) in enumerate(rows)], "i long, actual_answer string, predicted_answer string, word double, key string").repartition(4)
    got = {x["i"]: x for x in S.rouge_meteor(df.drop("key", "word")).collect()}
    assert len(got) == len(rows)
    for i, (a, p) in enumerate(rows):
        a, p = "nan" if a is None else a, "nan" if p is None else p
        r1, rl = R.rouge_1_l(p, a)
        want = (r1, rl, R.meteor(a, p))
        assert (got[i]["rouge1"], got[i]["rougeL"], got[i]["meteor"]) == pytest.approx(want, abs=1e-12), (a, p)


def test_synonyms_come_from_a_table(spark):
    rows = [("big cat big", "large cat big large"), ("large big", "large large"), ("hope", "big"), ("a big dog", "a large dog")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, actual_answer string, predicted_answer string")
    table = spark.createDataFrame([("big", "large"), ("large", "big"), ("hope", "wish")], "word string, synonym string")
    known = {"big": {"large"}, "large": {"big"}, "hope": {"wish"}}
    got = {x["i"]: x["meteor"] for x in S.rouge_meteor(df, synonyms=table).collect()}
    assert got == pytest.approx({i: R.meteor(a, p, synonyms=known) for i, (a, p) in enumerate(rows)})


def test_long_texts_end(spark):
    """10,000 tokens a side: linear state, no quadratic table."""
    r = random.Random(2)
    a, p = ([f"w{r.randint(0, 3000)}" for _ in range(10_000)] for _ in range(2))
    df = spark.createDataFrame([(" ".join(a), " ".join(p))], "actual_answer string, predicted_answer string")
    got = S.rouge_meteor(df).collect()[0]
    r1, rl = R.rouge_1_l(" ".join(p), " ".join(a))
    assert (got["rouge1"], got["rougeL"]) == pytest.approx((r1, rl))


def test_report_counts_every_row(spark):
    df = spark.createDataFrame([("g", "a b", "a b")] * 5 + [("g", "a", "b"), ("h", "", "")], "g string, actual_answer string, predicted_answer string")
    got = {x["g"]: (x["n"], x["rouge1"]) for x in S.text_report(df, ["g"]).collect()}
    assert got == {"g": (6, pytest.approx(5 / 6, abs=1e-6)), "h": (1, 0.0)}
    assert S.text_report(df.where("false"), ["g"]).collect() == []


def test_multiset_overlap(spark):
    from collections import Counter
    r = random.Random(3)
    rows = [([r.choice("abc#1") for _ in range(r.randint(0, 9))], [r.choice("abc#1") for _ in range(r.randint(0, 9))]) for _ in range(200)] + [(["a#1", "a"], ["a", "a#1", "a"]), (None, ["a"])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, a array<string>, b array<string>")
    got = {x["i"]: x["n"] for x in df.select("i", M.multiset_overlap(F.col("a"), F.col("b")).alias("n")).collect()}
    for i, (a, b) in enumerate(rows):
        assert got[i] == (None if a is None else sum((Counter(a) & Counter(b)).values()))


def test_only_places_move_by_key(spark):
    """what is matched and what is left is made from the places behind the exchange, and a key has 32 bytes."""
    df = spark.createDataFrame([("a b c", "a c b")], "a string, p string")
    assert len(df.select(A.pair_key("a", "p").alias("k")).first().k) == 32
    places = spark.createDataFrame([("k", "m", "w", [1], [2])], "key string, kind string, word string, h array<int>, r array<int>")
    stems = spark.createDataFrame([("w", "w")], "word string, stem string")
    plan = A._by_stem(places, stems)._jdf.queryExecution().analyzed().toString()
    assert "exact" not in plan[plan.index("RepartitionByExpression"):]
