"""List literals (N15), Python's repr (N25) and votes inside a list (A8) against Python itself."""

import ast
import random

from pyspark.sql import functions as F

from kvlens.functions.text import parse_list_literal, py_list_repr, py_str_repr
from kvlens.operators import annotate as A

from conftest import one

STRINGS = ["", "a", "it's", 'say "hi"', "both ' and \"", "back\\slash", "a\nb\r\tc", "nb sp", "zw​", "\x00\x07\x1b\x7f", "­", "é ß", "日本", "\U0001f600", "\U000e0001", "[x], 'y'", " ", " lead ", "﻿"]


def test_repr_equals_python(spark):
    assert one(spark, py_str_repr, STRINGS) == [repr(s) for s in STRINGS]


def test_literals_equal_python(spark):
    r = random.Random(2)
    lists = [[r.choice(STRINGS) for _ in range(r.randint(0, 6))] for _ in range(100)]
    texts = [repr(x) for x in lists] + [ascii(x) for x in lists]
    assert one(spark, parse_list_literal, texts) == lists + lists
    assert one(spark, parse_list_literal, [r'["\ud83d\ude00", "\ud800", "\UFFFFFFFF"]']) == [["\U0001f600", r"\ud800", r"\UFFFFFFFF"]]
    odd = [r"['\x41é\U0001F600\101\q', " + '"\\\n"]', "[1, -2.5, None, True,]", "[ 'a' ,\n\"b\" ]", "[]", "[,]", "['a' 'b']", "['a'", "a", "", None, "['a']x", "[['a']]", "[" + "'x'," * 20_000 + "]", "['" + "\\n" * 30_000 + "']"]
    got = one(spark, parse_list_literal, odd)
    assert got[0] == ast.literal_eval(odd[0].replace(r"\q", r"\\q")) and got[1] == ["1", "-2.5", "None", "True"] and got[2] == ["a", "b"]
    assert got[3:12] == [[]] * 9 and len(got[12]) == 20_000 and got[13] == ["\n" * 30_000]


def test_rendering_and_parsing_are_inverse(spark):
    df = spark.createDataFrame([(STRINGS,), ([],)], "x array<string>")
    for x in df.select("x", parse_list_literal(py_list_repr(F.col("x"))).alias("y"), py_list_repr(F.col("x")).alias("t")).collect():
        assert x["y"] == x["x"] and x["t"] == str(list(x["x"]))


def test_votes_inside_a_list(spark):
    rows = [(1, "23 years", "['23', '23 year', '23 years']"), (2, "x", "['b', 'a', 'a', 'b']"), (3, "x", "[]"), (4, None, None), (5, "x", "['c', 'd']"), (6, "7th", "['7', 'seven', 'it was 7, or so']")]
    df = spark.createDataFrame([(*x, "w", 1) for x in rows], "i long, gold_answer string, answers string, answer string, at long")
    got = {x["i"]: (x["majority_answer"], x["score"], x["n_answers"]) for x in A.vote_lists(df).collect()}
    assert got == {1: ("23", 3, 3), 2: ("b", 2, 4), 3: ("", 1, 0), 4: ("", 1, 0), 5: ("c", 1, 2), 6: ("7", 3, 3)}
