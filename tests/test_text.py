"""Scalar functions: hand-derived values, quirks included."""

from conftest import one
from kvlens.functions import text as T


def test_clean_piece_and_join(spark):
    out = one(spark, T.clean_piece, ["a b  c :", " lead", "​", "x：", "\n\n"])
    assert out == ["a b c", " lead", "", "x", ""]
    joined = one(spark, T.join_pieces, [(["23", " (", "age", ""],)], "p array<string>")
    assert joined == ["23 |  ( | age"]


def test_ends_with_colon(spark):
    assert one(spark, T.ends_with_colon, ["Born: \n", "Born", None, "x：", "   "]) == [True, False, False, True, False]


def test_number_words_no_boundaries(spark):
    assert one(spark, T.number_words_10, ["money", "seven days"]) == ["m1y", "7 days"]
    assert one(spark, T.number_words_12, ["september"]) == ["septemberember"]


def test_gold_and_answer_normalisers(spark):
    assert one(spark, T.normalise_gold, ["23 years", "US$ 5.", "3rd", "at least4", "12 (approx)"]) == \
        ["23", " 5", "3", "4", "12"]
    assert one(spark, T.normalise_answer, ["23 year", "over 23 years", "12 (approx)"]) == ["23", "23", "12 (approx)"]


def test_align_to_gold(spark):
    rows = [("about 23 years", "23"), ("23, maybe", "23"), ("x (23)", "23"), ("2345", "23"), ("23-year", "23")]
    assert one(spark, T.align_to_gold, rows, "a string, g string") == ["23", "23", "23", "2345", "23"]


def test_parse_list_literal(spark):
    out = one(spark, T.parse_list_literal, ['["23", "23 year"]', "['a', 'b']", None, "oops"])
    assert out == [["23", "23 year"], ["a", "b"], [], []]


def test_number_name_to_int_sums(spark):
    assert one(spark, T.number_name_to_int, ["two hundred", "seven", "", "twenty one", "7 days"]) == \
        ["102", "7", "0", "21", "7 days"]


def test_time_canonical_quirk(spark):
    assert one(spark, T.time_canonical, ["5:30 pm", "17:30", "1995", "1895", "12:05 am", "no"]) == \
        ["17:30", "17:30", "01:95", "01:95", "00:05", "no"]
    assert one(spark, T.strict_time_canonical, ["1995", "5:30 pm"]) == ["1995", "17:30"]


def test_date_ddmm(spark):
    assert one(spark, T.date_ddmm, ["5 May", "May 05", "3rd of September 1999", "Sept 4", "none"]) == \
        ["05-05", "05-05", "03-09", "04-09", "none"]


def test_dates_to_iso_and_digits(spark):
    assert one(spark, T.dates_to_iso, ["on 5/6/2001 and 2001-06-05"]) == ["on 2001-06-05 and 2001-06-05"]
    assert one(spark, T.digit_runs, ["a12b3"]) == [["12", "3"]]
    assert one(spark, T.drop_word_dots, ["3.5 u.s."]) == ["35 us"]


def test_py_list_repr(spark):
    out = one(spark, T.py_list_repr, [(["a", "it's", 'say "x"', "b'\""],)], "p array<string>")
    assert out == [str(["a", "it's", 'say "x"', "b'\""])]
