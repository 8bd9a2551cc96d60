"""Question / answer classifiers C1-C22 as native boolean Columns.

All reference tests are ``re.match`` (anchored at the start, ``.`` stops at a
newline).  Pure keyword tests ``^.*(a|b).*`` are rewritten as an unanchored
search on the first line, which is equal (the keywords hold no ``\\s``) and
avoids backtracking over long texts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .pyre import first_line, keyword_alt, match, search
from .text import number_words_12


def _kw(col: Column, words, lower: bool) -> Column:
    # lower-casing only the first line is equal (it never adds or drops '\n')
    # and skips the rest of a long document
    line = first_line(col)
    line = F.lower(line) if lower else line
    alt = "|".join(w if ".*" in w else keyword_alt([w]) for w in words)
    return line.rlike("(?U)" + alt)


# Operator keywords (question lower-cased)
def max_operator(q: Column) -> Column:
    return _kw(q, P.MAX_WORDS, True)


def min_operator(q: Column) -> Column:
    return _kw(q, P.MIN_WORDS, True)


def count_operator(q: Column) -> Column:
    return _kw(q, P.COUNT_WORDS, True)


def sum_operator(q: Column) -> Column:
    return _kw(q, P.SUM_WORDS, True)


def difference_operator(q: Column) -> Column:
    return _kw(q, P.DIFF_WORDS, True)


def average_operator(q: Column) -> Column:
    return _kw(q, P.AVG_WORDS, True)


def comparison_operator(q: Column) -> Column:
    return _kw(q, P.COMPARE_WORDS, True)


# C8
def yes_no(q: Column, a: Column) -> Column:
    """Yes/no question: wording, or a date shape / auxiliary verb opening
    without an ``or`` choice (unless ``or not``), or a yes/no answer."""
    q = F.lower(q)
    a = F.lower(a)
    shapes = "|".join(f"(in {s} )?{P.YES_NO_VERBS}" for s in P.YES_NO_SHAPES)
    wording = match(q, P.YES_NO_WORDING)
    opening = match(q, shapes)
    choice = match(q, P.YES_NO_CHOICE)
    or_not = match(q, P.YES_NO_OR_NOT)
    return wording | (opening & (~choice | or_not)) | a.isin(*P.YES_NO_ANSWERS)


# Not lower-cased in the reference
def before_related(q: Column) -> Column:
    return _kw(q, P.BEFORE_WORDS, False)


def after_related(q: Column) -> Column:
    return _kw(q, P.AFTER_WORDS, False)


def duration_related(q: Column) -> Column:
    line = first_line(q)
    last_alone = line.contains("last") & ~line.contains(" last ")
    how_many = line.rlike(
        "(?U)how many ((total|active|more|calendar) )?(year|day|season|month|decade|week|hour|century)")
    return _kw(q, P.DURATION_WORDS, False) | last_alone | how_many


# C12 / C13
def explicit(q: Column) -> Column:
    return match(q, "|".join(P.EXPLICIT_PATTERNS))


def implicit(q: Column) -> Column:
    return ~explicit(q)


# C14
def ordinal(q: Column) -> Column:
    digit = match(q, P.ORDINAL_DIGIT) & ~(match(q, P.ORDINAL_DATE) | match(q, P.ORDINAL_MONTH))
    return digit | _kw(q, P.ORDINAL_WORDS, False) | match(q, P.ORDINAL_RANK)


# Answer types (callers pass lower-cased text)
def temporal_answer(q: Column, a: Column) -> Column:
    return (
        match(a, "|".join(P.TEMPORAL_ANSWER_PATTERNS))
        | match(q, P.TA_QUESTION_YEAR)
        | (match(a, P.TA_YEAR) & match(q, P.TA_QUESTION_WHEN))
        | match(q, P.TA_QUESTION_SOON)
    )


def count_answer(q: Column, a: Column) -> Column:
    return match(q, P.COUNT_HOW_MANY) | (match(q, P.COUNT_NUMBER_OF) & match(a, P.ANY_DIGIT))


def age_cardinal_answer(q: Column, a: Column) -> Column:
    return match(q, P.AGE_QUESTION) | match(q, P.AGE_SUFFIX)


def money_answer(q: Column, a: Column) -> Column:
    return (
        match(a, P.MONEY_SYMBOL)
        | (match(a, P.MONEY_MAGNITUDE) & match(q, P.MONEY_TOPIC))
        | match(q, P.MONEY_QUESTION)
    )


def percentage_answer(q: Column, a: Column) -> Column:
    return match(q, P.PERCENT_QUESTION) | match(a, P.PERCENT_ANSWER)


def rank_answer(q: Column, a: Column) -> Column:
    return (
        (match(q, P.RANK_WHERE) & match(q, P.RANK_WORD))
        | match(q, P.RANK_WHAT)
        | match(a, P.RANK_SUFFIX)
        | match(a, P.RANK_PLACE)
    )


def bound(q: Column, a: Column, fn) -> Column:
    """``fn(q, a)`` with both texts computed once a row: a lambda binds their
    values, while the optimizer would state them anew in each of many tests."""
    pair = F.array(F.struct(q.alias("q"), a.alias("a")))
    return F.element_at(F.transform(pair, lambda x: fn(x["q"], x["a"])), 1)


# C20
def _alt_group(words) -> str:
    return "((" + ")|(".join(words) + "))"


_PROPER_YEAR = r".*\d{4} " + _alt_group(P.IT_PROPER_NOUNS) + ".*"
# IT_MONTHS, IT_DAYS and ".*year.*" search for plain words, so no pattern is needed
_MONTH_NAMES = [x + m[1:] for m in ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december") for x in (m[0], m[0].upper())]
_DAY_NAMES = [x + d[1:] for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday") for x in (d[0], d[0].upper())]
_NAME_TAILS = ["anuary", "ebruary", "arch", "pril", "ay", "une", "uly", "ugust", "eptember", "ctober", "ovember", "ecember", "year"]  # and every day ends in "ay"
_UNITS = ["time", "decade", "season", "year", "week", "month", "hour", "century", "second", "minute", "day"]
# alternatives of the question pattern that cannot match a text without four digits in a row,
_YEAR_QUESTION = [P.IT_FINANCIAL, _PROPER_YEAR, P.IT_DATE1, P.IT_DATE3, P.IT_DATE4, P.IT_DATE7, P.IT_DATE9, P.IT_DATE13, P.IT_DATE15, P.IT_DATE17, P.IT_DATE18]
# without a digit and one of some words,
_DIGIT_QUESTION = [
    ([":"], [P.TIME_PATTERN]),
    (["/", "-"], [P.IT_DATE0]),
    (_NAME_TAILS, [P.IT_DATE2, P.IT_DATE8]),
    (_UNITS, [P.IT_DATE5, P.IT_DATE6]),
    ([""], [P.IT_DATE11]),
    (["winter", "spring", "summer", "autumn"], [P.IT_DATE12]),
    (["pm", "am"], [P.IT_DATE16]),
]
# and without one of some words
_TIMES_OF_DAY = r".*(before|after|at|of|since|as early as|through|until|this|for)( the)? " + _alt_group(P.IT_TIMES_OF_DAY) + r"( |,|\?).*"
_WORD_QUESTION = [
    (P.IT_TIMES_OF_DAY, [_TIMES_OF_DAY]),
    (["now"], [P.IT_KEYWORD_TIME[1]]),
    (["came", "released"], [P.IT_ALBUM]),
    (_UNITS, [P.TIME_KEYWORD0, P.TIME_KEYWORD1, P.IT_YEAR0, P.IT_YEAR1, P.IT_YEAR2]),
]
# IT_DATE10 starts with a digit or "date"
IS_TEMPORAL_QUESTION = "|".join([*_YEAR_QUESTION, *[p for _, ps in [*_DIGIT_QUESTION, *_WORD_QUESTION] for p in ps], P.IT_MONTHS, P.IT_DAYS, P.IT_KEYWORD_TIME[0], P.IT_DATE10])
_YEAR_ANSWER = [_PROPER_YEAR, P.IT_DATE4, P.IT_DATE18]
_DIGIT_ANSWER = _DIGIT_QUESTION[:-1]
IS_TEMPORAL_ANSWER = "|".join([*_YEAR_ANSWER, *[p for _, ps in _DIGIT_ANSWER for p in ps], P.IT_MONTHS, P.IT_DATE10])


def _any_of(col: Column, words) -> Column:
    return reduce(or_, [col.contains(w) for w in words])


def _staged(col: Column, year, digit, word, names) -> Column:
    """The alternatives, each tried only on texts that hold what it needs: a
    cheap search decides most texts, with the same outcome."""
    has_digit = search(col, r"\d")
    any_of = lambda found: reduce(or_, [_any_of(col, words) & match(col, "|".join(ps)) for words, ps in found], F.lit(False))
    return (
        (_any_of(col, _NAME_TAILS) & _any_of(first_line(col), names))
        | (has_digit & any_of(digit))
        | (has_digit & search(col, r"\d{4}") & match(col, "|".join(year)))
        | any_of(word)
        | ((has_digit | col.contains("date")) & match(col, P.IT_DATE10))
    )


def temporal_question(q: Column) -> Column:
    return _staged(q, _YEAR_QUESTION, _DIGIT_QUESTION, _WORD_QUESTION, [*_MONTH_NAMES, *_DAY_NAMES, "year"])


def temporal_question_answer(a: Column) -> Column:
    return _staged(a, _YEAR_ANSWER, _DIGIT_ANSWER, [], _MONTH_NAMES)


def is_temporal(q: Column, a: Column) -> Column:
    """C20: question keyword or pattern, else answer pattern, else (when/year
    question and a 4-digit answer); the cheap test comes first.  The caller applies N7."""
    return (
        _any_of(first_line(q), P.IT_KEYWORDS)  # plain words
        | temporal_question(q)
        | temporal_question_answer(a)
        | (match(q, "|".join(P.IT_ANSWER_QUESTION)) & match(a, P.IT_ANSWER_YEAR))
    )


# C21 / C22
def answer_type(question: Column, answer: Column) -> Column:
    """The first matching label of twelve, in the reference's order."""
    return bound(F.lower(question), number_words_12(F.lower(answer)), _label)


def _label(q: Column, a: Column) -> Column:
    return (
        F.when(yes_no(q, a), "YES/NO")
        .when(temporal_answer(q, a), "TEMPORAL")
        .when(count_answer(q, a), "COUNT")
        .when(age_cardinal_answer(q, a), "AGE")
        .when(money_answer(q, a), "MONEY")
        .when(percentage_answer(q, a), "PERCENTAGE")
        .when(rank_answer(q, a), "ORDINAL")
        .when(match(q, P.PLACE_QUESTION), "PLACE")
        .when(match(q, P.RANK_WHERE) & ~match(q, P.RANK_WORD), "PLACE")
        .when(match(q, P.PERSON_QUESTION), "PERSON")
        .when(match(q, P.ORGANIZATION_QUESTION), "ORGANIZATION")
        .when(match(q, P.PRODUCT_QUESTION), "PRODUCT")
        .otherwise("UNKNOWN")
    )


FLAG_FUNCTIONS = {
    "explicit": explicit,
    "implicit": implicit,
    "before_related": before_related,
    "after_related": after_related,
    "duration_related": duration_related,
    "max_operator": max_operator,
    "min_operator": min_operator,
    "count_operator": count_operator,
    "sum_operator": sum_operator,
    "difference_operator": difference_operator,
    "average_operator": average_operator,
    "comparison_operator": comparison_operator,
    "ordinal": ordinal,
}


def feature_columns(question: Column, answer: Column) -> dict[str, Column]:
    """13 flags on the raw question plus the answer type."""
    cols = {name: fn(question) for name, fn in FLAG_FUNCTIONS.items()}
    cols["answer_type"] = answer_type(question, answer)
    return cols
