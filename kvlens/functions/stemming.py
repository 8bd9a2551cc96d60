"""The Porter stemmer (1980, with the common extension rules) as native columns.

It runs over a table of distinct words, in a few staged projections, and is
joined back to the texts (``stem_table``).  Consonants and vowels of a word are
written as a text of ``c`` and ``v``, so that a rule's condition on the stem is a
pattern on the first letters of that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the algorithm: irregular forms, and (suffix, replacement) by step; the first suffix that fits decides.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
             "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
             "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
         ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
         ("biliti", "ble"), ("fulli", "ful")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
         "iti", "ous", "ive", "ize"]
# On the c/v text: some vowel; measure above 0; above 1; consonant-vowel-consonant at the end.
VOWEL, M_ABOVE_0, M_ABOVE_1, CVC_END = "v", "vc", "vc+v+c", "cvc$"


def letters(word: Column) -> Column:
    """``c`` or ``v`` per character; ``y`` is a consonant at the start and after a vowel."""
    def add(so_far: Column, ch: Column) -> Column:
        y = F.when(so_far.endswith("v") | (so_far == ""), "c").otherwise("v")
        return F.concat(so_far, F.when(ch.isin(*"aeiou"), "v").when(ch == "y", y).otherwise("c"))

    return F.aggregate(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), F.lit(""), add)


def _cut(c: Column, n: int) -> Column:
    return F.left(c, F.length(c) - n)


def _last(c: Column, n: int = 1) -> Column:
    return F.right(c, F.lit(n))


def _double(w: Column, cv: Column) -> Column:
    return (F.length(w) >= 2) & (_last(w) == F.left(_last(w, 2), F.lit(1))) & cv.endswith("c")


def _cvc(w: Column, cv: Column) -> Column:
    return (cv.rlike(CVC_END) & ~_last(w).isin("w", "x", "y")) | (cv == "vc")


def _m1(cv: Column) -> Column:
    return cv.rlike(M_ABOVE_0) & ~cv.rlike(M_ABOVE_1)


def _first_rule(w: Column, cv: Column, rules, least: str) -> Column:
    out = None
    for suffix, repl in rules:
        new = F.when(_cut(cv, len(suffix)).rlike(least), F.concat(_cut(w, len(suffix)), F.lit(repl))).otherwise(w)
        out = F.when(w.endswith(suffix), new) if out is None else out.when(w.endswith(suffix), new)
    return out.otherwise(w)


def with_stem(words: DataFrame, word: str = "word") -> DataFrame:
    """``words`` (lower-case) with a column ``stem``."""
    w, cv, cut = F.col("__w"), F.col("__cv"), F.col("__cut")
    end = lambda *s: F.coalesce(*[F.when(w.endswith(x), True) for x in s], F.lit(False))
    df = words.withColumn("__w", F.col(word))
    # 1a: plurals
    df = df.withColumn("__w", F.when(end("ies") & (F.length(w) == 4), _cut(w, 1)).when(end("sses", "ies"), _cut(w, 2)).when(end("ss"), w).when(end("s"), _cut(w, 1)).otherwise(w))
    # 1b: -ed and -ing, with the letters mended after a cut
    df = df.withColumn("__cv", letters(w))
    df = df.withColumn("__cut", F.when(end("ied", "eed"), 0).when(end("ed") & _cut(cv, 2).contains(VOWEL), 2).when(end("ing") & _cut(cv, 3).contains(VOWEL), 3).otherwise(0))
    short = F.when(F.length(w) == 4, "ie").otherwise("i")
    df = df.withColumn("__w", F.when(end("ied"), F.concat(_cut(w, 3), short)).when(end("eed") & _cut(cv, 3).rlike(M_ABOVE_0), _cut(w, 1)).otherwise(F.left(w, F.length(w) - cut)))
    df = df.withColumn("__cv", F.left(cv, F.length(w)))
    mended = F.when(end("at", "bl", "iz"), F.concat(w, F.lit("e"))).when(_double(w, cv), F.when(_last(w).isin("l", "s", "z"), F.when(_m1(cv) & _cvc(w, cv), F.concat(w, F.lit("e"))).otherwise(w)).otherwise(_cut(w, 1)))
    df = df.withColumn("__w", F.when(cut == 0, w).otherwise(mended.when(_m1(cv) & _cvc(w, cv), F.concat(w, F.lit("e"))).otherwise(w)))
    # 1c: y after a consonant
    df = df.withColumn("__cv", letters(w))
    df = df.withColumn("__w", F.when(end("y") & (F.length(w) > 2) & (_last(_cut(cv, 1)) == "c"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    # 2, with its extensions
    df = df.withColumn("__w", F.when(end("alli") & _cut(cv, 4).rlike(M_ABOVE_0), _cut(w, 2)).otherwise(w))
    df = df.withColumn("__cv", F.left(cv, F.length(w)))
    df = df.withColumn("__w", F.when(end("logi") & _cut(cv, 3).rlike(M_ABOVE_0), _cut(w, 1)).otherwise(_first_rule(w, cv, STEP2, M_ABOVE_0)))
    # 3 and 4
    df = df.withColumn("__cv", letters(w)).withColumn("__w", _first_rule(w, cv, STEP3, M_ABOVE_0))
    df = df.withColumn("__cv", letters(w))
    ion = F.when(_cut(cv, 3).rlike(M_ABOVE_1) & _last(_cut(w, 3)).isin("s", "t"), _cut(w, 3)).otherwise(w)
    step4 = F.lit(None).cast("string")
    for suffix in reversed(STEP4):
        new = ion if suffix == "ion" else F.when(_cut(cv, len(suffix)).rlike(M_ABOVE_1), _cut(w, len(suffix))).otherwise(w)
        step4 = F.when(w.endswith(suffix), new).otherwise(step4)
    df = df.withColumn("__w", F.coalesce(step4, w)).withColumn("__cv", F.left(cv, F.length(w)))
    # 5: a last e, a double l
    stem_cv, stem = _cut(cv, 1), _cut(w, 1)
    drop_e = end("e") & (stem_cv.rlike(M_ABOVE_1) | (_m1(stem_cv) & ~_cvc(stem, stem_cv)))
    df = df.withColumn("__w", F.when(drop_e, stem).otherwise(w)).withColumn("__cv", F.left(cv, F.length(w)))
    df = df.withColumn("__w", F.when(cv.rlike(M_ABOVE_1) & _double(w, cv) & end("l"), _cut(w, 1)).otherwise(w))
    odd = F.coalesce(*[F.when(F.col(word) == k, v) for k, v in IRREGULAR.items()])
    stem = F.coalesce(odd, F.when(F.length(word) <= 2, F.col(word)), w)
    return df.withColumn("stem", stem).drop("__w", "__cv", "__cut")
