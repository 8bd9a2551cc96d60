"""Scalar string functions N1-N25 as native Spark Column expressions.

No Python UDFs: every function is a chain of built-in expressions, so it
runs inside whole-stage codegen (higher-order lambdas run interpreted, but
still JVM-side).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .pyre import FLAGS, sub

_U = FLAGS  # "(?dU)"


def _lit_replace(col: Column, pairs) -> Column:
    """Literal replacements applied in order (no word boundaries)."""
    for key, value in pairs:
        col = F.replace(col, F.lit(key), F.lit(value))
    return col


def py_strip(col: Column) -> Column:
    """``str.strip()``: Unicode whitespace on both ends (``trim`` only drops spaces)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def py_lower(col: Column) -> Column:
    return F.lower(col)


# --- N1 / N2 / N3: infobox cleaning ------------------------------------------------

def clean_piece(col: Column) -> Column:
    """Newline, NBSP, zero-width space and bullet -> space; squeeze spaces;
    drop trailing colons/spaces; whitespace-only -> ''.  A leading space stays."""
    s = F.regexp_replace(col, "[\n\u00a0\u200b\u2022]", " ")
    s = F.regexp_replace(s, " +", " ")
    stripped = F.regexp_replace(s, "[:\uff1a ]+\\z", "")
    return F.when(s.rlike(r"(?U)^\s*\z"), F.lit("")).otherwise(stripped)


def join_pieces(pieces: Column) -> Column:
    """Clean each text piece, drop blanks, join with ' | '."""
    cleaned = F.transform(pieces, clean_piece)
    return F.array_join(F.filter(cleaned, lambda x: x != F.lit("")), P.PIECE_SEP)


def ends_with_colon(col: Column) -> Column:
    """Last non-space/newline character is a colon; NULL -> false."""
    return F.coalesce(col.rlike("[:：][ \n]*\\z"), F.lit(False))


# --- N4 .. N7: word maps -----------------------------------------------------------

def number_words_10(col: Column) -> Column:
    """10 number words -> digits, in dict order (``money`` -> ``m1y``)."""
    return _lit_replace(col, P.NUMBER_WORDS_10)


def number_words_12(col: Column) -> Column:
    """As N4 plus ``sept`` and ``novemeber`` (``september`` -> ``septemberember``)."""
    return _lit_replace(col, P.NUMBER_WORDS_12)


def italian_months(col: Column) -> Column:
    """Italian month names -> English."""
    return _lit_replace(col, P.ITALIAN_MONTHS)


def text_preprocess(col: Column) -> Column:
    """Lower -> N5 -> N6."""
    return italian_months(number_words_12(F.lower(col)))


# --- N8 .. N14: answer normalisation for voting --------------------------------------

def _common_answer_prefix(col: Column) -> Column:
    s = py_strip(F.lower(col))
    s = F.regexp_replace(s, '["~#%>+]', "")
    s = _lit_replace(s, [(tok, "") for tok in P.CURRENCY_TOKENS])
    s = sub(s, r"\.$", "")
    s = sub(s, r"^\.", "")
    return number_words_10(s)


def normalise_gold(col: Column) -> Column:
    """Gold answer normaliser (N13, N4, N12, N11, N10, prefix rule)."""
    s = _common_answer_prefix(col)
    s = sub(s, P.TRAILING_PAREN, "")
    s = sub(s, P.ORDINAL_SUFFIX, r"\1")
    s = sub(s, P.GOLD_UNITS, r"\2")
    s = sub(s, P.GOLD_PREFIX, r"\2")
    # the medal rule has a space after '$' and never matches: omitted
    return s


def normalise_answer(col: Column) -> Column:
    """Annotator answer normaliser (no N12, shorter unit list)."""
    s = _common_answer_prefix(col)
    s = sub(s, P.ORDINAL_SUFFIX, r"\1")
    s = sub(s, P.ANSWER_UNITS, r"\2")
    return s


def align_to_gold(answer: Column, gold: Column) -> Column:
    """An answer that contains the gold as a word, or whose trailing
    parenthetical equals it, becomes the gold."""
    paren = F.regexp_extract(answer, r"(?dU)^.*\((.*)\)$", 1)
    contained = (
        answer.contains(F.concat(F.lit(" "), gold, F.lit(" ")))
        | answer.contains(F.concat(F.lit(" "), gold, F.lit(",")))
        | answer.contains(F.concat(F.lit(" "), gold, F.lit(". ")))
    )
    for w in P.ALIGN_PREFIX_SUFFIXES:
        contained = contained | answer.startswith(F.concat(gold, F.lit(w)))
    contained = contained | answer.endswith(F.concat(F.lit(" "), gold))
    by_paren = (answer != gold) & answer.contains(gold) & answer.rlike(r"(?dU)^.*\(.*\)$") & (paren == gold)
    return F.when(contained | by_paren, gold).otherwise(answer)


# --- N15: list literals ------------------------------------------------------------

# Possessive throughout: a long string takes no stack.
_STRING = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'|" + r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ATOM = r"[-+.\w]++"
_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"  # JSON's form of a character beyond four digits
_ESCAPE = _PAIR + r"|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\.|[^\\]++"
# Python's one-letter escapes.
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\x07", "b": "\b", "f": "\x0c", "v": "\x0b", "\n": "", "\\": "\\", "'": "'", '"': '"'}


def _code_point(hex_digits: Column) -> Column:
    """The character of a hexadecimal code point; null for half a pair and beyond the last one."""
    code = F.upper(F.lpad(hex_digits, 8, "0"))
    sound = ~code.between("0000D800", "0000DFFF") & (code <= "0010FFFF")
    return F.when(sound, F.decode(F.unhex(F.concat(F.lit("0000FEFF"), code)), "UTF-32"))  # the mark in front is not part of the text


def _unescape(body: Column) -> Column:
    """The text of a Python string literal's inside; an unknown escape stays as it is."""
    def one(t: Column) -> Column:
        kind = F.substring(t, 2, 1)
        plain = None
        for k, v in _PLAIN_ESCAPES.items():
            plain = F.when(kind == k, F.lit(v)) if plain is None else plain.when(kind == k, F.lit(v))
        coded = (F.when(t.rlike(f"^{_PAIR}$"), F.decode(F.unhex(F.replace(t, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
                 .when(kind.isin("x", "u", "U") & (F.length(t) > 2), _code_point(F.substr(t, F.lit(3))))
                 .when(kind.rlike("^[0-7]"), _code_point(F.conv(F.substr(t, F.lit(2)), 8, 16))))
        return F.when(~t.startswith("\\"), t).otherwise(F.coalesce(coded, plain.otherwise(F.lit(None)), t))

    parts = F.regexp_extract_all(body, F.lit(f"(?s){_ESCAPE}"), F.lit(0))
    return F.when(body.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(body)


def parse_list_literal(col: Column) -> Column:
    """A list literal with either quote style and Python's (or JSON's) escapes
    -> array<string>; numbers and names are items as written; NULL and other texts
    give an empty list."""
    item = f"(?s){_STRING}|{_ATOM}"
    skeleton = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, f"(?s){_STRING}", "'"), _ATOM, "'"), r"(?U)\s++", "")
    sound = F.coalesce(skeleton.rlike(r"^\[(?:',)*+'?+\]$"), F.lit(False))

    def text(t: Column) -> Column:
        quoted = t.startswith("'") | t.startswith('"')
        return F.when(quoted, _unescape(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)

    return F.when(sound, F.transform(F.regexp_extract_all(col, F.lit(item), F.lit(0)), text)).otherwise(F.array().cast("array<string>"))


# --- N16 .. N22: relaxed-matching helpers -------------------------------------------

def _number_map() -> Column:
    return F.create_map(*[x for k, v in P.NUMBER_NAMES for x in (F.lit(k), F.lit(v).cast("long"))])


def tokens(col: Column) -> Column:
    """N22 without lower: ``str.split()`` (Unicode whitespace, no empty tokens)."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda x: x != F.lit(""))


def number_name_to_int(col: Column) -> Column:
    """If every word is a number name (or 'and'), the sum of their values
    (so 'two hundred' = 102 and '' = 0); otherwise the text is unchanged."""
    m = _number_map()
    words = tokens(col)
    all_known = F.forall(words, lambda w: m[w].isNotNull() | (w == F.lit("and")))
    total = F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.coalesce(m[w], F.lit(0).cast("long")))
    return F.when(all_known, total.cast("string")).otherwise(col)


def time_canonical(col: Column) -> Column:
    """First ``H:MM``-like match -> ``HH:MM`` (24 h).  The unescaped dot is
    kept, so ``1995`` -> ``01:95``; no match -> input.  An hour in other than
    ASCII digits stays as it is."""
    rx = _U + P.TIME_RE
    hour = F.regexp_extract(col, rx, 1)
    minute = F.regexp_extract(col, rx, 3)
    ampm = F.regexp_extract(col, rx, 4)
    is_pm = ampm.isin("PM", "pm")
    is_am = ampm.isin("AM", "am")
    hour24 = (
        F.when(is_pm & (hour != "12"), F.coalesce((hour.try_cast("int") + 12).cast("string"), hour))
        .when(is_am & (hour == "12"), F.lit("00"))
        .otherwise(hour)
    )
    return F.when(col.rlike(rx), F.concat(F.lpad(hour24, 2, "0"), F.lit(":"), minute)).otherwise(col)


def strict_time_canonical(col: Column) -> Column:
    """N17 with ``strict_time=True``: the separator must be ':'."""
    rx = _U + P.TIME_RE.replace("(:|.)", "(:)")
    hour = F.regexp_extract(col, rx, 1)
    minute = F.regexp_extract(col, rx, 3)
    ampm = F.regexp_extract(col, rx, 4)
    hour24 = (
        F.when(ampm.isin("PM", "pm") & (hour != "12"), F.coalesce((hour.try_cast("int") + 12).cast("string"), hour))
        .when(ampm.isin("AM", "am") & (hour == "12"), F.lit("00"))
        .otherwise(hour)
    )
    return F.when(col.rlike(rx), F.concat(F.lpad(hour24, 2, "0"), F.lit(":"), minute)).otherwise(col)


def _month_number(name: Column) -> Column:
    abbr = F.lower(F.substring(name, 1, 3))
    idx = F.array_position(F.array(*[F.lit(m) for m in P.MONTH_ABBR]), abbr)
    return F.lpad(idx.cast("string"), 2, "0")


def date_ddmm(col: Column) -> Column:
    """Day + month anywhere in the text -> ``DD-MM`` (year dropped);
    four shapes tried in priority order, case-insensitive; no match -> input."""
    out = col
    shapes = [  # (pattern, day group, month group)
        (P.DDMM_ABBR_DAY, 2, 1),
        (P.DDMM_MONTH_DAY, 2, 1),
        (P.DDMM_DAY_ABBR, 1, 2),
        (P.DDMM_DAY_MONTH, 1, 2),
    ]
    for pat, dg, mg in shapes:  # lowest priority first, so the first shape wins
        rx = "(?iU)" + pat
        day = F.regexp_extract(col, rx, dg)
        mon = F.regexp_extract(col, rx, mg)
        out = F.when(col.rlike(rx), F.concat(F.lpad(day, 2, "0"), F.lit("-"), _month_number(mon))).otherwise(out)
    return out


def dates_to_iso(col: Column) -> Column:
    """N19 (intended form): every ``D-M-YYYY`` / ``D/M/YYYY`` -> ``YYYY-MM-DD``."""
    rx = "(?U)" + P.DMY_DATE
    found = F.regexp_extract_all(col, F.lit(rx), 0)

    def canon(m):
        parts = F.split(m, "[-/]")
        return F.concat(parts[2], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[0], 2, "0"))

    return F.aggregate(found, col, lambda acc, m: F.replace(acc, m, canon(m)))


def drop_word_dots(col: Column) -> Column:
    """Remove a dot that follows a word character (``3.5`` -> ``35``)."""
    return sub(col, r"(\w)\.", r"\1")


def digit_runs(col: Column) -> Column:
    """All digit runs, in order."""
    return F.regexp_extract_all(col, F.lit(r"(?U)(\d+)"), 1)


def lower_tokens(col: Column) -> Column:
    """``s.lower().split()``."""
    return tokens(F.lower(col))


def is_all_digits(col: Column) -> Column:
    """``str.isdigit()`` (NULL stays NULL)."""
    return col.rlike(r"^\p{Nd}+$")


# Characters that Python's repr writes as escapes: all but letters, marks, digits, signs and the space.
_HIDDEN = r"[\p{C}\p{Z}&&[^ ]]"


def _hidden_escape(t: Column) -> Column:
    code = F.ascii(t)
    digits = lambda n: F.lpad(F.lower(F.hex(code)), n, "0")
    return (F.when(t == "\n", "\\n").when(t == "\r", "\\r").when(t == "\t", "\\t").when(code < 256, F.concat(F.lit("\\x"), digits(2)))
            .when(code < 65536, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8))))


def py_str_repr(x: Column) -> Column:
    """Python ``repr`` of a string: single quotes unless the text holds ``'``
    and no ``"``; backslash, the chosen quote and characters that do not print
    (line ends, control and format characters, spaces other than ' ') escaped."""
    esc = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    parts = F.regexp_extract_all(esc, F.lit(rf"(?s){_HIDDEN}|[^\p{{C}}\p{{Z}}]++|[ ]++"), F.lit(0))
    esc = F.when(x.rlike(_HIDDEN), F.array_join(F.transform(parts, lambda t: F.when(t.rlike(f"^{_HIDDEN}"), _hidden_escape(t)).otherwise(t)), "")).otherwise(esc)
    dq = x.contains("'") & ~x.contains('"')
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def py_list_repr(items: Column) -> Column:
    """Python ``str(list_of_str)``: ``['a', "b'c"]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, py_str_repr), ", "), F.lit("]"))


