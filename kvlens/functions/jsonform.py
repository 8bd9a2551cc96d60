"""A canonical text of nested JSON: keys sorted at every depth, numbers by value,
no white space.  Two documents have the same canonical text when they hold the
same data, whatever the order of their keys and the way their numbers are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import bind

# Possessive, so that a long string or a long stretch between strings takes no stack.
_DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SINGLE = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_NUMBER = r"-?[0-9]++(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?"


def _each(text: Column, pattern: str, fn) -> Column:
    """``text`` cut into the pattern's matches (which cover it) and joined again after ``fn``."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(0)), fn), "")


def _python_words(text: Column) -> Column:
    """Python's True, False and None outside strings, as JSON's."""
    def word(t: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
        return F.when(t.startswith('"') | t.startswith("'"), t).otherwise(plain)

    return _each(text, f"{_DOUBLE}|{_SINGLE}|[^\"']++|.", word)


def _number(t: Column) -> Column:
    """A number by its value: plain decimal, without trailing zeros, where 19 places
    before and behind the point hold it; else as a double prints."""
    exact = t.try_cast("decimal(38,19)")
    plain = F.regexp_replace(F.format_string("%s", exact.cast("string")), r"\.?0+$", "")
    return F.when(exact.isNull(), t.cast("double").cast("string")).when(exact == 0, "0").otherwise(plain)


def canonical_json(text: Column) -> Column:
    """Null for a text that is no JSON (strict or Python literal) or repeats a key."""
    def parsed(c: Column) -> Column:
        return F.to_json(F.from_json(c, "variant"))

    canonical = F.coalesce(parsed(text), parsed(_python_words(text)))
    return bind(canonical, lambda c: _each(c, f"{_DOUBLE}|{_NUMBER}|[^\"0-9-]++|.", lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).otherwise(t)))
