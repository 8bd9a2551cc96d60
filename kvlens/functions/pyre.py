"""Python ``re`` semantics on Spark's Java regex engine.

* ``re.match(p, s)`` is anchored at the start only; ``rlike`` searches, so
  the pattern is wrapped as ``^(?:p)``.
* Python's ``.`` stops only at ``\\n``; Java's also stops at ``\\r`` unless
  UNIX_LINES ``(?d)`` is on.
* Python 3 ``\\d \\w \\s \\b`` are Unicode; Java needs ``(?U)``.
* ``re.sub`` replacement ``\\1`` is ``$1`` in Java.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?dU)"


def anchored(pattern: str, flags: str = "") -> str:
    return f"{FLAGS[:-1]}{flags}){'^'}(?:{pattern})"


def match(col: Column, pattern: str, flags: str = "") -> Column:
    """``re.match(pattern, col) is not None``; NULL input gives NULL."""
    return col.rlike(anchored(pattern, flags))


def search(col: Column, pattern: str, flags: str = "") -> Column:
    """``re.search(pattern, col) is not None``."""
    return col.rlike(f"{FLAGS[:-1]}{flags})(?:{pattern})")


def java_repl(repl: str) -> str:
    """Python replacement template -> Java (``\\1`` -> ``$1``, literal ``$`` escaped)."""
    out = repl.replace("$", "\\$")
    return re.sub(r"\\(\d)", r"$\1", out)


def sub(col: Column, pattern: str, repl: str, flags: str = "") -> Column:
    """``re.sub(pattern, repl, col)`` (all matches)."""
    return F.regexp_replace(col, f"{FLAGS[:-1]}{flags}){pattern}", java_repl(repl))


def first_line(col: Column) -> Column:
    """Text before the first newline: what ``^.*x.*`` can reach under ``re.match``."""
    return F.substring_index(col, "\n", 1)


def keyword_alt(words) -> str:
    """Alternation of literal keywords (regex metacharacters escaped)."""
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)
