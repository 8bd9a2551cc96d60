"""Per-row answer metrics (M1-M4) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import lower_tokens, tokens

_WORD = r"\p{L}\p{N}_"  # Python's str \w


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _f(p: Column, r: Column) -> Column:
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def occurrences(ordered: Column) -> Column:
    """Each token of a sorted array with its occurrence number (``a#1, a#2, b#1``)."""
    begins = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())

    def numbered(begins: Column) -> Column:
        runs = F.transform(begins, lambda b, i: F.struct(F.get(ordered, b).alias("token"), (F.coalesce(F.get(begins, i + 1), F.size(ordered)) - b).alias("n")))
        return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), r["n"]), lambda k: F.concat(r["token"], F.lit("#"), k.cast("string")))))

    return bind(begins, numbered)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Tokens that two arrays share, counted with their occurrences: the
    intersection of occurrence-numbered tokens, linear after a sort."""
    return F.size(F.array_intersect(bind(F.array_sort(a), occurrences), bind(F.array_sort(b), occurrences)))


# --- M1 / M2: token exact match and set F1 ----------------------------------------

def token_exact(ref: Column, pred: Column) -> Column:
    """M1: ``ref.lower().split() == pred.lower().split()``."""
    return lower_tokens(ref) == lower_tokens(pred)


def token_set_f1(ref: Column, pred: Column) -> Column:
    """M2: F1 on token *sets*; an empty side gives 0 (the reference divides by zero)."""
    return token_set_f1_tokens(lower_tokens(ref), lower_tokens(pred))


def token_set_f1_tokens(ref_tokens: Column, pred_tokens: Column) -> Column:
    """M2 on already split lower-case token arrays."""
    r = F.array_distinct(ref_tokens)
    p = F.array_distinct(pred_tokens)
    inter = F.size(F.array_intersect(r, p))
    prec = _safe_div(inter, F.size(p))
    rec = _safe_div(inter, F.size(r))
    return _f(prec, rec)


# --- M3 / M4: SQuAD exact and F1 -----------------------------------------------------

def squad_normalise(col: Column) -> Column:
    """lower -> drop ASCII punctuation -> drop the articles a/an/the -> squeeze."""
    s = F.translate(F.lower(col), P.PUNCTUATION, "")
    s = F.regexp_replace(s, f"(?<![{_WORD}])(a|an|the)(?![{_WORD}])", " ")
    return F.array_join(tokens(s), " ")


def squad_tokens(col: Column) -> Column:
    return tokens(squad_normalise(col))


def squad_exact(gold: Column, pred: Column) -> Column:
    """M3 per row: 1.0 when normalised texts are equal."""
    return (squad_normalise(gold) == squad_normalise(pred)).cast("double")


def squad_f1(gold: Column, pred: Column) -> Column:
    """M4 per row: multiset token F1; both empty -> 1, one empty -> 0."""
    return squad_f1_tokens(squad_tokens(gold), squad_tokens(pred))


def squad_f1_tokens(g: Column, p: Column) -> Column:
    """M4 on already normalised token arrays."""
    same = multiset_overlap(g, p)
    prec = _safe_div(same, F.size(p))
    rec = _safe_div(same, F.size(g))
    either_empty = (F.size(g) == 0) | (F.size(p) == 0)
    return (F.when(either_empty, (F.size(g) == F.size(p)).cast("double"))
            .when(same == 0, F.lit(0.0))
            .otherwise(2 * prec * rec / (prec + rec)))
