"""Scoring of predictions.

One projection computes every per-row score; one hash aggregate (partial
sums on the map side, a single shuffle keyed by the report groups) turns
them into the report.  The reference's four separate passes and its
doubled ROUGE call collapse into that one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from . import alignment as A




def _text(c: str) -> Column:
    """pandas NaN reaches the metrics as the text ``nan``."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def mean6(c: Column, scale: float = 1.0) -> Column:
    """``round(scale * avg(c), 6)`` computed exactly and order-free: per-row
    values become whole nano-units (decimal sums do not depend on the
    summation order of a distributed aggregate and hold 10**19 rows of
    the largest score), then one explicit half-up step to 6 places."""
    nanos = F.sum(F.floor(c * (scale * 1e9) + 0.5).cast("decimal(20,0)"))
    return F.floor(nanos.cast("double") / F.count(c) / 1e3 + 0.5) / 1e6


def relaxed(df: DataFrame, actual: str = "actual_answer", pred: str = "predicted_answer",
            strict_time: bool = False) -> DataFrame:
    """Add ``conv_actual_answer``, ``conv_predicted_answer``, ``match_step``.

    Staged projections: each rewritten text and reading is computed once per
    row (the optimizer does not inline a non-trivial column used many times).
    """
    tc = T.strict_time_canonical if strict_time else T.time_canonical
    staged = (df
              .withColumns({"_a0": F.lower(_text(actual)), "_p0": F.lower(_text(pred))})
              .withColumns({"_a": T.drop_word_dots(F.replace(T.number_name_to_int(F.col("_a0")), F.lit('"'), F.lit(""))),
                            "_p": T.drop_word_dots(F.replace(T.number_name_to_int(F.col("_p0")), F.lit('"'), F.lit("")))})
              .withColumns({"_ta": tc(F.col("_a")), "_tp": tc(F.col("_p")),
                            "_da": T.date_ddmm(F.col("_a")), "_dp": T.date_ddmm(F.col("_p")),
                            "_ra": T.digit_runs(F.col("_a")), "_rp": T.digit_runs(F.col("_p"))}))
    a, p = F.col("_a"), F.col("_p")
    step = (F.when(F.col("_a0") == F.col("_p0"), "equal")
            .when(F.col("_ta") == F.col("_tp"), "time")
            .when(a.contains(p), "contained")
            .when(p.contains(a), "contains")
            .when(F.col("_ra") == F.col("_rp"), "digits")
            .when(F.col("_da") == F.col("_dp"), "date")
            .otherwise("none"))
    staged = staged.withColumn("match_step", step)
    st = F.col("match_step")
    conv_a = (F.when(st == "equal", F.col("_a0")).when(st.isin("time", "contains", "digits", "none"), a)
              .when(st == "contained", p).otherwise(F.col("_da")))
    conv_p = (F.when(st == "equal", F.col("_p0")).when(st.isin("time", "contains"), a)
              .when(st.isin("contained", "digits", "none"), p).otherwise(F.col("_da")))
    return (staged.withColumns({"conv_actual_answer": conv_a, "conv_predicted_answer": conv_p})
            .drop("_a0", "_p0", "_a", "_p", "_ta", "_tp", "_da", "_dp", "_ra", "_rp"))


def row_scores(df: DataFrame, actual: str = "actual_answer", pred: str = "predicted_answer") -> DataFrame:
    """Per-row SQuAD exact/F1 (M3, M4) and token EM / set-F1 (M1, M2).

    Token arrays are built once per row in their own projection and every
    metric reads them, so long texts are split and normalised once.
    """
    a, p = _text(actual), _text(pred)
    toks = df.withColumns({
        "_gt": M.squad_tokens(a), "_pt": M.squad_tokens(p),
        "_rt": M.lower_tokens(a), "_qt": M.lower_tokens(p),
    })
    return toks.withColumns({
        "squad_exact": (F.col("_gt") == F.col("_pt")).cast("double"),
        "squad_f1": M.squad_f1_tokens(F.col("_gt"), F.col("_pt")),
        "token_em": (F.col("_rt") == F.col("_qt")).cast("double"),
        "token_f1": M.token_set_f1_tokens(F.col("_rt"), F.col("_qt")),
    }).drop("_gt", "_pt", "_rt", "_qt")


def _scored(df: DataFrame, relaxed_match: bool, actual: str, pred: str) -> DataFrame:
    if relaxed_match:
        df = relaxed(df, actual, pred)
        actual, pred = "conv_actual_answer", "conv_predicted_answer"
    return row_scores(df, actual, pred)


_SCALES = {"exact": ("squad_exact", 100.0), "f1": ("squad_f1", 100.0), "token_em": ("token_em", 1.0), "token_f1": ("token_f1", 1.0)}


def subtotals(df: DataFrame, by=("model", "setting", "split"), relaxed_match: bool = False,
              actual: str = "actual_answer", pred: str = "predicted_answer") -> DataFrame:
    """A10: the report at every level of ``by`` (``rollup``), with ``level``: how many of
    ``by`` are rolled up into the row.  The scores are summed per finest group once
    and those few rows rolled up.  The grand total is there for empty input too (F7):
    ``n`` is 0 and the metrics are NULL."""
    sums = [F.sum(F.floor(F.col(c) * (scale * 1e9) + 0.5).cast("decimal(20,0)")).alias(name) for name, (c, scale) in _SCALES.items()]
    finest = _scored(df, relaxed_match, actual, pred).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    means = [(F.floor(F.sum(name).cast("double") / F.sum("n") / 1e3 + 0.5) / 1e6).alias(name) for name in _SCALES]
    # grouping_id has a bit per column; rolled up are the last ones, so its bits are 0..01..1.
    level = F.bit_count(F.grouping_id()).cast("int")
    parts = finest.rollup(*by).agg(level.alias("level"), rows.alias("n"), *means).where(F.col("level") < len(by))
    total = finest.agg(rows.alias("n"), *means).select(*[F.lit(None).cast(t).alias(c) for c, t in finest.select(*by).dtypes], F.lit(len(by)).alias("level"), "n", *_SCALES)
    return parts.select(*by, "level", "n", *_SCALES).unionByName(total)


def report(df: DataFrame, by=("model", "setting", "split"), relaxed_match: bool = False,
           actual: str = "actual_answer", pred: str = "predicted_answer") -> DataFrame:
    """M8 (raw) / M9 (relaxed): one row per group with ``n`` and the
    SQuAD-style scores x100.  An empty group does not appear here; ``subtotals`` has
    a total for empty input (F7)."""
    scored = _scored(df, relaxed_match, actual, pred)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        mean6(F.col("squad_exact"), 100.0).alias("exact"),
        mean6(F.col("squad_f1"), 100.0).alias("f1"),
        mean6(F.col("token_em")).alias("token_em"),
        mean6(F.col("token_f1")).alias("token_f1"),
    )


def match_step_counts(df: DataFrame, actual: str = "actual_answer",
                      pred: str = "predicted_answer") -> DataFrame:
    """Pairs accepted by relaxed matching, by step."""
    return relaxed(df, actual, pred).groupBy("match_step").agg(F.count(F.lit(1)).alias("n"))


def rouge_meteor(df: DataFrame, actual: str = "actual_answer", pred: str = "predicted_answer", synonyms: DataFrame | None = None) -> DataFrame:
    """M5-M7 per row: ROUGE-1 and ROUGE-L F (stemmed) and METEOR, scored once per
    distinct pair of texts; pairs without a token score 0."""
    key = A.pair_key(actual, pred)
    scores = A.score_pairs(df, actual, pred, synonyms)
    found = df.withColumn("_key", key).join(scores.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
    return found.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("rouge1", "rougeL", "meteor")})


def text_report(df: DataFrame, by, actual: str = "actual_answer", pred: str = "predicted_answer", synonyms: DataFrame | None = None) -> DataFrame:
    """M5-M7 + X6: mean ROUGE-1, ROUGE-L and METEOR per group.  Rows are counted
    per (group, pair) before they meet the scores."""
    counts = df.groupBy(*by, A.pair_key(actual, pred).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    found = counts.join(A.score_pairs(df, actual, pred, synonyms), "key", "left")

    def mean(c: str) -> Column:
        nanos = F.floor(F.coalesce(F.col(c), F.lit(0.0)) * 1e9 + 0.5).cast("decimal(10,0)") * F.col("rows").cast("decimal(18,0)")
        return (F.floor(F.sum(nanos).cast("double") / F.sum("rows") / 1e3 + 0.5) / 1e6).alias(c)

    return found.groupBy(*by).agg(F.sum("rows").alias("n"), mean("rouge1"), mean("rougeL"), mean("meteor"))
