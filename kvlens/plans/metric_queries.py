"""Queries over predictions: relaxed matching, normalisers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as N
from ..operators import scoring as S
from ..sources.fixtures import view, with_clause
from . import sqlx as X
from .registry import register


def _relaxed_cte(src: str) -> str:
    """SQL statement of N23 as chained CTE columns over ``src``."""
    a0 = "lower(coalesce(CAST(actual_answer AS STRING), 'nan'))"
    p0 = "lower(coalesce(CAST(predicted_answer AS STRING), 'nan'))"
    a = X.drop_word_dots(f"replace({X.number_name_to_int('a0')}, '\"', '')")
    p = X.drop_word_dots(f"replace({X.number_name_to_int('p0')}, '\"', '')")
    return f"""
r0 AS (SELECT *, {a0} AS a0, {p0} AS p0 FROM {src}),
r1 AS MATERIALIZED (SELECT *, {a} AS a1, {p} AS p1 FROM r0),
r2 AS MATERIALIZED (SELECT *, {X.time_canonical('a1')} AS ta, {X.time_canonical('p1')} AS tp,
              {X.date_ddmm('a1')} AS da, {X.date_ddmm('p1')} AS dp FROM r1),
rel AS (SELECT *,
  CASE WHEN a0 = p0 THEN a0 WHEN ta = tp THEN a1 WHEN contains(a1, p1) THEN p1
       WHEN contains(p1, a1) THEN a1 WHEN {X.digit_runs('a1')} = {X.digit_runs('p1')} THEN a1
       WHEN da = dp THEN da ELSE a1 END AS conv_actual_answer,
  CASE WHEN a0 = p0 THEN p0 WHEN ta = tp THEN a1 WHEN contains(a1, p1) THEN p1
       WHEN contains(p1, a1) THEN a1 WHEN {X.digit_runs('a1')} = {X.digit_runs('p1')} THEN p1
       WHEN da = dp THEN da ELSE p1 END AS conv_predicted_answer,
  CASE WHEN a0 = p0 THEN 'equal' WHEN ta = tp THEN 'time' WHEN contains(a1, p1) THEN 'contained'
       WHEN contains(p1, a1) THEN 'contains' WHEN {X.digit_runs('a1')} = {X.digit_runs('p1')} THEN 'digits'
       WHEN da = dp THEN 'date' ELSE 'none' END AS match_step
  FROM r2)"""


def _relaxed_pairs_sql():
    return with_clause(["v_pred"]).rstrip() + "," + _relaxed_cte("v_pred") + """
SELECT row_id, conv_actual_answer, conv_predicted_answer, match_step FROM rel"""


@register("relaxed_pairs", "N23 N16-N18 N20 N21", _relaxed_pairs_sql)
def relaxed_pairs(spark, sf_dir):
    return (S.relaxed(view(spark, sf_dir, "v_pred"))
            .select("row_id", "conv_actual_answer", "conv_predicted_answer", "match_step"))


def _steps_sql():
    return with_clause(["v_pred"]).rstrip() + "," + _relaxed_cte("v_pred") + """
SELECT match_step, CAST(count(*) AS BIGINT) AS n FROM rel GROUP BY match_step"""


@register("relaxed_match_steps", "M11 N23", _steps_sql)
def relaxed_match_steps(spark, sf_dir):
    return S.match_step_counts(view(spark, sf_dir, "v_pred"))


def _scored(src, a, p):
    """CTEs ``s0``/``s1`` computing token lists once per row, then the overlap."""
    a, p = f"coalesce({a}, 'nan')", f"coalesce({p}, 'nan')"
    return f"""
s0 AS MATERIALIZED (SELECT *, {X.tokens(X.squad_normalise(a))} AS gt, {X.tokens(X.squad_normalise(p))} AS pt,
              {X.token_exact(a, p)} AS tok_em, {X.token_set_f1(a, p)} AS tok_f1 FROM {src}),
s1 AS MATERIALIZED (SELECT *, {X.multiset_overlap('gt', 'pt')} AS same FROM s0),
s2 AS (SELECT *, CAST(gt = pt AS DOUBLE) AS sq_exact,
   CASE WHEN len(gt) = 0 OR len(pt) = 0 THEN CAST(len(gt) = len(pt) AS DOUBLE)
        WHEN same = 0 THEN 0.0
        ELSE 2.0 * (same / len(pt)) * (same / len(gt)) / ((same / len(pt)) + (same / len(gt))) END AS sq_f1
   FROM s1)"""


def _mean6(v: str, scale: float = 1.0) -> str:
    return (f"floor(CAST(sum(CAST(floor({v} * {scale * 1e9!r} + 0.5) AS BIGINT)) AS DOUBLE) "
            f"/ count({v}) / 1e3 + 0.5) / 1e6")


_AGG = (f"CAST(count(*) AS BIGINT) AS n, {_mean6('sq_exact', 100.0)} AS exact, "
        f"{_mean6('sq_f1', 100.0)} AS f1, {_mean6('CAST(tok_em AS DOUBLE)')} AS token_em, "
        f"{_mean6('tok_f1')} AS token_f1")


def _squad_sql():
    return with_clause(["v_pred"]).rstrip() + "," + _scored("v_pred", "actual_answer", "predicted_answer") + f"""
SELECT model, setting, split, {_AGG} FROM s2 GROUP BY model, setting, split"""


@register("squad_scores", "M1-M4 M8 A9 A10 S9 F7", _squad_sql)
def squad_scores(spark, sf_dir):
    return S.report(view(spark, sf_dir, "v_pred"))


def _squad_relaxed_sql():
    return (with_clause(["v_pred"]).rstrip() + "," + _relaxed_cte("v_pred") + ","
            + _scored("rel", "conv_actual_answer", "conv_predicted_answer") + f"""
SELECT model, setting, split, {_AGG} FROM s2 GROUP BY model, setting, split""")


@register("squad_scores_relaxed", "M9 N23 M3 M4 A10", _squad_relaxed_sql)
def squad_scores_relaxed(spark, sf_dir):
    return S.report(view(spark, sf_dir, "v_pred"), relaxed_match=True)


def _subtotals_sql():
    def rolled(src):
        return f"""SELECT model, setting, split, CAST(grouping(model) + grouping(setting) + grouping(split) AS INT) AS level, {_AGG}
FROM {src} GROUP BY ROLLUP (model, setting, split)"""

    return (with_clause(["v_pred"]).rstrip() + "," + _scored("v_pred", "actual_answer", "predicted_answer")
            + f'''
SELECT 'all' AS input, r.* FROM ({rolled("s2")}) r
UNION ALL SELECT 'none', r.* FROM ({rolled("(SELECT * FROM s2 WHERE model = 'no such model')")}) r''')


@register("scores_subtotals", "A10 (rollup levels) S9 F7 (the total of an empty input)", _subtotals_sql)
def scores_subtotals(spark, sf_dir):
    rows = view(spark, sf_dir, "v_pred")
    found = S.subtotals(rows).withColumn("input", F.lit("all"))
    return found.unionByName(S.subtotals(rows.where("model = 'no such model'")).withColumn("input", F.lit("none")))


def _turn_scores_sql():
    return with_clause(["v_turns"]).rstrip() + "," + _scored("v_turns", "actual_answer", "predicted_answer") + f"""
SELECT conv_id, {_AGG} FROM s2 GROUP BY conv_id"""


@register("turn_scores", "M1-M4 D3 A9 over whole conversation texts", _turn_scores_sql)
def turn_scores(spark, sf_dir):
    return S.report(view(spark, sf_dir, "v_turns"), by=("conv_id",))


def _norm_sql():
    p = "coalesce(predicted_answer, 'nan')"
    return with_clause(["v_pred"]) + f"""
SELECT row_id,
  {X.number_name_to_int(f'lower({p})')} AS number_value,
  {X.time_canonical(p)} AS time_hhmm,
  {X.time_canonical(p, strict=True)} AS time_hhmm_strict,
  {X.date_ddmm('actual_answer')} AS date_ddmm,
  array_to_string({X.digit_runs(p)}, ',') AS digit_runs,
  {X.drop_word_dots(p)} AS no_word_dots,
  {X.text_preprocess(p)} AS preprocessed,
  {X.dates_to_iso(p)} AS iso_dates
FROM v_pred"""


@register("norm_answer_forms", "N5-N7 N16-N22", _norm_sql)
def norm_answer_forms(spark, sf_dir):
    df = view(spark, sf_dir, "v_pred")
    p = F.coalesce(F.col("predicted_answer"), F.lit("nan"))
    return df.select(
        "row_id",
        N.number_name_to_int(F.lower(p)).alias("number_value"),
        N.time_canonical(p).alias("time_hhmm"),
        N.strict_time_canonical(p).alias("time_hhmm_strict"),
        N.date_ddmm(F.col("actual_answer")).alias("date_ddmm"),
        F.array_join(N.digit_runs(p), ",").alias("digit_runs"),
        N.drop_word_dots(p).alias("no_word_dots"),
        N.text_preprocess(p).alias("preprocessed"),
        N.dates_to_iso(p).alias("iso_dates"),
    )


_TEXT_AGG = f"CAST(count(*) AS BIGINT) AS n, {_mean6('rouge1')} AS rouge1, {_mean6('\"rougeL\"')} AS \"rougeL\", {_mean6('meteor')} AS meteor"


def _turns_text_sql():
    return (with_clause(["v_turns"]).rstrip() + "," + X.rouge_meteor_ctes("v_turns", "actual_answer", "predicted_answer")
            + f"\nSELECT conv_id, {_TEXT_AGG} FROM scored GROUP BY conv_id")


@register("rouge_meteor_turns", "M5 M6 M7 X6 over whole conversation texts", _turns_text_sql)
def rouge_meteor_turns(spark, sf_dir):
    return S.text_report(view(spark, sf_dir, "v_turns"), by=("conv_id",))


def _relaxed_text_sql():
    return (with_clause(["v_pred"]).rstrip() + "," + _relaxed_cte("v_pred") + ","
            + X.rouge_meteor_ctes("rel", "conv_actual_answer", "conv_predicted_answer")
            + f"\nSELECT model, setting, split, {_TEXT_AGG} FROM scored GROUP BY model, setting, split")


@register("rouge_meteor_relaxed", "M9 with M5-M7 after N23", _relaxed_text_sql)
def rouge_meteor_relaxed(spark, sf_dir):
    rel = S.relaxed(view(spark, sf_dir, "v_pred"))
    return S.text_report(rel, by=("model", "setting", "split"),
                         actual="conv_actual_answer", pred="conv_predicted_answer")
