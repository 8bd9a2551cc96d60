"""Prompt-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prompt_text import TEMPLATES
from ..operators import infobox as H
from ..operators import prompts as Q
from ..operators import splits as SP
from ..sources.fixtures import view, with_clause
from . import sqlx as X
from .infobox_queries import _EXPECTED_TEXT
from .registry import register
from .split_queries import TAIL, _LOOKUPS

GRID = [("t5-base", "finetune", "seq2seq"), ("flan-t5-large", "few-shot", "few_shot"),
        ("flan-t5-large", "few-shot-reasoning", "few_shot_reasoning"), ("gpt-4", "zero-shot", "chat_zero_shot"),
        ("llama-2", "zero-shot", "chat_no_preamble")]


def _text(spark, sf_dir):
    """H6 + H5: each table's prompt text, built once per table."""
    return H.linearise(H.nested_documents(view(spark, sf_dir, "v_doc")))


def _rows(spark, sf_dir):
    qa = view(spark, sf_dir, "v_qa")
    return Q.with_context(SP.eval_rows(qa, view(spark, sf_dir, "v_splits"), TAIL), _text(spark, sf_dir))


def _rows_sql():
    tail = ", ".join(f"'{c}'" for c in TAIL)
    return with_clause(["v_splits"]).rstrip() + _LOOKUPS + f""",
txt AS ({_EXPECTED_TEXT}),
ev AS (SELECT s.split, a.table_id, a.question, a.answer FROM v_splits s JOIN ans a ON s.table_id = a.table_id
       UNION ALL
       SELECT 'tail', a.table_id, a.question, a.answer FROM ans a
       WHERE a.table_id IN (SELECT table_id FROM tcat WHERE category IN ({tail}))),
rows AS (SELECT ev.*, txt.text AS context FROM ev JOIN txt ON ev.table_id = txt.table_id)
"""


def _prompt_query(name, template, ops):
    def sql():
        return _rows_sql() + f"""
SELECT split, table_id, question, answer,
       {X.fill(TEMPLATES[template], question='question', context='context')} AS prompt FROM rows"""

    @register(name, ops, sql)
    def build(spark, sf_dir):
        return Q.prompts(_rows(spark, sf_dir), template).select("split", "table_id", "question", "answer", "prompt")
    return build


_prompt_query("prompt_zero_shot", "seq2seq", "Q1 Q10 J2 J3-J5")
_prompt_query("prompt_few_shot", "few_shot", "Q2 J2")
_prompt_query("prompt_reasoning", "few_shot_reasoning", "Q3 J2")
_prompt_query("prompt_chat", "chat_zero_shot", "Q4 J2")
_prompt_query("prompt_chat_no_preamble", "chat_no_preamble", "Q7 J2")
_prompt_query("prompt_chat_few_shot", "chat_few_shot", "Q5 J2")
_prompt_query("prompt_chat_reasoning", "chat_reasoning", "Q6 J2")


def _grid_sql():
    parts = " UNION ALL ".join(
        f"SELECT split, table_id, question, '{m}' AS model, '{s}' AS setting, "
        f"md5({X.fill(TEMPLATES[t], question='question', context='context')}) AS prompt_md5 FROM rows"
        for m, s, t in GRID)
    return _rows_sql() + parts


@register("prompt_grid", "Q12 Q1-Q7 (one pass, every prompt compared)", _grid_sql)
def prompt_grid(spark, sf_dir):
    g = Q.prompt_grid(_rows(spark, sf_dir), GRID)
    return g.select("split", "table_id", "question", "model", "setting", F.md5("prompt").alias("prompt_md5"))


def _train_rows_sql():
    return with_clause(["v_splits"]).rstrip() + _LOOKUPS + f""",
txt AS ({_EXPECTED_TEXT}),
last_t AS (SELECT arg_max(table_id, first_row) AS table_id
           FROM (SELECT table_id, min(row_id) AS first_row FROM v_qa GROUP BY table_id) f)
SELECT a.table_id, a.question, a.answer, txt.text AS table_json FROM ans a JOIN txt ON a.table_id = txt.table_id
WHERE a.table_id NOT IN (SELECT table_id FROM v_splits) AND a.table_id NOT IN (SELECT table_id FROM last_t)"""


@register("train_rows", "Q9 J6 H5 X5", _train_rows_sql)
def train_rows(spark, sf_dir):
    qa = view(spark, sf_dir, "v_qa")
    rows = SP.train_rows(qa, view(spark, sf_dir, "v_splits"), sentinel_table_id=SP.last_table(qa))
    return (Q.with_context(rows, _text(spark, sf_dir))
            .select("table_id", "question", "answer", F.col("context").alias("table_json")))


def _capped_sql():
    prompt = X.fill(TEMPLATES["seq2seq"], question="question", context="context")
    return _rows_sql() + f""",
p AS (SELECT split, table_id, question, answer, {prompt} AS prompt FROM rows),
t AS MATERIALIZED (SELECT split, table_id, question, {X.tokens('prompt')} AS i, {X.tokens('answer')} AS o FROM p),
w AS (SELECT *, unnest(range(0, greatest(CAST(ceil(len(i) / 1024) AS BIGINT), CAST(ceil(len(o) / 32) AS BIGINT), 1))) AS part FROM t)
SELECT split, table_id, question, CAST(part AS INT) AS part,
       CAST(len(i) AS INT) AS n_input_tokens, CAST(len(o) AS INT) AS n_target_tokens,
       len(i) > 1024 AS input_over, len(o) > 32 AS target_over,
       array_to_string(i[part * 1024 + 1:part * 1024 + 1024], ' ') AS input,
       array_to_string(o[part * 32 + 1:part * 32 + 32], ' ') AS target
FROM w"""


@register("prompt_capped", "Q11 X5 (parts of 1024 input and 32 target tokens; no token lost)", _capped_sql)
def prompt_capped(spark, sf_dir):
    return Q.windows(Q.prompts(_rows(spark, sf_dir), "seq2seq"), 1024, 32)


def _py_doc_sql():
    """The v_doc documents as Python ``str(dict)`` text, stated from the part columns."""
    k = "p_partkey"

    def s(x):
        return f"CAST({x} AS STRING)"

    q = "''"  # one quote character inside an SQL literal
    return f"""
SELECT {k} AS table_id,
  '{{{q}category{q}: {q}' || lower(p_type) || '{q}'
  || CASE WHEN {k} % 3 <> 0 THEN ', {q}caption{q}: {q}' || p_name || '{q}' ELSE '' END
  || CASE WHEN {k} % 4 = 0 THEN ', {q}infobox-image{q}: {q}' || p_name || ' photo{q}' ELSE '' END
  || ', {q}Brand{q}: {q}' || p_brand || CASE WHEN {k} % 7 = 0 THEN ' (again)' ELSE '' END || '{q}'
  || ', {q}Size{q}: {q}' || {s('p_size')} || ' | units{q}'
  || ', {q}Price{q}: {q}US dollars | ' || {s('CAST(floor(p_retailprice) AS BIGINT)')} || '{q}'
  || ', {q}Type{q}: {q}' || lower(p_type) || ' |  part{q}'
  || CASE WHEN {k} % 6 = 1 THEN ', {q}Inner{q}: {q}nested ' || {s(k)} || '{q}' ELSE '' END
  || CASE WHEN {k} % 2 = 0 THEN ', {q}Details{q}: {{{q}Container{q}: {q}box ' || {s(f'{k} % 5')}
        || '{q}, {q}Details{q}: [{q}part ' || {s(k)} || ' item one{q}, {q}made in ' || p_brand || '{q}]}}'
        ELSE '' END
  || CASE WHEN {k} % 10 = 0 THEN ', {q}Notes{q}: {{}}' ELSE '' END
  || CASE WHEN {k} % 15 = 1 THEN ', {q}Extra{q}: {{{q}Span{q}: {q}1939-' || {s('p_size')} || '{q}, {q}Extra{q}: {q}solo ' || {s(k)} || '{q}}}' ELSE '' END
  || CASE WHEN {k} % 21 = 2 THEN ', {q}Dup{q}: {{{q}j{q}: {q}2{q}}}' ELSE '' END
  || '}}' AS doc
FROM part"""


@register("prompt_triples", "Q8 H3 (Python dict text) H6",
          lambda: f"SELECT table_id, {X.fill(TEMPLATES['triple_request'], json_table='doc')} AS prompt "
                  f"FROM ({_py_doc_sql()}) d")
def prompt_triples(spark, sf_dir):
    docs = H.document_json(H.nested_documents(view(spark, sf_dir, "v_doc")), python=True)
    return docs.select("table_id", Q.fill(TEMPLATES["triple_request"], json_table=F.col("doc")).alias("prompt"))
