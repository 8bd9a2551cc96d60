"""Prompt tables (Q1-Q12, J2): one prompt per (table, question).

The table text is linearised once per table (H5) before the join to the
questions, so a table's text is built once however many questions it has.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompt_text import TEMPLATES
from ..functions.text import tokens

_SLOT = re.compile(r"\{(question|context|json_table)\}")


def fill(template: str, year: str | None = None, **slots: Column) -> Column:
    """Template text with ``{slot}`` markers -> ``concat`` of literals and columns.
    ``year`` replaces the reference year 2022 (Q4's parameter)."""
    if year is not None:
        template = template.replace("2022", str(year))
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(slots[m.group(1)])
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def with_context(qa: DataFrame, table_text: DataFrame, how: str = "inner") -> DataFrame:
    """Attach each table's text; ``how='left'`` keeps questions whose
    table is missing (the reference raised KeyError)."""
    return qa.join(table_text.select("table_id", F.col("text").alias("context")), "table_id", how)


def prompts(rows: DataFrame, template: str = "seq2seq", year: str | None = None) -> DataFrame:
    """Q1-Q7: add ``prompt`` from a named template."""
    return rows.withColumn("prompt", fill(TEMPLATES[template], year=year,
                                          question=F.col("question"), context=F.col("context")))


def prompt_grid(rows: DataFrame, configs) -> DataFrame:
    """Q12: the same rows under several (model, setting, template) configs.

    One pass: each row gives an array of its prompts (the config list is a small
    constant), which is then dealt out into rows.
    """
    filled = F.array(*[
        F.struct(F.lit(model).alias("model"), F.lit(setting).alias("setting"),
                 fill(TEMPLATES[template], question=F.col("question"), context=F.col("context")).alias("prompt"))
        for model, setting, template in configs])
    return rows.select("*", F.inline(filled))


def windows(rows: DataFrame, input_cap: int, target_cap: int) -> DataFrame:
    """Q11 (re-aimed): token counts, flags of what a model's length limits would cut,
    and the whole input and target in numbered parts of at most ``input_cap`` and
    ``target_cap`` whitespace tokens, so that no token is lost.  A side with fewer
    parts is empty in the later ones."""
    n, m = F.size("_in"), F.size("_out")
    last = F.greatest(F.ceil(n / input_cap), F.ceil(m / target_cap), F.lit(1)).cast("int") - 1

    def part(words: str, cap: int) -> Column:
        return F.array_join(F.slice(F.col(words), F.col("part") * cap + 1, F.lit(cap)), " ")

    staged = rows.withColumns({"_in": tokens(F.col("prompt")), "_out": tokens(F.col("answer"))})
    return (staged.withColumns({"n_input_tokens": n, "n_target_tokens": m,
                                "input_over": n > input_cap, "target_over": m > target_cap})
            .withColumn("part", F.explode(F.sequence(F.lit(0), last)))
            .select("split", "table_id", "question", "part", "n_input_tokens", "n_target_tokens", "input_over",
                    "target_over", part("_in", input_cap).alias("input"), part("_out", target_cap).alias("target")))


def answer_from_reasoning(col: Column) -> Column:
    """Q6 inverse: the answer part of an ``answer && reason`` reply."""
    return F.trim(F.split(col, "&&").getItem(0))
