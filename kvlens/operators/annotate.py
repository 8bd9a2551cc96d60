"""Annotation consolidation (E1): union batches, unpivot, filter, repair ids,
group by (question, table) and vote on answers.

Skew: one (question, table) key may hold a large share of all answers.  The
vote therefore never collects a group's answers: it counts (key, answer)
pairs with map-side partial aggregation, then keeps one winner per key with
``max_by`` (again partial).  Group-level first values use ``min_by`` over a
row id, which is order-independent after a shuffle (``first()`` is not).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import bind
from ..functions.text import align_to_gold, is_all_digits, normalise_answer, normalise_gold, parse_list_literal
from ..session import materialise

# the 21 columns the reference keeps (P1), in its order
WIDE_COLUMNS = [
    "assignment_id", "worker_id", "status", "table_html", "table_id", "name", "category",
    "question1", "gold1", "answer1", "explanation1", "approve", "reject",
    "question2", "gold2", "answer2", "explanation2",
    "question3", "gold3", "answer3", "explanation3",
]
ASSIGNMENT_COLUMNS = ["assignment_id", "worker_id", "status", "table_html", "table_id", "name", "category"]
KEY = ["question", "table_id"]


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Union by name; a batch missing a column contributes NULLs."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def prune(df: DataFrame) -> DataFrame:
    """Keep the 21 annotation columns (plus the row id and batch)."""
    keep = [c for c in ["row_id", "batch"] if c in df.columns]
    return df.select(*keep, *[c for c in WIDE_COLUMNS if c in df.columns])


def unpivot(df: DataFrame, groups: int = 3) -> DataFrame:
    """P5: three (question, gold, answer, explanation) groups -> three rows.

    ``approve`` / ``reject`` are dropped here, as in the reference.  ``row_id``
    becomes ``row_id * groups + q_no - 1`` so input order is kept.
    """
    parts = F.array(*[
        F.struct(F.lit(j).alias("q_no"), F.col(f"question{j}").alias("question"),
                 F.col(f"gold{j}").alias("gold_answer"), F.col(f"answer{j}").alias("answer"),
                 F.col(f"explanation{j}").alias("explanation"))
        for j in range(1, groups + 1)
    ])
    return (df.select("row_id", *ASSIGNMENT_COLUMNS, F.inline(parts))
            .withColumn("row_id", F.col("row_id") * groups + F.col("q_no") - 1))


def clean(df: DataFrame) -> DataFrame:
    """F1 + F2: drop rows without question or answer; drop ``Rejected`` but
    keep a NULL status (a plain ``!=`` would drop NULLs)."""
    return df.na.drop(subset=["question", "answer"]).where(~F.col("status").eqNullSafe("Rejected"))


def repair_ids(df: DataFrame) -> DataFrame:
    """A non-digit table id swaps with the name.  A NULL id is not swapped."""
    swap = F.col("table_id").isNotNull() & ~is_all_digits(F.col("table_id"))
    return df.withColumns({
        "table_id": F.when(swap, F.col("name")).otherwise(F.col("table_id")),
        "name": F.when(swap, F.col("table_id")).otherwise(F.col("name")),
    })


def long_answers(wide: DataFrame) -> DataFrame:
    """P1 -> P5 -> F1/F2 -> P4, one row per (assignment, question)."""
    return repair_ids(clean(unpivot(prune(wide))))


def group_summary(long: DataFrame) -> DataFrame:
    """One row per (question, table_id): count of assignments and
    the first (lowest row id) name, category, gold answer and table.

    A NULL table id never matched itself in the reference (its lists came out
    empty); such rows are left out here.
    """
    first = F.min_by(F.struct("name", "category", "gold_answer", "table_html"), F.col("row_id"))
    return (long.where(F.col("table_id").isNotNull())
            .groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("n_assignments"),
                 F.countDistinct("worker_id").alias("n_workers"),
                 first.alias("first"))
            .select(*KEY, "n_assignments", "n_workers", "first.*"))


def group_lists(long: DataFrame, span: int = 12) -> DataFrame:
    """A3: the reference's parallel lists per group, aligned and in row order.

    A group's rows come in parts of ``2**span`` row ids (``part``, ascending), so no
    list holds more entries than that and a hot group is dealt over many tasks;
    a group's parts in order are its whole lists.
    """
    items = F.array_sort(F.collect_list(F.struct("row_id", "assignment_id", "worker_id", "answer", "explanation")))
    return (long.where(F.col("table_id").isNotNull())
            .groupBy(*KEY, F.shiftright("row_id", span).alias("part")).agg(items.alias("_items"))
            .select(*KEY, "part",
                    F.col("_items.assignment_id").alias("assignment_ids"),
                    F.col("_items.worker_id").alias("worker_ids"),
                    F.col("_items.answer").alias("answers"),
                    F.col("_items.explanation").alias("explanations")))


def vote(long: DataFrame) -> DataFrame:
    """N8/N9/N14 + A8 + M10: normalise the group's gold and every answer,
    align answers to the gold, then take the majority.

    Ties: the answer that appears first (lowest row id) wins, which also
    gives the first answer when every count is 1.  ``score`` is the
    majority count; ``share`` = score / answers (ours).

    Plan: answers are counted per (key, normalised answer) first (map-side
    partial aggregation), so the gold join, the alignment and the final
    counts run on pre-aggregated rows: a key holding a third of all rows
    costs a handful of rows after the first exchange.
    """
    base = (long.where(F.col("table_id").isNotNull())
            .select(*KEY, "row_id", "gold_answer", normalise_answer(F.col("answer")).alias("norm")))
    per_norm = (base.groupBy(*KEY, "norm")
                .agg(F.count(F.lit(1)).alias("cnt"), F.min("row_id").alias("first_row"),
                     F.min_by("gold_answer", F.col("row_id")).alias("first_gold")))
    per_norm = materialise(per_norm, "votes")  # three branches read the pre-aggregated rows
    gold = (per_norm.groupBy(*KEY)
            .agg(F.min_by("first_gold", F.col("first_row")).alias("gold_answer"),
                 F.sum("cnt").alias("n_answers"))
            .withColumn("corrected_gold", normalise_gold(F.coalesce(F.col("gold_answer"), F.lit("nan")))))
    aligned = (per_norm.join(gold.select(*KEY, "corrected_gold"), KEY)
               .withColumn("corrected", align_to_gold(F.col("norm"), F.col("corrected_gold"))))
    counts = (aligned.groupBy(*KEY, "corrected")
              .agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row")))
    winner = (counts.groupBy(*KEY)
              .agg(F.max_by("corrected", F.struct(F.col("cnt"), -F.col("first_row"))).alias("majority_answer"),
                   F.max("cnt").alias("score")))
    return (gold.join(winner, KEY)
            .select(*KEY, "corrected_gold", "majority_answer", "score", "n_answers",
                    F.round(F.col("score") / F.col("n_answers"), 6).alias("share")))


def vote_lists(df: DataFrame, gold: str = "gold_answer", answers: str = "answers") -> DataFrame:
    """A8 on the reference's own form: every row has its answers as a list literal
    (N15).  Adds ``n_answers``, ``corrected_gold``, ``corrected`` (the list after N9 and
    N14), ``majority_answer`` and ``score``.

    The vote runs inside the row: the answers are sorted with their places, each run
    of equal ones is a candidate with its count and first place, and the
    largest count wins, ties by the first place.  An empty list (or a text that is
    none) has the answer '' and, as in the reference, score 1.
    """
    staged = df.withColumns({"_list": parse_list_literal(F.col(answers)), "corrected_gold": normalise_gold(F.coalesce(F.col(gold), F.lit("nan")))})
    # Bound: the alignment reads the normalised answer in every one of its tests.
    staged = staged.withColumn("corrected", F.transform("_list", lambda a: bind(normalise_answer(a), lambda norm: align_to_gold(norm, F.col("corrected_gold")))))

    def candidates(ordered):
        begins = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (x["answer"] != F.get(ordered, i - 1)["answer"]), i)), lambda i: i.isNotNull())
        return bind(begins, lambda begins: F.transform(begins, lambda b, i: F.struct(
            (F.coalesce(F.get(begins, i + 1), F.size(ordered)) - b).alias("n"), (-F.get(ordered, b)["at"]).alias("early"), F.get(ordered, b)["answer"].alias("answer"))))

    numbered = F.array_sort(F.transform("corrected", lambda a, i: F.struct(a.alias("answer"), i.alias("at"))))
    staged = staged.withColumn("_won", F.array_max(bind(numbered, candidates)))
    return staged.withColumns({"n_answers": F.size("_list").cast("long"), "majority_answer": F.coalesce(F.col("_won.answer"), F.lit("")),
                               "score": F.coalesce(F.col("_won.n"), F.lit(1)).cast("long")}).drop("_list", "_won")
