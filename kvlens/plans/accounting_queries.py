"""Row accounting (J1 J2 H1 H6): what becomes of every input row."""

from __future__ import annotations

from ..operators import accounting as C
from ..operators import annotate as A
from ..operators import infobox as H
from ..sources.fixtures import view, with_clause
from .annotation_queries import _long_sql
from .registry import register


def _sql():
    docs = "(SELECT p_partkey FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 23 <> 0)"
    views = with_clause(["v_qa", "v_intake"])[len("WITH "):].rstrip()
    return _long_sql().rstrip() + f""",
{views}
SELECT 'answers' AS step, CASE WHEN table_id IS NULL THEN 'no_table_id' ELSE 'grouped' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY ALL
UNION ALL
SELECT 'html_tables', CASE WHEN table_id IS NULL THEN 'no_table_id' WHEN html LIKE '<p>%' THEN 'no_rows' ELSE 'read' END, CAST(count(*) AS BIGINT) FROM v_intake GROUP BY ALL
UNION ALL
SELECT 'documents', CASE WHEN p_partkey % 23 = 0 THEN 'malformed' ELSE 'ok' END, CAST(count(*) AS BIGINT) FROM part WHERE p_partkey % 31 <> 0 GROUP BY ALL
UNION ALL
SELECT 'questions', CASE WHEN d.p_partkey IS NULL THEN 'missing_table' ELSE 'bound' END, CAST(count(*) AS BIGINT) FROM v_qa q LEFT JOIN {docs} d ON d.p_partkey = q.table_id GROUP BY ALL"""


@register("row_accounting", "J1 J2 (left, missing tables) H1 H6 (ids, malformed documents): every input row by outcome", _sql)
def row_accounting(spark, sf_dir):
    _, answers = C.answers(A.long_answers(view(spark, sf_dir, "v_batches")))
    _, html = C.html_tables(view(spark, sf_dir, "v_intake"))
    docs, documents = C.documents(view(spark, sf_dir, "v_intake_doc"))
    text = H.linearise(docs.where("status = 'ok'"))
    _, questions = C.questions(view(spark, sf_dir, "v_qa"), text)
    return C.ledger(spark, answers, html, documents, questions)
