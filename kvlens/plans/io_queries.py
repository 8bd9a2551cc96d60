"""Source/sink queries: per-split CSV outputs written and scanned back
(S1 S2 S6 S8), keyed by the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import infobox as H
from ..operators import splits as SP
from ..operators import triples as K
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import view, with_clause
from ..sources.tables import read_csv_glob, read_docs, write_docs, write_table
from .registry import register
from .split_queries import TAIL, _LOOKUPS
from .triple_queries import _BASE, _STATUS


@register("split_files_roundtrip", "S8 S6 S1 S2 D1 (CSV with multi-line cells)", lambda: with_clause(["v_splits"]).rstrip()
          + _LOOKUPS + f"""
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(question)) AS BIGINT) AS question_chars
FROM (SELECT s.split, a.question FROM v_splits s JOIN ans a ON s.table_id = a.table_id
      UNION ALL
      SELECT 'tail', a.question FROM ans a
      WHERE a.table_id IN (SELECT table_id FROM tcat WHERE category IN ({", ".join(repr(c) for c in TAIL)}))) t
GROUP BY split""")
def split_files_roundtrip(spark, sf_dir):
    """Evaluation rows -> one CSV folder per split (answers get a newline to
    exercise quoted multi-line cells) -> a glob scan of all CSVs -> counts."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/splits-{uuid.uuid4().hex}"
    rows = SP.eval_rows(view(spark, sf_dir, "v_qa"), view(spark, sf_dir, "v_splits"), TAIL)
    rows = rows.withColumn("answer", F.concat(F.col("answer"), F.lit("\n(checked)")))
    write_table(rows, base, fmt="csv", partition_by=["split"])
    back = read_csv_glob(spark, f"{base}/split=*/*.csv", "table_id BIGINT, question STRING, answer STRING")
    back = back.withColumn("split", F.regexp_extract(F.col("src_file"), r"split=([^/]+)", 1))
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.length("question")).cast("long").alias("question_chars"))


@register("document_folders", "S3 S4 S5 J9 (folders of JSON, HTML and triple files, bound by file)", lambda: _BASE + f"""
SELECT table_id, s_name AS name, r_name AS region, CAST(3 AS BIGINT) AS html_slots, {_STATUS} AS status,
       CAST(CASE WHEN {_STATUS} IN ('ok', 'unwrapped') THEN 2 ELSE 0 END AS BIGINT) AS n_triples
FROM base""")
def document_folders(spark, sf_dir):
    """One JSON, one HTML and one triple file per supplier, written and read back."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/folders-{uuid.uuid4().hex}"
    for name in ("v_supplier_files", "v_triples"):
        df = view(spark, sf_dir, name)
        for c in set(df.columns) & {"doc", "html", "kg"}:
            write_docs(df, f"{base}/{c}", c, shelves=True)
    docs = H.read_documents(read_docs(spark, f"{base}/doc", shelves=True))
    docs = docs.groupBy("table_id").agg(F.max(F.when(F.col("key") == "name", F.col("value"))).alias("name"),
                                        F.max(F.when((F.col("section") == "place") & (F.col("key") == "region"), F.col("value"))).alias("region"))
    html = H.nested(read_docs(spark, f"{base}/html", "html", shelves=True)).select("table_id", F.size("slots").cast("long").alias("html_slots"))
    kg = K.unwrap(read_docs(spark, f"{base}/kg", "kg", shelves=True))
    n = F.coalesce(F.size(F.from_json("triples_json", "array<map<string,string>>")), F.lit(0)).cast("long")
    return docs.join(html, "table_id").join(kg.select("table_id", "status", n.alias("n_triples")), "table_id")
