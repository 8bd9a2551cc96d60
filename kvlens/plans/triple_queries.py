"""Triple queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import infobox as H
from ..operators import triples as K
from ..sources.fixtures import view, with_clause
from .registry import register

_BASE = with_clause(["v_triples"]).rstrip() + """,
base AS (SELECT s.s_suppkey AS table_id, s.s_name, n.n_name, r.r_name, n.n_nationkey, r.r_regionkey,
                s.s_suppkey % 16 AS v
         FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                         JOIN region r ON n.n_regionkey = r.r_regionkey)
"""
_STATUS = ("CASE WHEN v IN (0, 8, 1, 9, 5, 13, 6, 14) THEN 'ok' WHEN v IN (2, 10, 3, 4, 12) THEN 'unwrapped' "
           "WHEN v = 11 THEN 'unresolved' WHEN v = 7 THEN 'failed' ELSE 'unparsable' END")


@register("kg_status", "K3 S5 F6", lambda: _BASE + f"""
SELECT {_STATUS} AS status, CAST(count(*) AS BIGINT) AS n FROM base GROUP BY 1""")
def kg_status(spark, sf_dir):
    return K.unwrap(view(spark, sf_dir, "v_triples")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("kg_unwrap", "K1 K2 K3 S5", lambda: _BASE + f"""
SELECT table_id, {_STATUS} AS status,
       CAST(CASE WHEN {_STATUS} IN ('ok', 'unwrapped') THEN 2 ELSE 0 END AS BIGINT) AS n_triples
FROM base""")
def kg_unwrap(spark, sf_dir):
    u = K.unwrap(view(spark, sf_dir, "v_triples"))
    n = F.coalesce(F.size(F.from_json("triples_json", "array<map<string,string>>")), F.lit(0)).cast("long")
    return u.select("table_id", "status", n.alias("n_triples"))


@register("kg_objects", "K2 K5 F6", lambda: _BASE + """
SELECT table_id, CAST(0 AS INT) AS triple_idx, s_name AS subject, 'nation' AS predicate, n_name AS object,
       'string' AS object_kind, 0 AS object_pos FROM base WHERE v IN (0, 8, 1, 9, 5, 13, 2, 10, 3, 4, 12)
UNION ALL SELECT table_id, 1, s_name, 'region', r_name, 'string', 0 FROM base
  WHERE v IN (0, 8, 1, 9, 5, 13, 2, 10, 3, 4, 12)
UNION ALL SELECT table_id, 0, s_name, 'location', '{"nation":"' || n_name || '","region":"' || r_name || '"}',
       'map', 0 FROM base WHERE v IN (6, 14)
UNION ALL SELECT table_id, 1, s_name, 'codes', CAST(n_nationkey AS STRING), 'list', 1 FROM base WHERE v IN (6, 14)
UNION ALL SELECT table_id, 1, s_name, 'codes', CAST(r_regionkey AS STRING), 'list', 2 FROM base WHERE v IN (6, 14)""")
def kg_objects(spark, sf_dir):
    u = K.unwrap(K.drop_failed(view(spark, sf_dir, "v_triples")))
    return K.explode_triples(u)


def _from_table_sql():
    from .infobox_queries import _EXPECTED_KV
    subj = ("CASE WHEN p_partkey % 3 <> 0 THEN p_name WHEN p_partkey % 2 = 0 THEN 'Details' "
            "ELSE lower(p_type) END")
    return f"""
SELECT e.table_id, CASE WHEN e.kind = 'flat' THEN {subj} ELSE e.section END AS subject,
       e.key AS predicate, e.value AS object
FROM ({_EXPECTED_KV}) e JOIN part p ON p.p_partkey = e.table_id
WHERE e.kind <> 'empty_section' AND e.key NOT IN ('category', 'caption')"""


@register("kg_from_table", "K4 J9 H6", _from_table_sql)
def kg_from_table(spark, sf_dir):
    return K.from_key_values(H.read_documents(view(spark, sf_dir, "v_doc")))


@register("kg_by_content", "J9 (content digest) S5 K1-K3", """
SELECT p_partkey AS reply_id, CASE WHEN p_partkey % 8 NOT IN (4, 5) THEN p_partkey END AS table_id,
       CASE WHEN p_partkey % 8 = 0 THEN 'key' WHEN p_partkey % 8 IN (4, 5) THEN 'none' ELSE 'content' END AS bound_by,
       'ok' AS status, p_name AS subject, CAST(p_size AS STRING) AS object
FROM part""")
def kg_by_content(spark, sf_dir):
    bound = K.bind_tables(view(spark, sf_dir, "v_replies"), view(spark, sf_dir, "v_table_doc"))
    first = F.get(F.from_json("triples_json", "array<map<string,string>>"), F.lit(0))
    return K.unwrap(bound).select("reply_id", "table_id", "bound_by", "status", first["subject"].alias("subject"), first["object"].alias("object"))
