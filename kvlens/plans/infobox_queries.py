"""Infobox queries: HTML -> key/value rows, documents, flat columns, prompt text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import infobox as H
from ..sources.fixtures import view, with_clause
from ..sources.tables import table
from .registry import register

_K = "p_partkey"
_BRAND = f"p_brand || CASE WHEN {_K} % 7 = 0 THEN ' (again)' ELSE '' END"
_PRICE = "CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING)"

# the rows the fixture HTML encodes, stated from the part columns
_EXPECTED_KV = f"""
SELECT {_K} AS table_id, CAST(NULL AS STRING) AS section, 'category' AS key, lower(p_type) AS value,
       CAST(NULL AS INT) AS list_pos, 'flat' AS kind FROM part
UNION ALL SELECT {_K}, NULL, 'caption', p_name, NULL, 'flat' FROM part WHERE {_K} % 3 <> 0
UNION ALL SELECT {_K}, NULL, 'infobox-image', p_name || ' photo', NULL, 'flat' FROM part WHERE {_K} % 4 = 0
UNION ALL SELECT {_K}, NULL, 'Brand', {_BRAND}, NULL, 'flat' FROM part
UNION ALL SELECT {_K}, NULL, 'Size', CAST(p_size AS STRING) || ' | units', NULL, 'flat' FROM part
UNION ALL SELECT {_K}, NULL, 'Price', 'US dollars | ' || {_PRICE}, NULL, 'flat' FROM part
UNION ALL SELECT {_K}, NULL, 'Type', lower(p_type) || ' |  part', NULL, 'flat' FROM part
UNION ALL SELECT {_K}, NULL, 'Inner', 'nested ' || CAST({_K} AS STRING), NULL, 'flat' FROM part WHERE {_K} % 6 = 1
UNION ALL SELECT {_K}, 'Details', 'Container', 'box ' || CAST({_K} % 5 AS STRING), NULL, 'section_kv'
  FROM part WHERE {_K} % 2 = 0
UNION ALL SELECT {_K}, 'Details', 'Details', 'part ' || CAST({_K} AS STRING) || ' item one', 1, 'section_list'
  FROM part WHERE {_K} % 2 = 0
UNION ALL SELECT {_K}, 'Details', 'Details', 'made in ' || p_brand, 2, 'section_list' FROM part WHERE {_K} % 2 = 0
UNION ALL SELECT {_K}, 'Notes', NULL, NULL, NULL, 'empty_section' FROM part WHERE {_K} % 10 = 0
UNION ALL SELECT {_K}, 'Extra', 'Span', '1939-' || CAST(p_size AS STRING), NULL, 'section_kv' FROM part WHERE {_K} % 15 = 1
UNION ALL SELECT {_K}, 'Extra', 'Extra', 'solo ' || CAST({_K} AS STRING), NULL, 'section_kv' FROM part WHERE {_K} % 15 = 1
UNION ALL SELECT {_K}, 'Dup', 'j', '2', NULL, 'section_kv' FROM part WHERE {_K} % 21 = 2
"""

_EXPECTED_TEXT = f"""
SELECT {_K} AS table_id,
  'category' || chr(10) || lower(p_type) || chr(10) || chr(10)
  || CASE WHEN {_K} % 3 <> 0 THEN 'caption' || chr(10) || p_name || chr(10) || chr(10) ELSE '' END
  || CASE WHEN {_K} % 4 = 0 THEN 'infobox-image' || chr(10) || p_name || ' photo' || chr(10) || chr(10) ELSE '' END
  || 'Brand' || chr(10) || {_BRAND} || chr(10) || chr(10)
  || 'Size' || chr(10) || CAST(p_size AS STRING) || ' | units' || chr(10) || chr(10)
  || 'Price' || chr(10) || 'US dollars | ' || {_PRICE} || chr(10) || chr(10)
  || 'Type' || chr(10) || lower(p_type) || ' |  part' || chr(10) || chr(10)
  || CASE WHEN {_K} % 6 = 1 THEN 'Inner' || chr(10) || 'nested ' || CAST({_K} AS STRING) || chr(10) || chr(10) ELSE '' END
  || CASE WHEN {_K} % 2 = 0 THEN 'Details' || chr(10) || 'Container' || chr(9) || 'box ' || CAST({_K} % 5 AS STRING)
        || chr(10) || '[''part ' || CAST({_K} AS STRING) || ' item one'', ''made in ' || p_brand || ''']'
        || chr(10) || chr(10) ELSE '' END
  || CASE WHEN {_K} % 10 = 0 THEN 'Notes' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN {_K} % 15 = 1 THEN 'Extra' || chr(10) || 'Span' || chr(9) || '1939-' || CAST(p_size AS STRING) || chr(10)
        || 'Extra' || chr(9) || 'solo ' || CAST({_K} AS STRING) || chr(10) || chr(10) ELSE '' END
  || CASE WHEN {_K} % 21 = 2 THEN 'Dup' || chr(10) || 'j' || chr(9) || '2' || chr(10) || chr(10) ELSE '' END AS text
FROM part
"""


def _tables(spark, sf_dir):
    return H.normalise_dashes(view(spark, sf_dir, "v_infobox"))


@register("infobox_parse", "H1 H2 H3 W2 W3 N1-N3 P6 S4 X4", lambda: f"""
SELECT table_id, section, key, value, list_pos, kind FROM ({_EXPECTED_KV}) t""")
def infobox_parse(spark, sf_dir):
    kv = H.key_values(_tables(spark, sf_dir))
    return kv.select("table_id", "section", "key", "value", "list_pos", "kind")


@register("infobox_linearise", "H1-H3 H5 N25 O1", lambda: _EXPECTED_TEXT)
def infobox_linearise(spark, sf_dir):
    return H.linearise(H.nested(_tables(spark, sf_dir)))


@register("infobox_document", "H3 (JSON text, key order kept)", lambda: with_clause(["v_doc"]) + """
SELECT table_id, replace(replace(replace(doc, '": ', '":'), '", "', '","'), '}, "', '},"') AS doc FROM v_doc""")
def infobox_document(spark, sf_dir):
    return H.document_json(H.nested(_tables(spark, sf_dir)))


@register("table_linearise", "S3 H6 H5 N25 O1", lambda: _EXPECTED_TEXT)
def table_linearise(spark, sf_dir):
    return H.linearise(H.nested_documents(view(spark, sf_dir, "v_doc")))


@register("table_flatten", "H4 H6 W4", lambda: f"""
SELECT table_id,
       CASE kind WHEN 'flat' THEN key WHEN 'section_kv' THEN key || '(' || section || ')'
                 ELSE section || '/list_' || CAST(list_pos AS STRING) END AS "column",
       value, kind = 'section_kv' AND key = section AS char_split
FROM ({_EXPECTED_KV}) t WHERE kind <> 'empty_section'""")
def table_flatten(spark, sf_dir):
    return H.flatten(H.read_documents(view(spark, sf_dir, "v_doc")))


@register("json_doc_keys", "S3 H6 on events.props", """
SELECT k AS key, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(json_extract_string(props, '$."' || k || '"') AS BIGINT)) AS BIGINT) AS total
FROM events, unnest(json_keys(props)) AS t(k) GROUP BY k""")
def json_doc_keys(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    kv = ev.select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return kv.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))
