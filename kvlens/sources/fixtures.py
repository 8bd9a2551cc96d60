"""Fixture views derived from the driver tables.

The driver's prose holds no infoboxes, QA pairs or predictions, so these
views turn the TPC-H-ish tables into them by plain column expressions.  Each
view is one SELECT written in the SQL subset that Spark and DuckDB read the
same way (``||``, CASE, integer modulo, ``lpad``, ``year``/``month``), so the
oracle can state exactly the same input.  The operators under test never
live here: they are DataFrame code in ``kvlens.operators``.

Every view is a narrow projection of a scan (plus, for v_qa, one equi-join),
so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import register_tables, spread, table

_MONTHS = ["january", "february", "march", "april", "may", "june", "july",
           "august", "september", "october", "november", "december"]


def _month_name(expr: str) -> str:
    whens = " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(_MONTHS))
    return f"(CASE month({expr}) {whens} END)"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_K = "o.o_orderkey"
_KS = _s(_K)
_YS = _s("year(o.o_orderdate)")
_DS = _s("dayofmonth(o.o_orderdate)")
_M = _month_name("o.o_orderdate")
_DOLLARS = _s("CAST(floor(o.o_totalprice) AS BIGINT)")
_CUST = _s("o.o_custkey")

# 16 question templates, one per answer type / operator keyword
_QA = [
    (f"'when was order ' || {_KS} || ' placed?'", f"{_DS} || ' ' || {_M} || ' ' || {_YS}"),
    (f"'how many items did customer ' || {_CUST} || ' order?'", f"{_s(f'{_K} % 7 + 1')} || ' items'"),
    (f"'what was the total price of order ' || {_KS} || '?'", f"'$' || {_DOLLARS}"),
    (f"'is order ' || {_KS} || ' still open?'", "CASE WHEN o.o_orderstatus = 'O' THEN 'yes' ELSE 'no' END"),
    (f"'how old was ' || lower(c.c_name) || ' when order ' || {_KS} || ' was placed?'", _s("year(o.o_orderdate) - 1950")),
    (f"'what percent of order ' || {_KS} || ' was discounted?'", f"{_s(f'{_K} % 10')} || '%'"),
    (f"'what rank did order ' || {_KS} || ' have before ' || {_YS} || '?'", f"{_s(f'{_K} % 9 + 1')} || 'th'"),
    (f"'which country is customer ' || {_CUST} || ' located in?'", f"'nation_' || {_s('c.c_nationkey')}"),
    (f"'who placed order ' || {_KS} || '?'", "lower(c.c_name)"),
    (f"'which team handled order ' || {_KS} || ' during ' || {_M} || '?'", f"'team ' || {_s(f'{_K} % 5')}"),
    (f"'what was the minimum stock color of order ' || {_KS} || '?'",
     f"CASE {_K} % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'green' ELSE 'black' END"),
    (f"'what was the maximum price in ' || {_M} || ' ' || {_YS} || '?'", _DOLLARS),
    (f"'what is the difference between order ' || {_KS} || ' and the next order?'", _s(f"{_K} % 100")),
    (f"'what was the average quantity after ' || {_YS} || ' for order ' || {_KS} || '?'", f"{_s(f'{_K} % 50')} || ' units'"),
    (f"'which was the first order of customer ' || {_CUST} || ', ' || {_KS} || ' or the next?'", f"'order ' || {_KS}"),
    (f"'what is the priority of order ' || {_KS} || '?'", "lower(o.o_orderpriority)"),
]


def _case(idx_expr: str, branches) -> str:
    body = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches))
    return f"(CASE {idx_expr} {body} END)"


V_QA = f"""
SELECT {_K} AS row_id,
       o.o_custkey AS table_id,
       lower(c.c_mktsegment) AS category,
       c.c_name AS name,
       {_case(f'{_K} % 16', [q for q, _ in _QA])} AS question,
       {_case(f'{_K} % 16', [a for _, a in _QA])} AS answer
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

_A = "q.answer"
_PK = "q.row_id"
_PRED = [
    _A,
    f"upper({_A})",
    f"{_A} || ' in total'",
    f"CASE {_PK} % 3 WHEN 0 THEN 'seven' WHEN 1 THEN 'two hundred' ELSE 'twenty one' END",
    f"CASE WHEN {_PK} % 16 = 0 THEN split_part({_A}, ' ', 2) || ' ' || split_part({_A}, ' ', 1) "
    f"ELSE 'order ' || {_A} END",
    f"{_s(f'{_PK} % 12 + 1')} || ':' || lpad({_s(f'{_PK} % 60')}, 2, '0') || "
    f"CASE WHEN {_PK} % 2 = 0 THEN ' pm' ELSE '' END",
    f"replace({_A}, ' ', '-')",
    "'unknown'",
    f"'approx. ' || {_A} || '.5 vs.'",
    f"'On 5-' || {_s(f'{_PK} % 12 + 1')} || '-2019, 2020-01-02 and 7/11/1985'",
    f"'5 ' || CASE {_PK} % 3 WHEN 0 THEN 'Gennaio' WHEN 1 THEN 'luglio' ELSE 'Settembre' END || ' 2001 or Five'",
]

V_PRED = f"""
SELECT {_PK} AS row_id,
       q.table_id,
       q.question,
       q.answer AS actual_answer,
       CASE WHEN {_PK} % 97 = 0 THEN NULL
            ELSE {_case(f'CAST(floor(({_PK} % 176) / 16) AS INT)', _PRED)} END AS predicted_answer,
       CASE q.table_id % 3 WHEN 0 THEN 't5-base' WHEN 1 THEN 'flan-t5-large' ELSE 'gpt-4' END AS model,
       CASE {_PK} % 2 WHEN 0 THEN 'zero-shot' ELSE 'few-shot' END AS setting,
       CASE q.table_id % 4 WHEN 0 THEN 'dev' WHEN 1 THEN 'tail' ELSE 'head' END AS split
FROM v_qa q
"""

V_TURNS = """
SELECT u.conv_id,
       u.turn,
       u.text AS question,
       a.text AS actual_answer,
       u.text AS predicted_answer
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""

# Crowd annotation batches: one assignment for every three line items of an
# order, three questions per assignment (an order without any has an empty one).
_BK = "(o.o_orderkey * 4 + coalesce(li.part, 0))"
_BC = _s("o.o_custkey")


def _batch_group(j: int) -> str:
    n = _s(f"CAST(li.q{j} AS BIGINT)")
    gold = f"{_s(f'o.o_custkey % 40 + {j}')}"
    answer = (f"CASE WHEN li.q{j} IS NULL THEN NULL ELSE (CASE ({_BK} + {j}) % 6 "
              f"WHEN 0 THEN {gold} || ' years' WHEN 1 THEN {gold} "
              f"WHEN 2 THEN 'over ' || {gold} || ' years' WHEN 3 THEN 'about ' || {gold} || ' (' || {gold} || ')' "
              f"WHEN 4 THEN {gold} || ' years, roughly' ELSE {n} END) END")
    return (f"'how many years was customer ' || {_BC} || ' active (q{j})?' AS question{j}, "
            f"{gold} || ' years' AS gold{j}, {answer} AS answer{j}, "
            f"'line {j} of order ' || {_s(_BK)} AS explanation{j}")


V_BATCHES = f"""
SELECT {_BK} AS row_id,
       {_s(f'{_BK} % 3')} AS batch,
       'A' || {_s(_BK)} AS assignment_id,
       'W' || {_s(f'{_BK} % 37')} AS worker_id,
       CASE WHEN {_BK} % 13 = 0 THEN 'Rejected' WHEN {_BK} % 17 = 0 THEN NULL ELSE 'Approved' END AS status,
       '<table><tr><th>customer</th><td>' || {_BC} || '</td></tr></table>' AS table_html,
       CASE WHEN {_BK} % 11 = 0 THEN 'customer ' || {_BC} WHEN {_BK} % 29 = 0 THEN NULL ELSE {_BC} END AS table_id,
       CASE WHEN {_BK} % 11 = 0 THEN {_BC} ELSE 'customer ' || {_BC} END AS name,
       'segment ' || {_s('o.o_custkey % 5')} AS category,
       {_batch_group(1)},
       CASE WHEN {_BK} % 2 = 0 THEN 'x' ELSE NULL END AS approve,
       CASE WHEN {_BK} % 13 = 0 THEN 'wrong' ELSE NULL END AS reject,
       {_batch_group(2)},
       {_batch_group(3)}
FROM orders o LEFT JOIN (
  SELECT l_orderkey, CAST(floor((l_linenumber - 1) / 3) AS INT) AS part,
         max(CASE WHEN l_linenumber % 3 = 1 THEN l_quantity END) AS q1,
         max(CASE WHEN l_linenumber % 3 = 2 THEN l_quantity END) AS q2,
         max(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END) AS q3
  FROM lineitem GROUP BY 1, 2) li ON li.l_orderkey = o.o_orderkey
"""

# Infobox tables: one per part.  Optional parts by key: caption, image row,
# a nested table, a repeated key, a section with a key/value row and two list
# rows, an empty section, a bold header with a font-weight key, a dash and a
# key of the section's own name, and a repeated section.
_PK2 = "p.p_partkey"
_PKS = _s(_PK2)
_PRICE = _s("CAST(floor(p.p_retailprice) AS BIGINT)")
_SIZE = _s("p.p_size")

V_INFOBOX = f"""
SELECT {_PK2} AS table_id,
       lower(p.p_type) AS category,
       '<table class="infobox">'
       || CASE WHEN {_PK2} % 3 <> 0 THEN '<caption>' || p.p_name || '</caption>' ELSE '' END
       || CASE WHEN {_PK2} % 4 = 0 THEN '<tr><td class="infobox-image"><img alt="' || p.p_name
              || ' photo" src="p.jpg"/></td></tr>' ELSE '' END
       || '<tr><th class="infobox-label">Brand</th><td class="infobox-data">' || p.p_brand || '</td></tr>'
       || '<tr><th class="infobox-label">Size</th><td class="infobox-data">' || {_SIZE} || '<br/>units</td></tr>'
       || '<tr><td><b>Price</b></td><td><abbr title="US dollars">$</abbr>' || {_PRICE} || '</td></tr>'
       || '<tr><td>Type:</td><td><i>' || lower(p.p_type) || '</i> part</td></tr>'
       || CASE WHEN {_PK2} % 6 = 1 THEN '<tr><td><table><tr><th>Inner</th><td>nested ' || {_PKS}
              || '</td></tr></table></td></tr>' ELSE '' END
       || CASE WHEN {_PK2} % 7 = 0 THEN '<tr><th>Brand</th><td>' || p.p_brand || ' (again)</td></tr>' ELSE '' END
       || CASE WHEN {_PK2} % 2 = 0 THEN '<tr><th colspan="2">Details</th></tr><tr><th>Container</th><td>box '
              || {_s(f'{_PK2} % 5')} || '</td></tr><tr><td colspan="2">part ' || {_PKS}
              || ' item one</td></tr><tr><td colspan="2">made&nbsp;in ' || p.p_brand || ':</td></tr>' ELSE '' END
       || CASE WHEN {_PK2} % 10 = 0 THEN '<tr><th>Notes</th></tr>' ELSE '' END
       || CASE WHEN {_PK2} % 15 = 1 THEN '<tr><td><b>Extra</b></td></tr><tr><td style="font-weight:bold">Span</td><td>1939–'
              || {_SIZE} || '</td></tr><tr><th>Extra</th><td>solo ' || {_PKS} || '</td></tr>' ELSE '' END
       || CASE WHEN {_PK2} % 21 = 2 THEN '<tr><th>Dup</th></tr><tr><th>k</th><td>1</td></tr><tr><th>Dup</th></tr><tr><th>j</th><td>2</td></tr>' ELSE '' END
       || '<tr><td colspan="2"></td></tr></table>' AS html
FROM part p
"""

# The same tables as stored nested JSON documents (the hosted-model input).
V_DOC = f"""
SELECT {_PK2} AS table_id,
       '{{"category": "' || lower(p.p_type) || '"'
       || CASE WHEN {_PK2} % 3 <> 0 THEN ', "caption": "' || p.p_name || '"' ELSE '' END
       || CASE WHEN {_PK2} % 4 = 0 THEN ', "infobox-image": "' || p.p_name || ' photo"' ELSE '' END
       || ', "Brand": "' || p.p_brand || CASE WHEN {_PK2} % 7 = 0 THEN ' (again)' ELSE '' END || '"'
       || ', "Size": "' || {_SIZE} || ' | units"'
       || ', "Price": "US dollars | ' || {_PRICE} || '"'
       || ', "Type": "' || lower(p.p_type) || ' |  part"'
       || CASE WHEN {_PK2} % 6 = 1 THEN ', "Inner": "nested ' || {_PKS} || '"' ELSE '' END
       || CASE WHEN {_PK2} % 2 = 0 THEN ', "Details": {{"Container": "box ' || {_s(f'{_PK2} % 5')}
              || '", "Details": ["part ' || {_PKS} || ' item one", "made in ' || p.p_brand || '"]}}' ELSE '' END
       || CASE WHEN {_PK2} % 10 = 0 THEN ', "Notes": {{}}' ELSE '' END
       || CASE WHEN {_PK2} % 15 = 1 THEN ', "Extra": {{"Span": "1939-' || {_SIZE} || '", "Extra": "solo ' || {_PKS} || '"}}' ELSE '' END
       || CASE WHEN {_PK2} % 21 = 2 THEN ', "Dup": {{"j": "2"}}' ELSE '' END
       || '}}' AS doc
FROM part p
"""

# Model-made triple files: one per supplier, in the shapes a hosted model
# returned (strict JSON, Python literal, envelopes, 'Object' key case,
# nested objects, the failure sentinel and a truncated reply).
def _triple(pred: str, obj: str, q: str = '"', okey: str = "object") -> str:
    return (f"'{{{q}subject{q}: {q}' || s.s_name || '{q}, {q}predicate{q}: {q}{pred}{q}, "
            f"{q}{okey}{q}: {q}' || {obj} || '{q}}}'")


_T2 = f"{_triple('nation', 'n.n_name')} || ', ' || {_triple('region', 'r.r_name')}"
_T2_PY = (f"{_triple('nation', 'n.n_name', q=chr(39) * 2)} || ', ' || "
          f"{_triple('region', 'r.r_name', q=chr(39) * 2)}")
_T2_CAP = (f"{_triple('nation', 'n.n_name', okey='Object')} || ', ' || "
           f"{_triple('region', 'r.r_name', okey='Object')}")
_T2_NESTED = ("'{\"subject\": \"' || s.s_name || '\", \"predicate\": \"location\", \"object\": "
              "{\"nation\": \"' || n.n_name || '\", \"region\": \"' || r.r_name || '\"}}, "
              "{\"subject\": \"' || s.s_name || '\", \"predicate\": \"codes\", \"object\": [\"' || "
              + _s("n.n_nationkey") + " || '\", \"' || " + _s("r.r_regionkey") + " || '\"]}'")

V_TRIPLES = f"""
SELECT s.s_suppkey AS table_id,
       CASE s.s_suppkey % 16
         WHEN 0 THEN '[' || {_T2} || ']'
         WHEN 8 THEN '[' || {_T2} || ']'
         WHEN 1 THEN '[' || {_T2_PY} || ']'
         WHEN 9 THEN '[' || {_T2_PY} || ']'
         WHEN 2 THEN '{{"knowledge_graph": [' || {_T2} || ']}}'
         WHEN 10 THEN '{{"graph": [' || {_T2} || ']}}'
         WHEN 3 THEN '{{"edges": [' || {_T2} || ']}}'
         WHEN 11 THEN '{{"result": [' || {_T2} || ']}}'
         WHEN 4 THEN '{{"knowledgeGraph": {{"nodes": [' || {_T2} || ']}}}}'
         WHEN 12 THEN '{{"triples": [' || {_T2} || ']}}'
         WHEN 5 THEN '[' || {_T2_CAP} || ']'
         WHEN 13 THEN '[' || {_T2_CAP} || ']'
         WHEN 6 THEN '[' || {_T2_NESTED} || ']'
         WHEN 14 THEN '[' || {_T2_NESTED} || ']'
         WHEN 7 THEN 'haa'
         ELSE '{{"knowledge_graph": [{{"subject": "' || s.s_name || '"'
       END AS kg
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

# Tables as JSON with numbers, and replies that name their table by its text: with the
# id, in the same text, with moved keys and other spellings of the numbers, as a Python
# literal, with other data, and as a text that is no JSON.
_TAIL = ", \"flags\": {{\"retail\": true, \"note\": null}}, \"tags\": [\"it''s\", 2.50, {{\"y\": 1, \"x\": {x}}}]}}"
_HEAD = f"'{{\"name\": \"' || p.p_name || '\", \"id\": ' || {_PKS} || ', \"size\": ' || {_SIZE} || ', \"price\": ' || {_PRICE} || '.00"
_DOC = _HEAD + _TAIL.format(x='"1.0"') + "'"
_DOC_OTHER = _HEAD + _TAIL.format(x="1.0") + "'"
_DOC_MOVED = (f"'{{\"tags\":[\"it''s\",2.5,{{\"x\":\"1.0\",\"y\":1.0}}],\"flags\":{{\"note\":null,\"retail\":true}},\"price\":' || {_PRICE} || ',\"size\":' || {_SIZE} "
              f"|| ',\"id\":' || {_PKS} || ',\"name\":\"' || p.p_name || '\"}}'")
_DOC_PYTHON = (f"'{{''id'': ' || {_PKS} || ', ''name'': ''' || p.p_name || ''', ''price'': ' || {_PRICE} || '.0, ''size'': ' || {_SIZE} "
               "|| ', ''flags'': {''retail'': True, ''note'': None}, ''tags'': [\"it''s\", 2.5, {''y'': 1, ''x'': ''1.0''}]}'")
_DOC_POWERS = (f"'{{\"size\": ' || {_SIZE} || '0e-1, \"price\": 0.' || {_PRICE} || 'E' || CAST(length({_PRICE}) AS STRING) || ', \"id\": ' || {_PKS} "
               "|| ', \"name\": \"' || p.p_name || '\", \"flags\": {\"retail\": true, \"note\": null}, \"tags\": [\"it''s\", 25e-1, {\"x\": \"1.0\", \"y\": 1}]}'")

V_TABLE_DOC = f"SELECT {_PK2} AS table_id, {_DOC} AS doc FROM part p"

V_REPLIES = f"""
SELECT {_PK2} AS reply_id,
       CASE WHEN {_PK2} % 8 = 0 THEN {_PK2} END AS table_id,
       CASE {_PK2} % 8 WHEN 1 THEN {_DOC_MOVED} WHEN 2 THEN {_DOC_PYTHON} WHEN 3 THEN {_DOC_POWERS} WHEN 4 THEN {_DOC_OTHER}
         WHEN 5 THEN '{{"name": "' || p.p_name ELSE {_DOC} END AS table_text,
       '[{{"subject": "' || p.p_name || '", "predicate": "size", "object": "' || {_SIZE} || '"}}]' AS kg
FROM part p
"""

# Tables as they arrive: some have no id, no row, or a document that is cut off; some
# parts have no document at all.
V_INTAKE = f"""
SELECT CASE WHEN {_PK2} % 19 = 0 THEN NULL ELSE {_PK2} END AS table_id,
       CASE WHEN {_PK2} % 17 = 0 THEN '<p>' || p.p_name || '</p>' ELSE '<table><tr><th>Size</th><td>' || {_SIZE} || '</td></tr></table>' END AS html,
       lower(p.p_type) AS category
FROM part p
"""

V_INTAKE_DOC = f"""
SELECT {_PK2} AS table_id, CASE WHEN {_PK2} % 23 = 0 THEN '{{"name": "' || p.p_name ELSE '{{"name": "' || p.p_name || '", "Facts": {{"size": "' || {_SIZE} || '"}}}}' END AS doc
FROM part p WHERE {_PK2} % 31 <> 0
"""

# Answers as the Python list literals of a CSV cell: both quote styles, escapes, number
# words, ordinals, parentheses, currency and percent signs, ties, empty lists and cells
# that are no list.  chr(92) is the backslash (a literal one is read differently by the
# two engines).
_N = "CAST(o.o_orderkey % 30 + 1 AS STRING)"
_WORD = "CASE o.o_orderkey % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'five' WHEN 2 THEN 'seven' WHEN 3 THEN 'nine' ELSE 'january' END"
_B = "chr(92)"
LIST_GOLDS = [f"{_N} || ' years'", f"'About ' || {_N} || ' (approx)'", f"'US$' || {_N} || '.'", f"{_WORD} || ' years'", f"{_N} || 'th'", f"'~' || {_N} || '%'"]
LIST_ITEMS = [
    [],
    [f"{_N} || ' years'", f"{_N}", "'x y'", f"'it was ' || {_N} || ', maybe'"],
    ["'b'", "'a'", "'a'", "'b'"],
    [f"'it''s ' || {_N}", f"'it''s ' || {_N}", "'say \"hi\"' || chr(10) || 'caf' || chr(233)", f"'back' || {_B} || 'slash' || chr(9) || chr(8203)"],
    [f"{_N} || 'st'", f"{_WORD}", f"{_WORD} || ' years'", "'us$5'", "'5.'", "'5%'"],
    [f"{_N}", "'-2.5'", "'None'"],
]
LIST_TEXTS = [
    "'[ ]'",
    f"'[''' || {_N} || ' years'', ''' || {_N} || ''', \"x y\", ''it was ' || {_N} || ', maybe'']'",
    "'[\"b\",\"a\",''a'',''b'',]'",
    f"'[\"it''s ' || {_N} || '\", ''it' || {_B} || '''s ' || {_N} || ''', ''say \"hi\"' || {_B} || 'ncaf' || {_B} || 'xe9'', \"back' || {_B} || {_B} || 'slash' || {_B} || 't' || {_B} || 'u200b\"]'",
    f"'[''' || {_N} || 'st'', ''' || {_WORD} || ''', ''' || {_WORD} || ' years'', ''us$5'', ''5.'', ''5%'']'",
    f"'[' || {_N} || ', -2.5, None]'",
    "NULL",
    "'[''cut off'",
]

V_LISTS = f"""
SELECT o.o_orderkey AS row_id,
       CASE o.o_orderkey % 6 {" ".join(f"WHEN {i} THEN {g}" for i, g in enumerate(LIST_GOLDS))} END AS gold_answer,
       CASE CAST(floor(o.o_orderkey / 6) AS BIGINT) % 8 {" ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(LIST_TEXTS))} END AS answers
FROM orders o
"""

# A JSON and an HTML document per supplier, for folders of files.
V_SUPPLIER_FILES = """
SELECT s.s_suppkey AS table_id,
       '{"name": "' || s.s_name || '", "place": {"nation": "' || n.n_name || '", "region": "' || r.r_name || '"}}' AS doc,
       '<table><tr><th>Name</th><td>' || s.s_name || '</td></tr>' || chr(10) || '<tr><th>Region</th><td>' || r.r_name || '</td></tr></table>' AS html
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

# Split lists (the reference keeps literal category -> ids dicts): the split
# assignment rule here lists every tenth table as test and every tenth+1
# (plus every fiftieth, so that some ids sit in both lists) as dev.
V_SPLITS = """
SELECT 'test' AS split, category, table_id FROM (SELECT DISTINCT category, table_id FROM v_qa) t
WHERE table_id % 10 = 0
UNION ALL
SELECT 'dev' AS split, category, table_id FROM (SELECT DISTINCT category, table_id FROM v_qa) t
WHERE table_id % 10 = 1 OR table_id % 50 = 0
"""

VIEWS = {
    "v_splits": V_SPLITS,
    "v_triples": V_TRIPLES,
    "v_supplier_files": V_SUPPLIER_FILES,
    "v_lists": V_LISTS,
    "v_intake": V_INTAKE,
    "v_intake_doc": V_INTAKE_DOC,
    "v_table_doc": V_TABLE_DOC,
    "v_replies": V_REPLIES,
    "v_infobox": V_INFOBOX,
    "v_doc": V_DOC,
    "v_batches": V_BATCHES,
    "v_qa": V_QA,
    "v_pred": V_PRED,
    "v_turns": V_TURNS,
}
VIEW_DEPS = {"v_pred": ["v_qa"], "v_splits": ["v_qa"]}
VIEW_TABLES = {
    "v_splits": ["orders", "customer"],
    "v_triples": ["supplier", "nation", "region"],
    "v_infobox": ["part"],
    "v_supplier_files": ["supplier", "nation", "region"],
    "v_lists": ["orders"],
    "v_intake": ["part"],
    "v_intake_doc": ["part"],
    "v_table_doc": ["part"],
    "v_replies": ["part"],
    "v_doc": ["part"],
    "v_batches": ["orders", "lineitem"],
    "v_qa": ["orders", "customer"],
    "v_pred": ["orders", "customer"],
    "v_turns": ["conversations"],
}


def view_sql(name: str) -> str:
    return VIEWS[name]


def with_clause(names) -> str:
    """``WITH v AS (...), ...`` for the oracle, dependencies first."""
    order: list[str] = []

    def add(n):
        for d in VIEW_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture view as a Spark DataFrame over the tables at ``sf_dir``."""
    register_tables(spark, sf_dir, VIEW_TABLES[name])
    for dep in VIEW_DEPS.get(name, []):
        spark.sql(VIEWS[dep]).createOrReplaceTempView(dep)
    return spread(spark.sql(VIEWS[name]), *[table(spark, sf_dir, t) for t in VIEW_TABLES[name]])
