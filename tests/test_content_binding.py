"""Canonical JSON and the join of replies to tables by content."""

import json
import random

from kvlens.functions.jsonform import canonical_json
from kvlens.operators import triples as K

from conftest import one


def shuffled(r, x):
    """The same data with other key orders and number spellings, as JSON text."""
    if isinstance(x, dict):
        keys = list(x)
        r.shuffle(keys)
        return "{" + ", ".join(json.dumps(k) + r.choice([":", " : "]) + shuffled(r, x[k]) for k in keys) + "}"
    if isinstance(x, list):
        return "[" + ",".join(shuffled(r, y) for y in x) + "]"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return r.choice([json.dumps(x), f"{x}.0" if isinstance(x, int) else f"{x}0", f"{x}e0", f"{x * 10}e-1" if isinstance(x, int) else json.dumps(x)])
    return json.dumps(x, ensure_ascii=r.random() < 0.5)


def made(r, depth=0):
    kind = r.randint(0, 7 if depth < 4 else 5)
    if kind == 6:
        return [made(r, depth + 1) for _ in range(r.randint(0, 3))]
    if kind == 7:
        return {r.choice("abcdeé'1") + str(i): made(r, depth + 1) for i in range(r.randint(0, 4))}
    return r.choice([None, True, False, r.randint(-999, 999), 10**15, 0.5, -2.25, "1.0", "x 1e5 y", "it's", 'q"\\z', "", "ünï\n", "True"])


def test_equal_data_has_one_text_and_other_data_another(spark):
    r = random.Random(7)
    docs = [made(r) for _ in range(150)]
    a = one(spark, canonical_json, [json.dumps(d) for d in docs])
    b = one(spark, canonical_json, [shuffled(r, d) for d in docs])
    assert a == b
    assert [json.loads(x) for x in a] == docs
    assert len(set(a)) == len({json.dumps(d, sort_keys=True) for d in docs})


def test_spellings(spark):
    texts = ["{'a': True, 'b': None, 'c': 'None True'}", '{"c":"None True","b":null,"a":true}', '{"a":1,"a":2}', "nope", None, "", "[1e25]", "[10000000000000000000000000.0]", "[-0.0, 0, 1E+2]",
             '{"t": "' + "x" * 200_000 + '\\\\"}']
    got = one(spark, canonical_json, texts)
    assert got[0] == got[1] == '{"a":true,"b":null,"c":"None True"}'
    assert got[2:6] == [None] * 4 and got[6] == got[7] and got[8] == "[0,0,100]" and len(got[9]) > 200_000


def test_replies_find_their_tables(spark):
    docs = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"b": {"c": "x"}, "a": 1.0}'), (3, '{"a": 2}'), (4, None), (5, "broken")], "table_id long, doc string")
    replies = spark.createDataFrame([(10, 7, None, "k"), (11, None, "{'b': {'c': 'x'}, 'a': 1}", "k"), (12, None, '{"a": 2, "b": 3}', "k"), (13, None, None, "k"), (14, None, "broken", "k")],
                                    "reply long, table_id long, table_text string, kg string")
    got = sorted((r.reply, r.table_id, r.bound_by) for r in K.bind_tables(replies, docs).collect())
    assert sorted(got, key=repr) == sorted([(10, 7, "key"), (11, 1, "content"), (11, 2, "content"), (12, None, "none"), (13, None, "none"), (14, None, "none")], key=repr)
