"""Inputs that the fixture views do not hold: broken markup, odd replies, hot sums."""

import shutil

from pyspark.sql import functions as F

from kvlens.functions.htmlrows import parse_table
from kvlens.functions.text import time_canonical
from kvlens.operators import infobox as I
from kvlens.operators.scoring import mean6
from kvlens.operators.annotate import group_lists
from kvlens.operators.prompts import windows
from kvlens.operators.triples import unwrap
from kvlens.sources.tables import read_csv_glob, read_docs
from kvlens.streaming.resumable import read_sink, run_available

from conftest import one


def test_unclosed_cells_close_implicitly():
    _, rows = parse_table("<table><tr><th>A<td>b<tr><th>C<td>d</table>")
    assert [(r["n_th"], r["n_td"], r["th_pieces"], r["td1_pieces"]) for r in rows] == [(1, 1, ["A"], ["b"]), (1, 1, ["C"], ["d"])]


def test_nested_table_keeps_its_own_rows():
    _, rows = parse_table("<table><tr><td><table><tr><td>x</td></tr></table></td><td>y</td></tr></table>")
    assert [r["n_td"] for r in rows] == [3, 1] and rows[0]["has_nested"]


def test_deep_markup_parses():
    _, rows = parse_table("<table><tr><td>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</td></tr></table>")
    assert rows[0]["td1_pieces"] == ["deep"]


def test_null_table_id_is_left_out(spark):
    df = spark.createDataFrame([(None, "<table><tr><td>a</td></tr></table>"), (7, "<table><tr><td>b</td></tr></table>")], "table_id long, html string")
    assert [r["table_id"] for r in I.parse_tables(df).collect()] == [7]


def test_repeated_json_key_keeps_the_document(spark):
    df = spark.createDataFrame([(1, '{"s":{"k":"1","k":"2"},"b":"x","b":"y"}'), (2, '{"a":"1'), (3, '{"a":"1"}')], "table_id long, doc string")
    assert {r["table_id"] for r in I.read_documents(df).collect()} >= {1, 3}
    assert {r["table_id"]: r["status"] for r in I.nested_documents(df).collect()} == {1: "ok", 2: "malformed", 3: "ok"}


def test_empty_reply_is_unresolved(spark):
    df = spark.createDataFrame([("[]",), ('[{"subject":"a","object":"b"}]',)], "kg string")
    assert [r["status"] for r in unwrap(df).collect()] == ["unresolved", "ok"]


def test_other_digits_do_not_abort(spark):
    assert one(spark, time_canonical, ["٣:٣٠ pm", "3:30 pm"])[1] == "15:30"


def test_means_hold_many_rows(spark):
    df = spark.range(100_000_000).select(F.lit(1.0).alias("x"))
    assert df.agg(mean6(F.col("x"), 100.0).alias("m")).first()["m"] == 100.0


def test_stream_keeps_a_key_once_over_batches(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    for batch in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")], [(1, "a")]):
        df = spark.createDataFrame(batch, "k int, v string")
        df.coalesce(1).write.mode("append").parquet(src)
        run_available(spark, src, sink, ckpt, df.schema, lambda b: b, keys=["k"])
    assert sorted(map(tuple, read_sink(spark, sink).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_batches_cost_their_own_rows_and_replays_rewrite(spark, tmp_path):
    """20 batches of 50 new and 50 old keys: each stores its 50 new ones; the last
    batch, replayed as after a crash before its commit, writes the same rows."""
    src, sink, ckpt, again = (str(tmp_path / x) for x in ("src", "sink", "ckpt", "again"))
    schema = "k long, v string"

    def process(rows):
        return rows.where("v <> 'failed'")

    for n in range(20):
        keys = [*range(50 * n, 50 * n + 50), *range(max(0, 50 * n - 50), 50 * n)]
        rows = [(k, "failed" if n == 3 and k == 150 else f"{n}") for k in keys]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        progress = run_available(spark, src, sink, ckpt, schema, process, keys=["k"])
        state = [p["stateOperators"][0] for p in progress if p["numInputRows"]]
        assert [s["numRowsUpdated"] for s in state] == [49 if n == 3 else 51 if n == 4 else 50]
    done = sorted(r.k for r in read_sink(spark, sink).collect())
    assert done == list(range(1000))  # the failed key came again and was written then
    last = max(int(x.name) for x in (tmp_path / "ckpt" / "commits").iterdir() if x.name.isdigit())
    shutil.copytree(ckpt, again, ignore=lambda d, names: [x for x in names if d.endswith("commits") and x.strip(".").split(".")[0] == str(last)])
    run_available(spark, src, sink, again, schema, process, keys=["k"])
    assert sorted(r.k for r in read_sink(spark, sink).collect()) == done


def test_csv_batches_bind_by_their_own_header(spark, tmp_path):
    (tmp_path / "a 1.csv").write_text('q,g,a\nq1,g1,"two\nlines"\nq2,,a2\n')
    (tmp_path / "b.csv").write_text("a,extra,q\n" + "".join(f"a{i},x,q{i}\n" for i in range(3, 400)))
    (tmp_path / "c.csv").write_text("q,a\nq400,a400\n")
    (tmp_path / "d.csv").write_text("")
    rows = read_csv_glob(spark, f"{tmp_path}/*.csv", "q STRING, g STRING, a STRING").orderBy("row_id").collect()
    assert [(r.q, r.a) for r in rows] == [("q1", "two\nlines"), *[(f"q{i}", f"a{i}") for i in range(2, 401)]]
    assert [r.g for r in rows] == ["g1", *[None] * 399] and len({r.row_id for r in rows}) == 400


def test_documents_are_read_by_file_name(spark, tmp_path):
    for name, text in (("7.json", '{"b":"x","a":{"k":"1"}}'), ("table_8.json", '{"c":"y"}'), ("9.html", "<table>\n<tr><th>A<td>b</table>"),
                       ("10.txt", '[{"subject":"s","predicate":"p","object":"o"}]')):
        (tmp_path / name).write_text(text)
    docs = I.read_documents(read_docs(spark, f"{tmp_path}/*.json"))
    assert {(r.table_id, r.section, r.key, r.value) for r in docs.collect()} == {(7, None, "b", "x"), (7, "a", "k", "1"), (8, None, "c", "y")}
    html = I.parse_tables(read_docs(spark, f"{tmp_path}/*.html", "html")).select("table_id", F.inline("rows")).collect()
    assert [(r.table_id, r.th_pieces, r.td1_pieces) for r in html] == [(9, ["A"], ["b"])]
    assert [(r.table_id, r.status) for r in unwrap(read_docs(spark, f"{tmp_path}/*.txt", "kg")).collect()] == [(10, "ok")]


def test_windows_lose_no_token(spark):
    prompt, answer = " ".join(f"w{i}" for i in range(10)), "x y z"
    df = spark.createDataFrame([("dev", 1, "q", prompt, answer), ("dev", 2, "q", "", "")], "split string, table_id long, question string, prompt string, answer string")
    rows = windows(df, 4, 2).orderBy("table_id", "part").collect()
    assert [r.part for r in rows] == [0, 1, 2, 0]
    assert " ".join(r.input for r in rows[:3]) == prompt and [r.target for r in rows[:3]] == ["x y", "z", ""]
    assert rows[0].input_over and rows[0].target_over and not rows[3].input_over


def test_parts_of_a_hot_group_are_its_whole_lists(spark):
    df = spark.range(1000).selectExpr("id AS row_id", "'q' AS question", "'1' AS table_id", "'A' || id AS assignment_id", "'W' AS worker_id",
                                      "CASE WHEN id % 7 = 0 THEN NULL ELSE 'a' || id END AS answer", "'e' AS explanation").repartition(5)
    parts = group_lists(df, span=6).orderBy("part").collect()
    assert max(len(r.answers) for r in parts) == 64 and len(parts) == 16
    assert [a for r in parts for a in r.answers] == [None if i % 7 == 0 else f"a{i}" for i in range(1000)]
    assert [a for r in parts for a in r.assignment_ids] == [f"A{i}" for i in range(1000)]


def test_dashes_become_hyphens(spark):
    df = spark.createDataFrame([("1939\u20131945 \u2014 war",), (None,)], "html string")
    assert [r.html for r in I.normalise_dashes(df).collect()] == ["1939-1945 - war", None]


def test_repeated_section_and_name_clash(spark):
    """A section replaces an earlier flat value and an earlier section of its name."""
    html = ("<table><tr><th>S</th><td>flat</td></tr><tr><th>S</th></tr><tr><th>k</th><td>1</td></tr>"
            "<tr><th>T</th></tr><tr><th>k</th><td>2</td></tr><tr><th>S</th></tr><tr><th>j</th><td>3</td></tr></table>")
    df = spark.createDataFrame([(1, "c", html)], "table_id long, category string, html string")
    kv = I.key_values(df).where("kind <> 'flat'").orderBy("ord", "sub_ord").collect()
    assert [(r.section, r.key, r.value) for r in kv] == [("S", "j", "3"), ("T", "k", "2")]
