"""Row accounting, subtotals, sketches and document folders on handmade rows."""

import pytest
from pyspark.sql import functions as F

from kvlens.operators import accounting as C
from kvlens.operators import infobox as H
from kvlens.operators import scoring as S
from kvlens.operators import splits as SP
from kvlens.sources import tables
from kvlens.sources.tables import read_docs, write_docs


def test_every_row_has_an_outcome(spark):
    tables = spark.createDataFrame([(1, "c", "<table><tr><th>A</th><td>b</td></tr></table>"), (None, "c", "<table><tr><td>x</td></tr></table>"), (2, "c", "<p>no rows</p>"), (3, "c", None)], "table_id long, category string, html string")
    read, counts = C.html_tables(tables.repartition(3))
    assert counts == [("html_tables", "read", 1), ("html_tables", "no_rows", 2), ("html_tables", "no_table_id", 1)]
    assert {r.table_id: r.outcome for r in read.collect()} == {1: "read", 2: "no_rows", 3: "no_rows", None: "no_table_id"}
    docs, counts = C.documents(spark.createDataFrame([(1, '{"a":"1"}'), (2, "["), (3, None)], "table_id long, doc string"))
    assert counts == [("documents", "ok", 1), ("documents", "malformed", 2)]
    text = H.linearise(docs.where("status = 'ok'"))
    bound, counts = C.questions(spark.createDataFrame([(1, "q"), (2, "q"), (None, "q")], "table_id long, question string"), text)
    assert counts == [("questions", "bound", 1), ("questions", "missing_table", 2)] and bound.count() == 3
    _, counts = C.written(spark.range(5), "odd", F.when(F.col("id") > 2, "big"), ["big", "small"])
    assert counts == [("odd", "big", 2), ("odd", "small", 0), ("odd", "other", 3)]
    empty, counts = C.written(spark.range(0), "none", F.lit("x"), ["x"])
    assert counts == [("none", "x", 0)] and empty.count() == 0


def test_subtotals_and_the_total_of_nothing(spark):
    rows = [("m1", "a", "x", "1", "1"), ("m1", "a", "y", "1", "2"), ("m1", "b", "x", "1", "1"), (None, "b", "x", "1", "3")]
    df = spark.createDataFrame(rows, "model string, setting string, split string, actual_answer string, predicted_answer string")
    got = {(r.model, r.setting, r.split, r.level): (r.n, r.exact) for r in S.subtotals(df).collect()}
    assert got[(None, None, None, 3)] == (4, 50.0) and got[("m1", None, None, 2)] == (3, 66.666667) and got[("m1", "a", None, 1)] == (2, 50.0)
    assert got[(None, None, None, 2)] == (1, 0.0)  # the model that is NULL, not the total
    assert len(got) == 4 + 3 + 2 + 1
    assert [tuple(r) for r in S.subtotals(df.where("false")).collect()] == [(None, None, None, 3, 0, None, None, None, None)]


def test_sketches_merge(spark):
    qa = spark.range(60_000).selectExpr("id % 20000 AS table_id", "'q' || id AS question", "CASE WHEN id % 20000 < 15000 THEN 'big' ELSE 'small' END AS category")
    parts = [SP.category_sketches(qa.where(f"table_id % 4 = {b} OR table_id % 3 = 0")) for b in range(4)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = {r.category: r for r in SP.sketch_counts(SP.merge_sketches(merged)).collect()}
    for category, tables, questions in (("big", 15_000, 45_000), ("small", 5_000, 15_000)):
        assert abs(got[category].n_tables - tables) <= SP.sketch_error() * tables
        assert abs(got[category].n_questions - questions) <= SP.sketch_error() * questions


def test_documents_of_many_lines_come_back_whole(spark, tmp_path):
    docs = [(7, "a\n\n b"), (8, ""), (9, '{"x":\n1}')]
    write_docs(spark.createDataFrame([*docs, (None, "lost")], "table_id long, doc string"), f"{tmp_path}/d")
    assert sorted((r.table_id, r.doc) for r in read_docs(spark, f"{tmp_path}/d/*/*.txt").collect()) == docs


def test_shelves_of_docs_come_from_one_task_each(spark, tmp_path):
    """A commit moves a shelf as a whole and a scan lists it in one task, however many documents it holds."""
    docs = [(i, f"d{i}") for i in range(400)]
    write_docs(spark.createDataFrame([*docs, (None, "lost")], "table_id long, doc string"), f"{tmp_path}/d", shelves=True)
    shelves = [[f.name.split("-")[1] for f in s.glob("table_id=*/*.txt")] for s in (tmp_path / "d").glob("shelf=*")]
    assert 32 < len(shelves) <= 64 and sum(map(len, shelves)) == 400
    assert all(len(set(tasks)) == 1 for tasks in shelves)
    assert sorted((r.table_id, r.doc) for r in read_docs(spark, f"{tmp_path}/d", shelves=True).collect()) == docs


def test_documents_are_written_as_sparks_text_sink_does(spark, tmp_path, monkeypatch):
    """Also a document without text, one that is not ASCII, and several of one id; a folder that is there stays."""
    docs = spark.createDataFrame([(1, None), (2, "é\n"), (3, "a"), (3, "a"), (-4, ""), (None, "lost")], "table_id long, doc string")
    read = lambda d: sorted((str(f.parent.relative_to(d)), f.read_bytes()) for f in d.rglob("*.txt"))
    for shelves in (False, True):
        write_docs(docs, f"{tmp_path}/own-{shelves}", shelves=shelves)
        with monkeypatch.context() as m:
            m.setattr(tables, "_mounted", lambda *_: None)
            write_docs(docs, f"file://{tmp_path}/spark-{shelves}", shelves=shelves)
        assert read(tmp_path / f"own-{shelves}") == read(tmp_path / f"spark-{shelves}") != []
    assert tables._mounted(spark, f"file://{tmp_path}/x y") == tables._mounted(spark, f"{tmp_path}/x y") == f"{tmp_path}/x y"
    with pytest.raises(FileExistsError):
        write_docs(docs, f"{tmp_path}/own-True")
