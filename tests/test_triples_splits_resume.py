"""Triples (K1-K5), splits (W1, J6 leak switch) and resume."""

import tempfile

from pyspark.sql import functions as F

from kvlens.operators import resume as R
from kvlens.operators import splits as SP
from kvlens.operators import triples as K
from kvlens.streaming.resumable import read_sink, run_available


def test_triple_envelopes_and_status(spark):
    rows = [
        (1, '[{"subject": "a", "predicate": "p", "object": "o"}]'),
        (2, "[{'subject': 'a', 'predicate': 'p', 'Object': 'o'}]"),
        (3, '{"edges": [{"subject": "a", "predicate": "p", "object": "o"}]}'),
        (4, '{"knowledgeGraph": {"nodes": [{"subject": "a", "predicate": "p", "object": "o"}]}}'),
        (5, '{"other": [{"subject": "a", "predicate": "p", "object": "o"}]}'),
        (6, "haa"),
        (7, '{"knowledge_graph": [{"subject": "a"'),
        (8, '[{"subject": "a", "predicate": "p", "object": ["x", "y"]}]'),
    ]
    df = spark.createDataFrame(rows, "table_id long, kg string")
    st = {r.table_id: r.status for r in K.unwrap(df).collect()}
    assert st == {1: "ok", 2: "ok", 3: "unwrapped", 4: "unwrapped", 5: "unresolved", 6: "failed",
                  7: "unparsable", 8: "ok"}
    ex = K.explode_triples(K.unwrap(K.drop_failed(df))).orderBy("table_id", "object_pos").collect()
    assert [(r.table_id, r.object, r.object_kind, r.object_pos) for r in ex] == [
        (1, "o", "string", 0), (2, "o", "string", 0), (3, "o", "string", 0), (4, "o", "string", 0),
        (8, "x", "list", 1), (8, "y", "list", 2)]


def test_first_seen_ids_dense_in_first_appearance_order(spark):
    df = spark.createDataFrame([(5, "c"), (1, "b"), (3, "a"), (2, "b"), (9, "c"), (0, "d")],
                               "row_id long, t string").repartition(3)
    ids = {r.t: r.table_seq for r in SP.first_seen_ids(df, "t").collect()}
    assert ids == {"d": 0, "b": 1, "a": 2, "c": 3}


def _qa(spark):
    rows = [(1, 10, "x", "q1", "a1"), (2, 10, "x", "q1", "a1b"), (3, 11, "y", "q2", "a2"),
            (4, 12, "tailcat", "q3", "a3"), (5, 13, "x", "q4", "a4")]
    return spark.createDataFrame(rows, "row_id long, table_id long, category string, question string, answer string")


def test_train_excludes_listed_and_sentinel_and_tail_switch(spark):
    qa = _qa(spark)
    ids = spark.createDataFrame([("test", "x", 10), ("dev", "y", 11)], "split string, category string, table_id long")
    faithful = SP.train_rows(qa, ids, sentinel_table_id=SP.last_table(qa), tail_categories=("tailcat",))
    assert sorted(r.table_id for r in faithful.collect()) == [12]           # tail leaks, 13 is the last table
    clean = SP.train_rows(qa, ids, exclude_tail=True, tail_categories=("tailcat",))
    assert sorted(r.table_id for r in clean.collect()) == [13]
    last = {(r.table_id, r.question): r.answer for r in SP.last_answers(qa).collect()}
    assert last[(10, "q1")] == "a1b"                                        # last write wins
    ev = SP.eval_rows(qa, ids, ("tailcat",)).collect()
    assert sorted((r.split, r.table_id) for r in ev) == [("dev", 11), ("tail", 12), ("test", 10)]


def test_pending_by_key(spark):
    qa = _qa(spark)
    done = spark.createDataFrame([(10, "q1", "p"), (11, "q2", "haa")],
                                 "table_id long, question string, predicted_answer string")
    left = R.pending(qa, R.successful(done))
    assert sorted(r.table_id for r in left.collect()) == [11, 12, 13]      # failed reply is retried


def test_resumable_stream_exactly_once(spark):
    base = tempfile.mkdtemp(prefix="kvlens-test-resume-", dir="/tmp")
    src, sink, ckpt = f"{base}/src", f"{base}/sink", f"{base}/ckpt"
    qa = _qa(spark)

    def process(batch):
        return batch.select("row_id", F.upper("answer").alias("out"))

    qa.where(F.col("row_id") <= 2).write.mode("append").parquet(src)
    run_available(spark, src, sink, ckpt, qa.schema, process, keys=["row_id"])
    assert read_sink(spark, sink).count() == 2
    qa.where(F.col("row_id") > 2).write.mode("append").parquet(src)
    run_available(spark, src, sink, ckpt, qa.schema, process, keys=["row_id"])
    run_available(spark, src, sink, ckpt, qa.schema, process, keys=["row_id"])   # nothing new
    out = read_sink(spark, sink).collect()
    assert sorted(r.row_id for r in out) == [1, 2, 3, 4, 5]
