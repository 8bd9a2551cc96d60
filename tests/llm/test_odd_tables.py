"""Near-duplicates of repeated ids, clashing names and whole pipeline runs on odd tables."""

import random

import corpus_pipeline
from kvlens.llm import line_dedup, minhash_dedup

SF = "/root/testdata/sf0.001"


def components_of_rows(rows, k, percent):
    """Smallest id reachable per id: rows of one id, and rows of near sets, belong together."""
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = []
    for i, t in rows:
        w = t.split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    for i, s in sets:
        for j, t in sets:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_ids_on_rows_of_several_texts(spark):
    """Twenty small tables in one, each with words and ids of its own."""
    rows, want = [], {}
    for seed in range(20):
        r = random.Random(seed)
        words = [f"s{seed}w{i}" for i in range(30)]
        bases = [" ".join(r.choice(words) for _ in range(40)) for _ in range(3)]
        near = lambda t: " ".join(w if r.random() > 0.02 else "zz" for w in t.split())  # noqa: B023, E731
        mine = [(100 * seed + r.randint(1, 12), r.choice([x, x, near(x), ""])) for x in r.choices(bases, k=16)]
        mine += [(100 * seed + 20, near(bases[0])), (100 * seed + 1, bases[1]), (100 * seed + 1, bases[0])]
        rows += mine
        want |= components_of_rows(mine, 3, 85)
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, same string, rep long").repartition(4)
    got = minhash_dedup.near_duplicates(df, k=3, percent=85).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["n_shingles"]} == {i: c for i, c in want.items() if any(j == i and t for j, t in rows)}


CLASHES = ["src", "asked", "doc", "__runs", "runs", "id", "body", "rest", "line", "n", "key", "from", "at", "lines", "removed", "n_lines", "n_removed", "row", "label", "rep"]


def passages(seed):
    r = random.Random(seed)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)) + "."
    shared = "\n".join(say(14) for _ in range(4))
    texts = ["\n".join([say(9), shared, say(8), say(12)]) for _ in range(3)] + [None, "", "  ", "one line", say(4000)]
    return [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])], shared


def test_any_extra_column_passes_through_line_dedup(spark):
    rows, shared = passages(1)
    df = spark.createDataFrame([(i, t, *[f"{c}-{n}" for c in CLASHES]) for n, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)
    got = line_dedup.remove_repeated(df, n_lines="__lines", n_removed="__removed")
    assert got.columns == [*df.columns, "__lines", "__removed"]
    out = got.collect()
    assert len(out) == len(rows) and all(r[c].startswith(f"{c}-") for r in out for c in CLASHES)
    assert sum(shared.split("\n")[1] in (r["text"] or "") for r in out) == 1
    counted = line_dedup.remove_repeated(df)
    assert sorted(counted.columns) == sorted(df.columns) and dict(counted.dtypes)["n_removed"] == "bigint"
    assert line_dedup.remove_repeated(df.where("false")).collect() == []
    plain = line_dedup.remove_repeated(df.select("doc_id", "text"))
    assert plain.columns == ["doc_id", "text", "n_lines", "n_removed"] and plain.count() == len(rows)


def test_whole_pipeline_on_an_odd_table(spark, tmp_path):
    """Nulls, repeated rows, clashing names: every id of the last near-dedup stage is packed whole, once a row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows, _ = passages(2)
    odd = spark.createDataFrame([(None if i is None else 10_000 + i, t, None, None, None) for i, t in rows], docs.schema)
    both = docs.unionByName(odd).unionByName(docs.limit(5))
    for c in CLASHES:
        both = both.selectExpr("*", f"'x' AS `{c}`")
    both.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, stage, str(tmp_path))
        assert after.columns == both.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted((r["doc_id"] for r in stage.collect()), key=str)
    assert sorted((p["doc_id"] for p in pieces if p["start"] == 0), key=str) == want
    length = {}
    for p in pieces:
        length[p["doc_id"]] = length.get(p["doc_id"], 0) + p["length"]
    rows_of_id = {i: want.count(i) for i in set(want)}
    whole = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert all(length[i] == whole[i] * n for i, n in rows_of_id.items() if i is not None)
    room = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == room.get(p["sequence_id"], 0)
        room[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(room.values()) <= 1024


def test_whole_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
