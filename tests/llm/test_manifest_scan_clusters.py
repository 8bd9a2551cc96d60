"""Merkle manifest, benchmark scan and heap k-means against brute force on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kvlens.llm import benchmark_scan, heap_kmeans, merkle_manifest

LOWER = {i: i + 32 for i in range(65, 91)}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, n string, idx long, grp string, leaf string, path string, digest string"


def doc_rows():
    r = random.Random(1)
    rows = []
    for lang, n in (("en", 150), ("de", 9), ("ß", 8), ("", 3), (None, 65), ("one", 1), ("a", 64)):
        for i in range(n):
            text = r.choice([None, "", "Ä B", "x" * 3000, f"Word {i}"])
            rows.append((r.choice([None, 7, i, i * 1000 - 5]), text, lang, r.choice([None, "s", "S:1"]), r.choice([None, 0, -3])))
    rows += [rows[0]] * 20 + [(5, "Same", "a", "s", 1)] * 70
    r.shuffle(rows)
    return rows


def docs_df(spark, rows):
    return spark.createDataFrame([(*x, "r", "n", 1, "g", "l", "p", "d") for x in rows], DOCS).repartition(5)


def manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of every row, by recursion over lists."""
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, la, s, n: sha(f(d) + f(s) + f(la) + f(n) + f(t))

    def climb(level):
        """Top, and per leaf the (left, right) of every level."""
        paths, at = [[] for _ in level], [[i] for i in range(len(level))]
        while len(level) > 1:
            for i, members in enumerate(at):
                run = i // 8 * 8
                for m in members:
                    paths[m].append((level[run:i], level[i + 1 : run + 8]))
            at = [sum(at[i : i + 8], []) for i in range(0, len(at), 8)]
            level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        return level[0], paths

    langs = collections.defaultdict(list)
    for row in rows:
        langs[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    below = {la: (sorted(langs[la], key=lambda x: x[:3]), *climb([x[2] for x in sorted(langs[la], key=lambda x: x[:3])])) for la in order}
    root, above = climb([below[la][1] for la in order])
    out = []
    for la, up in zip(order, above):
        leaves, subroot, paths = below[la]
        for (_, _, own, row), path in zip(leaves, paths):
            path = path + up
            at = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                at = leaf(row[0], row[1] and row[1].translate(LOWER), *row[2:])
            for left, right in path:
                at = sha("".join([*left, at, *right]))
            out.append((row[0], own, subroot, root, sha("".join(x for p in path for side in p for x in side)), at, at == root))
    return out


def test_manifest_equals_recursion_over_lists(spark):
    rows = doc_rows()
    got = [tuple(r) for r in merkle_manifest.audit(docs_df(spark, rows)).collect()]
    want = manifest(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = [(3, "T", None, None, 1)]
    assert [tuple(r) for r in merkle_manifest.audit(docs_df(spark, one)).collect()] == manifest(one)
    assert merkle_manifest.audit(docs_df(spark, one).where("false")).collect() == []


def test_manifest_proves_a_few_requests(spark):
    rows = doc_rows()
    made = merkle_manifest.build(docs_df(spark, rows))
    asked = made.leaves.where("lang_key in ('+en', '') and rank % 13 = 4")
    found = merkle_manifest.proofs(made, asked)
    got = found.select("lang_key", "rank", merkle_manifest.fold(found.leaf, found.path).alias("root")).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((r[0], r[1]) for r in asked.select("lang_key", "rank").collect())
    assert {r["root"] for r in got} == {made.root}


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def contaminated(docs, items):
    windows = collections.defaultdict(set)
    for name, t in items:
        w = words(t)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(name)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (at := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    met |= windows[at]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in met if x is not None)), tuple(sorted(hit))))
    return out


@pytest.mark.parametrize("seed,block_bytes", [(0, 1 << 20), (1, 1 << 20), (2, 700), (3, 150)])
def test_scan_equals_brute_force(spark, seed, block_bytes):
    r = random.Random(seed)
    vocabulary = ["a", "b", "Zé", "ß9", "the", "THE", "日本", "x1"]
    say = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "\x7f", "_"]) for _ in range(n))
    items = [(i % 17 if i % 9 else None, r.choice([None, "", "...", say(2), say(4), say(9), say(10), say(11), say(40)])) for i in range(40)]
    items += [(100, items[-1][1]), (101, say(1) + "Only"), (7, say(30))] + [(200 + i, "one two three four five six seven eight nine ten eleven") for i in range(30)]
    docs = [(i % 50, r.choice([None, "", say(3), say(200), say(30) + (r.choice(items)[1] or "").swapcase().replace(" ", " - ") + say(20)])) for i in range(120)]
    docs += [(None, say(5000)), (0, (items[-1][1] + " ") * 40)] + [(900 + i, docs[4][1]) for i in range(30)]
    docs = [(i, t and t.translate(LOWER) if i == 3 else t) for i, t in docs]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, digest string, items long").repartition(4)
    found = benchmark_scan.find_contaminated(df, spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, piece string"), block_bytes)
    got = []
    for x in found.collect():
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(x["hits"] or b"", np.uint8))).tolist()
        got.append((x["doc_id"], x["n_words"], x["n_hit"], tuple(x["items"]), tuple(bits)))
    assert sorted(got, key=repr) == sorted(contaminated(docs, items), key=repr)


def test_scan_of_long_items_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(benchmark_scan, "PIECE", 16)
    text = " ".join(f"w{i % 37}x{i % 11}" for i in range(300))
    items = [(1, text)]
    docs = [(1, text), (2, " ".join(text.split()[40:75])), (3, " ".join(text.split()[40:49]))]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["doc_id"], x["n_words"], x["n_hit"], tuple(x["items"])) for x in benchmark_scan.find_contaminated(docs_df, items_df).collect())
    assert got == sorted(x[:4] for x in contaminated(docs, items))
    assert [x["n_hit"] for x in benchmark_scan.find_contaminated(docs_df, items_df.where("false")).collect()] == [0, 0, 0]
    assert benchmark_scan.find_contaminated(docs_df.where("false"), items_df).collect() == []


def test_windows_of_one_hash_are_compared_by_bytes(monkeypatch):
    """With all hashes equal, shift and bucket select everything; the bytes decide."""
    monkeypatch.setattr(benchmark_scan.textcodes, "word_hashes", lambda data, begins, ends: np.full(len(begins), 5, np.uint64))
    r = random.Random(3)
    say = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items, docs = [say(n) for n in (1, 2, 9, 10, 14)], [say(n) for n in (0, 1, 5, 60, 300)]
    patterns = benchmark_scan.Patterns(items, [str(i) for i in range(5)])
    text = benchmark_scan.Words(pa.array(docs))
    hit, _ = patterns.scan(text)
    want = contaminated(list(enumerate(docs)), list(enumerate(items)))
    assert [tuple(np.flatnonzero(hit[a:z]).tolist()) for a, z in zip(text.first[:-1], text.first[1:])] == [w[4] for w in want]


def test_most_words_are_skipped():
    """Blocks of no window move the search by nine words."""
    r = random.Random(4)
    text = benchmark_scan.Words(pa.array([" ".join(str(r.random()) for _ in range(20_000))]))
    looked = []
    whole = text.block
    text.block = lambda last, size: looked.append(len(last)) or whole(last, size)
    patterns = benchmark_scan.Patterns([" ".join(str(r.random()) for _ in range(100))], ["1"])
    assert not patterns.scan(text)[0].any()
    assert sum(looked) < len(text.begins) / 7


def lloyd(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(x * 1024) for x in v]))
    start = sorted(kept, key=lambda x: (x[0] is None, sha(f"3:{x[0]}"), x[1]))[:k]
    centroids = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = collections.Counter()
    for _, c, d in last:
        total[c] += d
    return [(i, c, d, total[c], sum(total.values()), sha(",".join(map(str, centroids[c])))) for i, c, d in last]


def as_floats(rows):
    return [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("seed,k,shape", [(0, 8, "blobs"), (1, 5, "grid"), (2, 8, "copies"), (3, 1, "blobs")])
def test_clusters_equal_plain_rounds(spark, monkeypatch, seed, k, shape):
    monkeypatch.setattr(heap_kmeans, "BLOCK_BYTES", 6 * 4 * 40)
    r = random.Random(seed)
    if shape == "grid":  # many ties
        rows = [(i, [r.randint(-2, 2) / 2 for _ in range(6)]) for i in range(300)]
    elif shape == "copies":
        rows = [(i % 40, [0.25] * 6) for i in range(200)] + [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    else:
        rows = [(i, [r.gauss(i % 6, 0.4) for _ in range(6)]) for i in range(400)]
    rows += [(None, [0.1] * 6), (1000, None), (1001, [1.0] * 5), (1002, [1.0] * 5 + [None]), (1003, [math.nan] * 6), (1004, [math.inf] + [0.0] * 5), (1005, [])]
    rows = as_floats(rows)
    df = spark.createDataFrame([(i, v, "c", 5) for i, v in rows], "vec_id long, embedding array<float>, cluster string, block long").repartition(3)
    found = heap_kmeans.cluster(df, k, 10, 6)
    got = sorted((tuple(x) for x in heap_kmeans.with_inertia(found).collect()), key=repr)
    assert got == sorted(lloyd(rows, k, 10, 6), key=repr)
    if shape == "blobs" and k > 1:  # later rounds only measure vectors whose gap expired
        assert found.measured[0] == 401 and min(found.measured[1:]) < 200


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = as_floats([(1, [0.5, 1.0]), (2, [0.5, 1.0])])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in heap_kmeans.with_inertia(heap_kmeans.cluster(df, 8, 10, 2)).collect()) == sorted(lloyd(rows, 8, 10, 2))
    none = heap_kmeans.with_inertia(heap_kmeans.cluster(df.where("false"), 8, 10, 2))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
