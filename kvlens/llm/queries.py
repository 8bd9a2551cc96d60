"""The registered queries of this subpackage: each applies an operator, with
its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark_scan, heap_kmeans, host_trust, html_extract, line_dedup, lm_scoring, merkle_manifest, mil_quality, minhash_dedup, packing, sentencepiece_codec, topk_threshold, vector_search

LLM_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(name: str, oracle: str | None = None):
    def deco(fn):
        LLM_QUERIES[name] = fn, oracle
        return fn

    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_pitman_yor")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


@_query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op4_line_chunks")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


@_query("op5_hilbert_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return vector_search.nearest(rows, rows.where("vec_id % 20 = 0"), 20)


@_query("op6_minmax_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


_OP7_SQL = """
WITH sound AS (
  SELECT vec_id, [floor(x::DOUBLE * 1024) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM sound q JOIN sound r ON r.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@_query("op7_threshold_topk", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk_threshold.whole_numbers("embedding").alias("vector"))
    return topk_threshold.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


@_query("op8_dom_marginals")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


@_query("op9_attention_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mil_quality.score_documents(docs, mil_quality.train(docs, _table(spark, sf_dir, "labels")))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@_query("op10_host_trust")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_trust.judge_pages(_table(spark, sf_dir, "pages"), RULES)


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# crc32 by bits over the decimal digits.
_CRC_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_OP11_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, leaf, coalesce('+' || lang, '') AS grp, changed, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS idx,
    CAST(count(*) OVER (PARTITION BY lang) AS BIGINT) AS n
  FROM (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
               CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
        FROM documents)
), low(lvl, grp, idx, n, digest) AS (
  SELECT 0, grp, idx, n, leaf FROM leaves
  UNION ALL
  SELECT lvl + 1, grp, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY lvl, grp, idx // 8, n
), subroots AS MATERIALIZED (
  SELECT grp, lvl AS height, digest AS subroot, CAST(row_number() OVER (ORDER BY CAST(encode(grp) AS BLOB)) - 1 AS BIGINT) AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), up(lvl, idx, n, digest) AS (
  SELECT 0, idx, n, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lvl, idx // 8, n
), sib_low AS MATERIALIZED (
  SELECT a.grp, a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM low a JOIN low b ON a.grp = b.grp AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.grp, a.lvl, a.idx
), sib_up AS MATERIALIZED (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM up a JOIN up b ON a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.lvl, a.idx
), steps AS MATERIALIZED (
  SELECT d.grp, d.idx, s.lvl AS step, s.l, s.r FROM leaves d JOIN sib_low s ON s.grp = d.grp AND s.idx = d.idx // CAST(pow(8, s.lvl) AS BIGINT)
  UNION ALL
  SELECT d.grp, d.idx, t.height + s.lvl, s.l, s.r FROM leaves d JOIN subroots t ON t.grp = d.grp JOIN sib_up s ON s.idx = t.idx // CAST(pow(8, s.lvl) AS BIGINT)
), proof AS MATERIALIZED (
  SELECT grp, idx, string_agg(l || r, '' ORDER BY step) AS siblings FROM steps GROUP BY grp, idx
), folded(grp, idx, step, digest) AS (
  SELECT grp, idx, 0, coalesce(changed, leaf) FROM leaves
  UNION ALL
  SELECT f.grp, f.idx, f.step + 1, sha256(s.l || f.digest || s.r) FROM folded f JOIN steps s ON s.grp = f.grp AND s.idx = f.idx AND s.step = f.step
), last AS (SELECT grp, idx, arg_max(digest, step) AS folded_root FROM folded GROUP BY grp, idx)
SELECT d.doc_id, d.leaf, t.subroot, u.digest AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, l.folded_root, l.folded_root = u.digest AS verified
FROM leaves d JOIN subroots t USING (grp) JOIN up u ON u.n = 1 JOIN last l ON l.grp = d.grp AND l.idx = d.idx LEFT JOIN proof p ON p.grp = d.grp AND p.idx = d.idx
"""


@_query("op11_merkle_manifest", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audit(_table(spark, sf_dir, "documents"))


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_OP12_SQL = f"""
WITH items AS MATERIALIZED (
  SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_words_sql("text")} AS w FROM benchmark) WHERE len(w) > 0
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)
), rows AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, {_words_sql("text")} AS w FROM documents
), stretches AS MATERIALIZED (
  SELECT row, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM rows, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), met AS MATERIALIZED (
  SELECT s.row, s.size, s.i, v.item_id FROM stretches s JOIN windows v ON v.size = s.size AND v.win = s.win
), hit AS (
  SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS pos FROM met) GROUP BY row
), found AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY CAST(encode(id) AS BLOB)) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT r.doc_id, CAST(len(r.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM rows r LEFT JOIN hit h USING (row) LEFT JOIN found f USING (row)
"""


@_query("op12_wu_manber", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_scan.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _op13_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    ctes = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(x::DOUBLE * 1024) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)""", f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT * FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT {k})
)"""]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (
  SELECT row, vec_id, any_value(v) AS v, min(struct_pack(d := d, c := cluster)) AS best
  FROM (SELECT row, vec_id, v, cluster, CAST(list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, {dims + 1})]) AS BIGINT) AS d FROM kept, c{n})
  GROUP BY row, vec_id
)""")
        if n < rounds:
            ctes.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT o.cluster, CASE WHEN m.c IS NULL THEN o.c ELSE m.c END AS c
  FROM c{n} o LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
    FROM (SELECT best.c AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY ALL) GROUP BY cluster
  ) m USING (cluster)
)""")
    return "WITH " + ", ".join(ctes) + f"""
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON f.cluster = a.best.c
"""


@_query("op13_heap_kmeans", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_kmeans.with_inertia(heap_kmeans.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64))
