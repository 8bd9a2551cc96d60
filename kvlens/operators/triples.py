"""Knowledge-graph triples.

Model replies come as strict JSON, Python literals, wrapped in an envelope,
with ``object`` or ``Object``, or as failures.  All parsing is ``from_json``
(single quotes are accepted, so Python literals parse too); the envelope
order and the status rules are column expressions, per row.  A reply finds its
table by the id it carries, or by the content of the table text it was asked
with (J9): a digest of the canonical JSON is the join key, and the canonical
texts are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.jsonform import canonical_json

_TRIPLES = "array<map<string,string>>"


def _envelope(text: Column) -> Column:
    """K1: the first envelope key present, in the reference's order."""
    env = F.from_json(text, "map<string,string>")
    picks = []
    for key in P.TRIPLE_ENVELOPES:
        if "." in key:
            outer, inner = key.split(".", 1)
            picks.append(F.from_json(env[outer], "map<string,string>")[inner])
        else:
            picks.append(env[key])
    return F.coalesce(*picks)


def unwrap(df: DataFrame, text: str = "kg") -> DataFrame:
    """K1-K3: add ``status`` (ok | unwrapped | unresolved | unparsable |
    failed) and ``triples_json`` (the triple list text to explode)."""
    t = F.col(text)
    arr = F.from_json(t, _TRIPLES)
    env = F.from_json(t, "map<string,string>")
    first_obj = F.coalesce(F.get(arr, 0)["object"], F.get(arr, 0)["Object"])  # an empty list is unresolved
    wrapped = _envelope(t)
    status = (F.when(t.isin(*P.FAILED_SENTINELS), "failed")
              .when(arr.isNull() & env.isNull(), "unparsable")
              .when(first_obj.isNotNull(), "ok")
              .when(wrapped.isNotNull(), "unwrapped")
              .otherwise("unresolved"))
    return (df.withColumn("status", status)
              .withColumn("triples_json", F.when(F.col("status") == "ok", t)
                          .when(F.col("status") == "unwrapped", wrapped)))


def drop_failed(df: DataFrame, text: str = "kg") -> DataFrame:
    """drop rows whose reply is the retry-exhausted sentinel."""
    return df.where(~F.col(text).isin(*P.FAILED_SENTINELS))


def explode_triples(df: DataFrame) -> DataFrame:
    """K2/K5: one row per triple and object element.

    ``object`` falls back to ``Object``; a list object gives one row per
    element (``object_pos`` 1..n), a map object stays as JSON text.
    """
    parsed = df.where(F.col("triples_json").isNotNull()).select(
        "table_id",
        F.posexplode(F.arrays_zip(
            F.from_json("triples_json", _TRIPLES).alias("m"),
            F.transform(F.from_json("triples_json", "array<map<string,variant>>"),
                        lambda m: F.schema_of_variant(F.coalesce(m["object"], m["Object"]))).alias("t"),
        )).alias("triple_idx", "e"))
    obj = F.coalesce(F.col("e.m")["object"], F.col("e.m")["Object"])
    kind = (F.when(F.col("e.t").startswith("ARRAY"), "list")
            .when(F.col("e.t").startswith("OBJECT"), "map").otherwise("string"))
    base = parsed.select("table_id", "triple_idx", F.col("e.m")["subject"].alias("subject"),
                         F.col("e.m")["predicate"].alias("predicate"), obj.alias("object"), kind.alias("object_kind"))
    lists = (base.where(F.col("object_kind") == "list")
             .select("table_id", "triple_idx", "subject", "predicate",
                     F.posexplode(F.from_json("object", "array<string>")).alias("p", "item"), "object_kind")
             .select("table_id", "triple_idx", "subject", "predicate", F.col("item").alias("object"), "object_kind",
                     (F.col("p") + 1).alias("object_pos")))
    scalars = base.where(F.col("object_kind") != "list").withColumn("object_pos", F.lit(0))
    return scalars.unionByName(lists)


def bind_tables(replies: DataFrame, docs: DataFrame, table_text: str = "table_text", doc: str = "doc") -> DataFrame:
    """``replies`` with ``table_id`` filled in and ``bound_by``: ``key`` (the id was
    there), ``content`` (its table text holds the same data as ``docs``' document) or
    ``none``.

    The order of keys, the spelling of numbers, white space and Python's quotes make no
    difference.  Tables of equal content all get the reply; a text that is no
    JSON, or repeats a key, is bound to none.
    """
    def digest(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("_text", canonical_json(F.col(text))).withColumn("_digest", F.sha2("_text", 256))

    keyed = replies.where("table_id is not null").withColumn("bound_by", F.lit("key"))
    rest = replies.where("table_id is null").drop("table_id")
    tables = digest(docs.select("table_id", F.col(doc).alias("_doc")), "_doc")
    tables = tables.select("table_id", F.col("_digest").alias("_d"), F.col("_text").alias("_t")).where("_t is not null")
    same = (F.col("_digest") == F.col("_d")) & (F.col("_text") == F.col("_t"))
    found = digest(rest, table_text).join(tables, same, "left").drop("_digest", "_text", "_d", "_t")
    found = found.withColumn("bound_by", F.when(F.col("table_id").isNull(), "none").otherwise("content"))
    return keyed.unionByName(found)


def from_key_values(kv: DataFrame) -> DataFrame:
    """K4 (re-aimed, deterministic): infobox_kv -> (subject, predicate, object).

    Flat keys take the caption as subject (else the first section, else the
    category); section keys and list items take the section name.
    """
    heads = (kv.groupBy("table_id").agg(
        F.max(F.when(F.col("key") == "caption", F.col("value"))).alias("caption"),
        F.min_by(F.col("section"), F.when(F.col("section").isNotNull(), F.col("ord"))).alias("first_section"),
        F.max(F.when(F.col("key") == "category", F.col("value"))).alias("category")))
    subj_flat = F.coalesce(F.col("caption"), F.col("first_section"), F.col("category"))
    return (kv.where((F.col("kind") != "empty_section") & ~F.col("key").isin("category", "caption"))
            .join(heads, "table_id")
            .select("table_id",
                    F.when(F.col("kind") == "flat", subj_flat).otherwise(F.col("section")).alias("subject"),
                    F.col("key").alias("predicate"), F.col("value").alias("object")))
