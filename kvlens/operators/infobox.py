"""Infobox tables: HTML -> rows -> sections and slots -> key/value rows,
document, flat columns and prompt text (H1-H7, W2-W4, N1-N3, N25, P6).

A table stays one row from the parse to its text.  Its ``<tr>`` records are an
array in document order; native array expressions cut it at the headers into
sections (slices), keep the last value of a repeated key at its first place
(one sort and the ends of its runs), and give ``slots``: the table's keys and
sections in document order.  The only exchange deals the HTML out before the
Python parse; stored JSON documents need none.  Every renderer reads ``slots``.
Work per table is a sort of its rows, so a table of thousands of rows is fine.

Rows of one ``table_id`` are tables of their own.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import htmlrows
from ..functions.htmlrows import TABLE_SCHEMA, tables_from_batches
from ..functions.metrics import bind
from ..functions.text import ends_with_colon, join_pieces, py_list_repr, py_str_repr

_BIG = 1 << 30  # position of an end-of-table close

# ship the parser's code with the task, so executors need no installed package
cloudpickle.register_pickle_by_value(htmlrows)


def normalise_dashes(df: DataFrame, col: str = "html") -> DataFrame:
    """Em and en dashes -> '-' before parsing."""
    return df.withColumn(col, F.translate(F.col(col), "—–", "--"))


def parse_tables(tables: DataFrame, without_id: bool = False) -> DataFrame:
    """(table_id, category, html) -> with ``caption`` (text pieces, null without one)
    and ``rows``, one record per ``<tr>`` (nested ones too).

    The parse is Python, so its input is always dealt out first: a file of few
    large rows then runs in many tasks.  Rows without an id have no table to belong
    to and are left out, unless ``without_id`` (``accounting`` counts them).
    """
    category = F.col("category") if "category" in tables.columns else F.lit(None).cast("string")
    src = tables.select(F.col("table_id").cast("long"), category.alias("category"), "html")
    if not without_id:
        src = src.where("table_id is not null")
    # A stated number of tasks: adaptive execution would merge them by bytes, though it is the parse that takes time.
    tasks = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = [F.xxhash64("html")] if without_id else ["table_id"]  # rows without an id are not one key
    return src.repartition(tasks, *deal).mapInArrow(tables_from_batches, TABLE_SCHEMA)


def _when_kind(r: Column, choices) -> Column:
    out = None
    for kinds, value in choices:
        hit = r["kind"].isin(*kinds)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _kind(r: Column) -> Column:
    """H2: the rule ladder of one row, without its section."""
    td_kv = (r["n_td"] == 2) & (r["n_th"] == 0)
    bold = r["td1_bold"] | r["td1_fontweight"]
    return (F.when(r["n_text"] == 0, "skip")
            .when(r["has_nested"], "skip")
            .when((r["n_td"] == 1) & (r["n_th"] == 1), "kv_th")
            .when(td_kv & bold, "kv_td")
            .when(td_kv & ends_with_colon(r["td1_first_text"]), "kv_td")
            .when((r["n_td"] == 0) & (r["n_th"] == 1), "header_th")
            .when((r["n_td"] == 1) & (r["n_th"] == 0) & bold, "header_td")
            .when((r["n_td"] == 1) & (r["n_th"] == 0) & (r["td1_class"] == "infobox-image"), "image")
            .otherwise("other"))


def _read_row(r: Column) -> Column:
    """A row's key, value, section name and list text, by its kind."""
    th, td1, td2 = join_pieces(r["th_pieces"]), join_pieces(r["td1_pieces"]), join_pieces(r["td2_pieces"])
    return F.struct(
        r["at"].alias("at"),
        _when_kind(r, [(["kv_th", "kv_td"], "kv"), (["image"], "image"), (["header_th", "header_td"], "header"), (["other"], "other")]).alias("kind"),
        _when_kind(r, [(["kv_th"], th), (["kv_td"], td1), (["image"], F.lit("infobox-image"))]).alias("key"),
        _when_kind(r, [(["kv_th", "image"], td1), (["kv_td"], td2)]).alias("value"),
        _when_kind(r, [(["header_th"], th), (["header_td"], td1)]).alias("head"),
        _when_kind(r, [(["other", "image"], join_pieces(F.transform(r["cell_pieces"], join_pieces)))]).alias("cells"))


def classify_rows(tables: DataFrame) -> DataFrame:
    """H2: ``rows`` become (at, kind, key, value, head, cells); kind is kv, image,
    header, other, or null for a row without meaning."""
    kinds = F.transform("rows", lambda r, i: F.struct(i.alias("at"), _kind(r).alias("kind"), *[r[c].alias(c) for c in ("th_pieces", "td1_pieces", "td2_pieces", "cell_pieces")]))
    return tables.withColumn("rows", F.transform(kinds, _read_row))


def _last_of_key(events: Column, key: str) -> Column:
    """Events (structs that begin with ``key`` and ``at``) -> one per key, as
    (ord: the first place, last: the last event), by place."""
    def ends(ordered: Column) -> Column:
        begins = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | ~x[key].eqNullSafe(F.get(ordered, i - 1)[key]), i)), lambda i: i.isNotNull())
        return bind(begins, lambda begins: F.transform(begins, lambda b, i: F.struct(
            F.get(ordered, b)["at"].alias("ord"), F.get(ordered, F.coalesce(F.get(begins, i + 1), F.size(ordered)) - 1).alias("last"))))

    return F.array_sort(bind(F.array_sort(events), ends))


def _sections(rows: Column) -> Column:
    """The rows cut at the headers: (name, close, rows).  The first part has no
    name; a blank header's part has the name ''.  ``close`` is the place of the next header."""
    heads = F.filter(F.transform(rows, lambda r, i: F.when(r["kind"] == "header", i)), lambda i: i.isNotNull())

    def cut(starts: Column) -> Column:
        def part(h: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(rows))
            return F.struct(F.when(h >= 0, F.get(rows, h)["head"]).alias("name"),
                            F.coalesce(F.get(starts, j + 1), F.lit(_BIG)).alias("close"),
                            F.slice(rows, h + 2, end - h - 1).alias("rows"))

        return F.transform(starts, part)

    return bind(F.concat(F.array(F.lit(-1)), heads), cut)


def _open(section: Column) -> Column:
    return section["name"].isNotNull() & (section["name"] != "")


def nested(tables: DataFrame, without_id: bool = False) -> DataFrame:
    """H2/H3/W2/W3 -> ``table_id, n_rows, slots``: the table's top level in document order.

    A slot is (ord, key, value, section, subs, items): a key with its value, or a
    section (its name in ``section``) with its key/value pairs (ord, key, value) and
    its list.  A later write to a key wins, at the key's first position; a section is
    written when it closes (next header or table end), replacing an earlier section
    or value of the same name.  A list under the section's own name replaces a pair
    of that name.
    """
    parsed = classify_rows(parse_tables(tables, without_id))
    cut = parsed.withColumn("parts", _sections(F.col("rows")))
    none = F.lit(None)

    def event(key: Column, at: Column, value: Column, part: Column) -> Column:
        return F.struct(key.cast("string").alias("key"), at.cast("int").alias("at"), value.cast("string").alias("value"), part.cast("int").alias("part"))

    flat = F.flatten(F.transform(F.filter("parts", lambda p: ~_open(p)), lambda p: F.transform(
        F.filter(p["rows"], lambda r: r["kind"].isin("kv", "image")), lambda r: event(r["key"], r["at"], r["value"], none))))
    closed = F.filter(F.transform("parts", lambda p, j: F.when(_open(p), event(p["name"], p["close"], none, j))), lambda e: e.isNotNull())
    caption = F.when(F.col("caption").isNull(), F.array().cast("array<struct<key:string,at:int,value:string,part:int>>")).otherwise(
        F.array(event(F.lit("caption"), F.lit(-1), join_pieces(F.col("caption")), none)))
    category = F.array(event(F.lit("category"), F.lit(-2), F.col("category"), none))
    slots = _last_of_key(F.concat(category, caption, flat, closed), "key")

    def subs(p: Column) -> Column:
        pairs = F.transform(F.filter(p["rows"], lambda r: r["kind"] == "kv"), lambda r: F.struct(r["key"].alias("key"), r["at"].alias("at"), r["value"].alias("value")))
        return F.transform(_last_of_key(pairs, "key"), lambda x: F.struct(x["ord"].alias("ord"), x["last"]["key"].alias("key"), x["last"]["value"].alias("value")))

    def items(p: Column) -> Column:
        return F.transform(F.filter(p["rows"], lambda r: r["kind"].isin("other", "image") & (r["cells"] != "")), lambda r: r["cells"])

    filled = F.transform("parts", lambda p: F.when(_open(p), F.struct(subs(p).alias("subs"), items(p).alias("items"))))

    def slot(x: Column, filled: Column) -> Column:
        return bind(F.get(filled, x["last"]["part"]), lambda part: _slot(x["ord"], x["last"]["key"], x["last"]["value"], x["last"]["part"].isNotNull(), part["subs"], part["items"]))

    return cut.select("table_id", F.size("rows").alias("n_rows"), bind(filled, lambda filled: F.transform(slots, lambda x: slot(x, filled))).alias("slots"))


def _slot(ord_: Column, key: Column, value: Column, is_section: Column, subs: Column, items: Column) -> Column:
    own = F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0
    return F.struct(ord_.cast("int").alias("ord"), F.when(~is_section, key).alias("key"), F.when(~is_section, value).alias("value"), F.when(is_section, key).alias("section"),
                    F.filter(subs, lambda s: ~(own & (s["key"] == key))).alias("subs"), items.alias("items"))


def key_value_rows(tables: DataFrame) -> DataFrame:
    """``table_id, slots`` -> ``infobox_kv``: (table_id, ord, section, key, value,
    list_pos, sub_ord, kind) with kind flat | section_kv | section_list | empty_section."""
    def row(ord_, section, key, value, list_pos, sub_ord, kind) -> Column:
        return F.struct(ord_.alias("ord"), section.cast("string").alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"),
                        list_pos.cast("int").alias("list_pos"), sub_ord.cast("int").alias("sub_ord"), F.lit(kind).alias("kind"))

    none = F.lit(None)

    def of(s: Column) -> Column:
        at, name = s["ord"], s["section"]
        pairs = F.transform(s["subs"], lambda x: row(at, name, x["key"], x["value"], none, x["ord"], "section_kv"))
        items = F.transform(s["items"], lambda v, i: row(at, name, name, v, i + 1, F.lit(_BIG), "section_list"))
        return (F.when(name.isNull(), F.array(row(at, none, s["key"], s["value"], none, none, "flat")))
                .when(F.size(s["subs"]) + F.size(s["items"]) == 0, F.array(row(at, name, none, none, none, none, "empty_section")))
                .otherwise(F.concat(pairs, items)))

    return tables.select("table_id", F.inline(F.flatten(F.transform("slots", of))))


def key_values(tables: DataFrame) -> DataFrame:
    """H1-H3: HTML tables -> ``infobox_kv``."""
    return key_value_rows(nested(tables))


def linearise(tables: DataFrame) -> DataFrame:
    """H5: ``table_id, slots`` -> one prompt text per table, in document order.

    flat ``key\\nvalue\\n\\n``; section ``name\\n`` + ``sub\\tvalue\\n`` ... +
    the own-name list as Python list text + ``\\n``, closed by ``\\n``.
    """
    def text(s: Column) -> Column:
        pairs = F.array_join(F.transform(s["subs"], lambda x: F.concat(x["key"], F.lit("\t"), x["value"], F.lit("\n"))), "")
        listed = F.when(F.size(s["items"]) > 0, F.concat(py_list_repr(s["items"]), F.lit("\n"))).otherwise("")
        return F.when(s["section"].isNull(), F.concat(s["key"], F.lit("\n"), s["value"], F.lit("\n\n"))).otherwise(F.concat(s["section"], F.lit("\n"), pairs, listed, F.lit("\n")))

    return tables.select("table_id", F.array_join(F.transform("slots", text), "").alias("text"))


def flatten(kv: DataFrame) -> DataFrame:
    """Dotted columns: ``key``, ``sub(section)``, ``section/list_i``.

    A *string* under the section's own name is one value here, with ``char_split``
    set: the reference would list its characters."""
    col = (F.when(F.col("kind") == "flat", F.col("key"))
           .when(F.col("kind") == "section_kv", F.concat(F.col("key"), F.lit("("), F.col("section"), F.lit(")")))
           .when(F.col("kind") == "section_list",
                 F.concat(F.col("section"), F.lit("/list_"), F.col("list_pos").cast("string"))))
    own = (F.col("kind") == "section_kv") & (F.col("key") == F.col("section"))
    return kv.where(F.col("kind") != "empty_section").select("table_id", col.alias("column"), "value", own.alias("char_split"))


def document_json(tables: DataFrame, python: bool = False) -> DataFrame:
    """H3: ``table_id, slots`` -> nested document text per table, keys in document order.

    JSON by default; ``python=True`` gives ``str(dict)`` (single quotes,
    ``', '`` / ``': '`` separators), the form the triple-extraction prompt
    embeds (Q8)."""
    if python:
        q, arr, sep, colon = py_str_repr, py_list_repr, ", ", ": "
    else:
        def q(c):
            return bind(F.to_json(F.array(c)), lambda x: x.substr(F.lit(2), F.length(x) - 2))
        arr, sep, colon = F.to_json, ",", ":"

    def text(s: Column) -> Column:
        pairs = F.transform(s["subs"], lambda x: F.concat(q(x["key"]), F.lit(colon), q(x["value"])))
        listed = F.when(F.size(s["items"]) > 0, F.array(F.concat(q(s["section"]), F.lit(colon), arr(s["items"])))).otherwise(F.array().cast("array<string>"))
        section = F.concat(q(s["section"]), F.lit(colon), F.lit("{"), F.array_join(F.concat(pairs, listed), sep), F.lit("}"))
        return F.when(s["section"].isNull(), F.concat(q(s["key"]), F.lit(colon), q(s["value"]))).otherwise(section)

    return tables.select("table_id", F.concat(F.lit("{"), F.array_join(F.transform("slots", text), sep), F.lit("}")).alias("doc"))


def _entries(text: Column) -> Column:
    """A JSON object's (k, v, t) in key order, null for other texts: the values as
    text, and their types.  Order comes from ``map<string,string>`` (a VARIANT
    object sorts its keys), types from ``map<string,variant>``; a repeated key has no
    VARIANT, then the types are read off the values' own texts."""
    def typed(m: Column) -> Column:
        exact = F.transform(F.map_values(F.from_json(text, "map<string,variant>")), lambda x: F.schema_of_variant(x))
        seen = F.transform(F.map_values(m), lambda v: F.when(v.startswith("{"), "OBJECT").when(v.startswith("["), "ARRAY").otherwise("STRING"))
        return bind(F.coalesce(exact, seen), lambda types: F.transform(F.map_entries(m), lambda e, i: F.struct(e["key"].alias("k"), e["value"].alias("v"), F.get(types, i).alias("t"))))

    return bind(F.from_json(text, "map<string,string>"), typed)


def nested_documents(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """H6: stored JSON documents -> ``table_id, status, slots``: status is ``ok``, or
    ``malformed`` for a text that is no JSON object (then without slots)."""
    top = docs.select("table_id", _entries(F.col(doc_col)).alias("entries"))
    inner = F.transform("entries", lambda e: F.when(e["t"].startswith("OBJECT"), _entries(e["v"])))

    def slot(e: Column, i: Column) -> Column:
        parts = F.get(F.col("inner"), i)
        own = lambda x: x["t"].startswith("ARRAY") & (x["k"] == e["k"])
        pairs = F.filter(F.transform(parts, lambda x, j: F.struct(j.alias("ord"), x["k"].alias("key"), x["v"].alias("value"), own(x).alias("own"))), lambda x: ~x["own"])
        pairs = F.transform(pairs, lambda x: F.struct(x["ord"].alias("ord"), x["key"].alias("key"), x["value"].alias("value")))
        items = F.flatten(F.transform(F.filter(parts, own), lambda x: F.from_json(x["v"], "array<string>")))
        section = e["t"].startswith("OBJECT")
        return F.struct(i.cast("int").alias("ord"), F.when(~section, e["k"]).alias("key"), F.when(~section, e["v"]).alias("value"),
                        F.when(section, e["k"]).alias("section"), pairs.alias("subs"), items.alias("items"))

    read = top.withColumn("inner", inner).select("table_id", "entries", F.transform("entries", slot).alias("slots"))
    status = F.when(F.col("entries").isNull(), "malformed").otherwise("ok")
    return read.select("table_id", status.alias("status"), "slots")


def read_documents(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """H6: stored JSON documents -> ``infobox_kv``; malformed ones give no rows."""
    return key_value_rows(nested_documents(docs, doc_col))
