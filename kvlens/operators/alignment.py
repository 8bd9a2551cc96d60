"""ROUGE-1, ROUGE-L and METEOR of text pairs as joins and folds (M5-M7).

Every distinct pair of texts is scored once, whatever the number of rows that
hold it.  Its tokens become rows (pair, word) with the word's places in both
texts; the distinct words are stemmed once and joined back, and all further
matching happens between the places of one stem in one pair:

* ROUGE-1 adds up the occurrences that both texts have;
* ROUGE-L folds over the places of the shorter text with one row of the dynamic
  programme as state: a bit per place of the longer text in numbers of 62 bits
  (set where the row does not grow), stepped by an addition with carry;
* METEOR pairs the k-th last occurrences of a word, then of a stem among the
  places left, then (with a table of synonyms) places of synonyms, last first;
  chunks are the runs of pairs that follow each other in both texts.

Places and stems are written tables, so that their join is a plain one by word: a
small vocabulary is broadcast by its measured size, and a word that stands in every
pair is a skewed partition that adaptive execution splits.  Null texts read as
``nan``, as everywhere in scoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.metrics import bind
from ..functions.stemming import with_stem
from ..session import materialise

BITS = 62
_FULL = (1 << BITS) - 1


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def pair_key(actual: str, pred: str) -> Column:
    a, p = _text(actual), _text(pred)
    return F.unhex(F.sha2(F.concat(F.octet_length(a).cast("string"), F.lit(":"), a, p), 256))  # 32 bytes, not 64 digits


def rouge_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def stem_table(words: DataFrame) -> DataFrame:
    """``word, stem`` of the distinct words of a column ``word``, in a stated number of
    tasks: the rules take time, not bytes."""
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_stem(words.select("word").distinct().repartition(tasks))


def _places(tokens: DataFrame) -> DataFrame:
    """A row per (key, kind, word) with its places in the prediction (h) and in the actual text (r)."""
    def side(name: str, kind: str, own: str) -> Column:
        return F.transform(name, lambda w, i: F.struct(F.lit(kind).alias("kind"), F.lit(own).alias("side"), i.alias("at"), w.alias("word")))

    sides = F.concat(side("rouge_p", "r", "h"), side("rouge_a", "r", "r"), side("meteor_p", "m", "h"), side("meteor_a", "m", "r"))
    rows = tokens.select("key", F.inline(sides))
    at = lambda own: F.sort_array(F.collect_list(F.when(F.col("side") == own, F.col("at")))).alias(own)
    return rows.groupBy("key", "kind", "word").agg(at("h"), at("r"))


def _ends(h: Column, r: Column) -> tuple[Column, Column, Column]:
    """The k last of both lists as pairs, and what is left of each."""
    k = F.least(F.size(h), F.size(r))
    tail = lambda x: F.slice(x, F.size(x) - k + 1, k)
    return F.zip_with(tail(h), tail(r), lambda x, y: F.struct(x.alias("h"), y.alias("r"))), F.slice(h, F.lit(1), F.size(h) - k), F.slice(r, F.lit(1), F.size(r) - k)


def _by_stem(places: DataFrame, stems: DataFrame) -> DataFrame:
    """A row per (key, kind, stem): places of all its words, the words matched exactly, and the places left."""
    met = places.join(stems, "word")
    met = met.withColumn("stem", F.when((F.col("kind") == "r") & (F.length("word") <= 3), F.col("word")).otherwise(F.col("stem")))
    # Dealt by key once, into a stated number of tasks (the folds take time, not bytes);
    # grouping by (key, kind, stem) and then by key needs no further exchange.  Only
    # places move: what is matched exactly and what is left are made from them behind it.
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.select("key", "kind", "stem", "word", "h", "r").repartition(tasks, "key")
    exact, left_h, left_r = _ends(F.col("h"), F.col("r"))
    word = F.col("word")
    named = lambda left: F.transform(left, lambda at: F.struct(at.alias("at"), word.alias("word")))
    met = met.select("key", "kind", "stem", "h", "r", exact.alias("exact"), named(left_h).alias("left_h"), named(left_r).alias("left_r"))
    flat = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)
    return met.groupBy("key", "kind", "stem").agg(*[flat(c) for c in ("h", "r", "exact", "left_h", "left_r")])


def lcs_length(stems: Column) -> Column:
    """Longest common subsequence, from an array of (h, r): the places of each common
    stem in either text.  Linear memory; steps times the words of 62 places."""
    def of(shorter: str, longer: str) -> Column:
        zero = F.lit(0).cast("long")
        mask = lambda places: F.map_from_entries(F.transform(F.array_distinct(F.transform(places, lambda p: (p / BITS).cast("int"))), lambda k: F.struct(
            k, F.aggregate(F.filter(places, lambda p: (p / BITS).cast("int") == k), zero, lambda bits, p: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % BITS).cast("int")))))))
        steps = F.transform(F.array_sort(F.flatten(F.transform(stems, lambda s, i: F.transform(s[shorter], lambda p: F.struct(p.alias("at"), i.alias("stem")))))), lambda x: x["stem"])
        words = (F.array_max(F.transform(stems, lambda s: F.array_max(s[longer]))) / BITS).cast("int")

        def row(v: Column, masks: Column, stem: Column) -> Column:
            """The next row of bits: v + (v & mask), with carry, or v without the mask."""
            start = F.struct(zero.alias("carry"), F.array().cast("array<long>").alias("row"))

            def word(s: Column, x: Column, k: Column) -> Column:
                m = F.coalesce(F.try_element_at(F.get(masks, stem), k), zero)
                total = x + x.bitwiseAND(m) + s["carry"]
                return F.struct(F.call_function("shiftright", total, F.lit(BITS)).alias("carry"),
                                F.concat(s["row"], F.array(total.bitwiseAND(F.lit(_FULL)).bitwiseOR(x.bitwiseAND(F.bitwise_not(m))))).alias("row"))

            indexed = F.transform(v, lambda x, k: F.struct(x.alias("x"), k.alias("k")))
            return F.aggregate(indexed, start, lambda s, x: word(s, x["x"], x["k"]), lambda s: s["row"])

        fold = lambda masks: F.aggregate(steps, F.array_repeat(F.lit(_FULL), words + 1), lambda v, stem: row(v, masks, stem))
        rows = bind(F.transform(stems, lambda s: mask(s[longer])), fold)
        return F.aggregate(rows, F.lit(0), lambda n, x: n + BITS - F.bit_count(x))

    steps = lambda side: F.aggregate(stems, F.lit(0), lambda n, s: n + F.size(s[side]))
    return F.when(F.size(stems) == 0, F.lit(0)).when(steps("h") <= steps("r"), of("h", "r")).otherwise(of("r", "h"))


def chunks(pairs: Column) -> Column:
    """Runs of pairs, sorted by h, that follow each other in both texts."""
    def first(x: Column, i: Column) -> Column:
        before = F.get(pairs, i - 1)
        return before.isNull() | (x["h"] != before["h"] + 1) | (x["r"] != before["r"] + 1)

    return F.size(F.filter(pairs, first))


def _synonym_pairs(left: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``key, pairs`` of places left whose words are synonyms (``word, synonym``):
    places of the prediction from the last on, each with the last free place."""
    hyp = left.select("key", F.inline("left_h")).join(synonyms, "word").select("key", F.col("at").alias("h"), F.col("synonym").alias("word"))
    ref = left.select("key", F.inline("left_r")).select("key", F.col("at").alias("r"), "word")
    found = hyp.join(ref, ["key", "word"]).groupBy("key", "h").agg(F.collect_set("r").alias("free"))
    lists = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("h", "free")), asc=False).alias("asked"))
    none = F.array().cast("array<struct<h:int,r:int>>")

    def take(pairs: Column, x: Column) -> Column:
        best = F.array_max(F.array_except(x["free"], F.transform(pairs, lambda p: p["r"])))
        return F.when(best.isNull(), pairs).otherwise(F.concat(pairs, F.array(F.struct(x["h"].alias("h"), best.alias("r")))))

    return lists.select("key", F.aggregate("asked", none, take).alias("more"))


def _f(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def score_pairs(df: DataFrame, actual: str, pred: str, synonyms: DataFrame | None = None, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """``key, rouge1, rougeL, meteor`` of every distinct pair that has a token."""
    a, p = _text(actual), _text(pred)
    pairs = df.select(pair_key(actual, pred).alias("key"), a.alias("a"), p.alias("p")).dropDuplicates(["key"])
    tokens = pairs.select("key", rouge_tokens(F.col("a")).alias("rouge_a"), rouge_tokens(F.col("p")).alias("rouge_p"),
                          T.lower_tokens(F.col("a")).alias("meteor_a"), T.lower_tokens(F.col("p")).alias("meteor_p"))
    places = materialise(_places(tokens), "pair-places")
    stems = _by_stem(places, materialise(stem_table(places), "stems"))
    exact, left_h, left_r = F.col("exact"), F.col("left_h"), F.col("left_r")
    by_stem, rest_h, rest_r = _ends(left_h, left_r)
    paired = F.concat(exact, F.transform(by_stem, lambda x: F.struct(x["h"]["at"].alias("h"), x["r"]["at"].alias("r"))))
    stems = stems.select("key", "kind", "h", "r", paired.alias("pairs"), rest_h.alias("left_h"), rest_r.alias("left_r"))
    rouge, meteor = F.col("kind") == "r", F.col("kind") == "m"
    both = (F.size("h") > 0) & (F.size("r") > 0)
    add = lambda when, c: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    per = stems.groupBy("key").agg(
        add(rouge, F.least(F.size("h"), F.size("r"))).alias("overlap"),
        add(rouge, F.size("h")).alias("rouge_h"), add(rouge, F.size("r")).alias("rouge_r"),
        add(meteor, F.size("h")).alias("meteor_h"), add(meteor, F.size("r")).alias("meteor_r"),
        F.collect_list(F.when(rouge & both, F.struct("h", "r"))).alias("common"),
        F.flatten(F.collect_list(F.when(meteor, F.col("pairs")))).alias("pairs"))
    if synonyms is not None:
        more = _synonym_pairs(stems.where(meteor).select("key", "left_h", "left_r"), synonyms.select("word", "synonym").distinct())
        per = per.join(more, "key", "left").withColumn("pairs", F.when(F.col("more").isNull(), F.col("pairs")).otherwise(F.concat("pairs", "more"))).drop("more")
    per = per.withColumn("pairs", F.array_sort("pairs")).withColumn("lcs", lcs_length(F.col("common"))).withColumn("chunks", chunks(F.col("pairs")))
    share = lambda x, n: F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.col(x) / F.col(n))
    per = per.withColumn("m", F.size("pairs"))
    prec, rec = share("m", "meteor_h"), share("m", "meteor_r")
    mean = prec * rec / (alpha * prec + (1 - alpha) * rec)
    penalty = gamma * F.pow(F.col("chunks") / F.col("m"), F.lit(beta))
    return per.select(
        "key",
        _f(share("overlap", "rouge_h"), share("overlap", "rouge_r")).alias("rouge1"),
        _f(share("lcs", "rouge_h"), share("lcs", "rouge_r")).alias("rougeL"),
        F.when(F.col("m") == 0, F.lit(0.0)).otherwise((1 - penalty) * mean).alias("meteor"))
