"""URL rules, and trust that spreads over the link graph of hosts.

A rule is a host and the beginning of a path; it fits that host and its
subdomains, and the longest fitting rule decides a page.  Pages that no rule
fits are judged by their host:

* every host gets a trusted seed (the share of its pages that an allow rule
  fits) and a blocked seed (the share that a block rule fits); a host that is
  only linked to gets them from the urls of the links to it (an empty path counts as ``/``);
* trust is a personalised PageRank from the trusted seeds along the links
  between hosts; distrust is one from the blocked seeds against the links (a
  host that links to blocked hosts earns distrust);
* a host is blocked if its distrust exceeds its trust and either reaches
  ``threshold``, or ``share`` of its links or more lead to distrusted hosts (a link
  counts by its target's distrust over that of a fully blocked host without links, 1 at
  most; this does not depend on how many others link to the target); else, and
  without any link, it is allowed.

Links are the ``href`` of the pages' anchors that name a host (absolute, or
beginning with ``//``); a host's links to itself
are left out, and repeated links count by their number.  Each step joins the
scores (a row per host) to the edges (a row per pair of hosts, weighted and
pre-aggregated) and sums per host; steps end only when no score moves by more than
``tolerance`` (scores grow by a share of ``damping`` a step at most, so they end).

Defined cases: a null url or one without ``://`` has an empty host and path,
no rule fits it and it is allowed; a null or empty html has no links;
repeated pages count once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlens.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""
STEPS = 4  # taken between two writes of the scores


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``rules``: (verdict, host, path); the rule's name (host and path) and its
    verdict, null where none fits.  A longer host wins, then a longer path."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst, n, good, bad``: the number of links from one host to another,
    and of those whose url an allow or a block rule fits."""
    links = pages.select(url_host(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("to"))
    links = links.withColumn("to", F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to")))
    links = links.select("src", url_host(F.col("to")).alias("dst"), url_path(F.col("to")).alias("path")).where("src <> dst and src <> '' and dst <> ''")
    _, verdict = longest_rule(F.col("dst"), F.when(F.col("path") == "", "/").otherwise(F.col("path")), rules)
    links = links.withColumn("said", verdict)
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("said") == "allow", 1)).alias("good"), F.count(F.when(F.col("said") == "block", 1)).alias("bad"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, name: str) -> DataFrame:
    """Personalised PageRank ``host, score`` over ``src, dst, n`` from ``host, seed``
    (unscaled: a seed of 1 without links scores ``1 - damping``)."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    edges = materialise(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), f"{name}-edges")
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("start")).where("start > 0")
    scores = materialise(start.select("host", F.col("start").alias("score")), f"{name}-scores")
    if edges.isEmpty():
        return scores
    while True:
        new = scores
        for _ in range(STEPS):
            sent = edges.join(new, edges.src == new.host).groupBy("dst").agg(F.sum(F.col("score") * F.col("share") * damping).alias("got"))
            new = start.join(sent.withColumnRenamed("dst", "host"), "host", "full").select("host", (F.coalesce("start", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("score"))
        new = materialise(new, f"{name}-scores")
        moved = new.alias("a").join(scores.alias("b"), "host", "full").agg(F.max(F.abs(F.coalesce("a.score", F.lit(0.0)) - F.coalesce("b.score", F.lit(0.0)))).alias("m")).first()["m"]
        scores = new
        if moved is None or moved <= tolerance:
            return scores


def judge_pages(
    pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html",
    damping: float = 0.85, tolerance: float = 1e-6, threshold: float = 0.15, share: float = 0.5,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``."""
    at = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = at.withColumn("rule", rule).withColumn("said", verdict)
    part = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    hosts = materialise(judged.where("host <> ''").groupBy("host").agg(part("allow").alias("good"), part("block").alias("bad")), "hosts")
    edges = materialise(host_edges(pages, rules, url, html), "links")
    linked = edges.groupBy("dst").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in ("good", "bad")]).withColumnRenamed("dst", "host")
    seeds = materialise(hosts.unionByName(linked.join(hosts, "host", "left_anti")), "seeds")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = propagate(edges, seeds.select("host", F.col("good").alias("seed")), damping, tolerance, "trust")
    distrust = propagate(turned, seeds.select("host", F.col("bad").alias("seed")), damping, tolerance, "distrust")
    aimed = edges.join(distrust.withColumnRenamed("host", "dst"), "dst", "left")
    leads = F.sum(F.col("n") * F.least(F.coalesce("score", F.lit(0.0)) / (1 - damping), F.lit(1.0))) / F.sum("n")
    aimed = aimed.groupBy("src").agg(leads.alias("leads")).withColumnRenamed("src", "host")
    scores = (
        hosts.select("host")
        .join(trust.withColumnRenamed("score", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        .join(aimed, "host", "left")
        .na.fill(0.0)
    )
    bad = ((F.col("distrust") >= threshold) | (F.col("leads") >= share)) & (F.col("distrust") > F.col("trust"))
    found = judged.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust", "leads"])
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
