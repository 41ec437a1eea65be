"""URL filter: host and path rules, and link-graph propagation for the hosts no rule covers.

Rules name a host and a path prefix; a rule fits its host and all subdomains.
The longest rule that fits a page decides it. Its decisions also are the
seeds of two personalised PageRanks over the host graph:

* trust starts at the hosts of allowed pages and follows links forward;
* distrust starts at the hosts of blocked pages and follows links backward
  (who links to a bad host is suspect).

Both start with ``UNIT`` per judged page and move in fronts: a step passes
``damping`` percent of what arrived in the last step on, in equal parts to
the host's neighbours. A host's score is the sum of all that reached it (the
constant factor of the PageRank series left out on both sides). A host is
blocked if distrust is more than ``threshold`` percent of trust and distrust
together; without evidence it is allowed.

Masses are whole numbers (integer division), so sums do not depend on their
order: reruns agree exactly, and SQL gives the same verdicts. A front dies
out by itself: with no links between hosts there is no step at all. ``steps``
bounds the walk (0.85 ** 40 is 0.2 %).

Scale: pages are reduced to distinct host pairs before any shuffle of links.
A hub's edges are dealt into slots of about ``SLOT_EDGES``, so no key holds
more; a host with a third of all pages costs one row per host pair. Fronts
are written to the shared folder (`common.stage`), one small table a step.
Built of DataFrame functions only.

Defined cases: a null url, or one without ``://``, has empty host and path
and is allowed (no rule, no evidence); a null html has no links; repeated
pages and page ids are judged one by one and each counts as a seed; links to
the own host are not edges; of rules equally long the first in code-point
order decides, then ``allow``; empty tables give no rows. Columns other than
``page_id, url, html`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

UNIT = 1_000_000
SLOT_EDGES = 100_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)[\x20\x09-\x0D]href=["']?(?:https?:)?//([^/?#"'<>\x20\x09-\x0D]+)"""


def ascii_lower(c: Column) -> Column:
    """Lower-case only A-Z."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table of literals."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): the rules that fit each host, longest first.

    A host offers its last 1 to n labels, n being the labels of the longest
    rule host, and meets the rules in an equi-join.
    """
    rules = rules.select(F.col("host").alias("rule_host"), "path", "verdict").distinct()
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("n")).first()["n"] or 0
    parts = F.split("host", r"\.")
    tails = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in range(1, labels + 1)]
    offered = hosts.select("host", F.explode(F.array_compact(F.array(*tails)) if tails else F.array().cast("array<string>")).alias("rule_host"))
    text = F.concat("rule_host", "path")
    fit = F.struct((-F.length(text)).alias("rank"), text.alias("rule"), "verdict", "path")
    return offered.join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list(fit)).alias("fits"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the links between different hosts in the pages' html."""
    host, _ = split_url(F.col("url"))
    links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    pairs = pages.select(host.alias("src"), F.explode(links).alias("dst")).withColumn("dst", ascii_lower(F.col("dst")))
    return pairs.where("src <> '' and src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: int = 85, steps: int = 40) -> DataFrame:
    """(host, trust, distrust): all mass that reached each host.

    ``seeds`` holds (host, trust, distrust) in whole units.
    """
    both = F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("to")),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("node"), F.col("src").alias("to")),
    ))
    walks = edges.select(both.alias("e")).select("e.*")
    degree = stage(
        walks.groupBy("kind", "node").agg(F.count("*").alias("degree"))
        .withColumn("slots", F.ceil(F.col("degree") / SLOT_EDGES).cast("int")),
        "degree",
    )
    walks = stage(
        walks.join(degree, ["kind", "node"])
        .select("kind", "node", F.pmod(F.xxhash64("to"), "slots").cast("int").alias("slot"), "to"),
        "walks",
    )
    kinds = [F.struct(F.lit(k).alias("kind"), F.col("host").alias("node"), F.col(k).cast("long").alias("mass")) for k in ("trust", "distrust")]
    front = seeds.select(F.explode(F.array(*kinds)).alias("s")).select("s.*").where("mass > 0")
    reached = [stage(front, "front")]
    for _ in range(0 if walks.isEmpty() else steps):
        part = F.expr(f"(mass * {damping}) div (100 * degree)")
        sent = reached[-1].join(degree, ["kind", "node"]).select("kind", "node", "slots", part.alias("mass")).where("mass > 0")
        sent = sent.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        moved = sent.join(walks, ["kind", "node", "slot"]).groupBy("kind", F.col("to").alias("node")).agg(F.sum("mass").alias("mass"))
        reached.append(stage(moved, "front"))
        if reached[-1].isEmpty():
            break
    every = reached[0]
    for front in reached[1:]:
        every = every.unionByName(front)
    mass = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k) for k in ("trust", "distrust")]
    scores = stage(every.groupBy(F.col("node").alias("host")).agg(*mass), "scores")
    for spent in [degree, walks, *reached]:
        discard(spent)
    return scores


def judge(pages: DataFrame, rules: DataFrame, damping: int = 85, steps: int = 40, threshold: int = 50) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, for every page."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    fits = stage(fitting_rules(urls.select("host").distinct(), rules), "fits")
    first = F.get(F.filter("fits", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    judged = urls.join(fits, "host", "left").withColumn("first", first).drop("fits")
    votes = [F.sum(F.when(F.col("first.verdict") == v, UNIT).otherwise(0)).alias(k) for v, k in (("allow", "trust"), ("block", "distrust"))]
    seeds = judged.where("first is not null").groupBy("host").agg(*votes)
    scores = propagate(seeds, host_edges(pages), damping, steps)
    out = judged.join(scores, "host", "left").fillna(0, ["trust", "distrust"])
    bad = F.expr(f"distrust * 100 > {threshold} * (trust + distrust)")
    return out.select(
        "page_id", "host", "path", F.col("first.rule").alias("rule"),
        F.coalesce(F.col("first.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "trust", "distrust",
    )
