"""Quality rules with risk-controlled thresholds.

Two fixed rules (too few words, too many repeated words) come first. Each
further rule rejects documents whose value lies above a cutoff; cutoffs are
chosen on labelled holdout documents so that, in every stratum, a rule
rejects more than ``alpha`` of the good documents only with a controlled
probability:

* for each stratum, rule and cutoff, count the good documents (quality 1) and
  those the cutoff would reject; the exact binomial tail
  ``P(Bin(n, alpha) <= rejected)`` is the p-value of "rejects more than alpha";
* cutoffs of a rule are tested from loose to strict and testing stops at the
  first one not certified (fixed-sequence testing), at a level of ``delta``
  divided by the number of rules and strata (Bonferroni), so all certified
  cutoffs hold together with probability ``1 - delta``;
* among the certified cutoffs, the one that catches most bad documents
  (quality 0) is taken, each lost good document counting ``good_cost`` times
  (the loosest of equal ones); with none, the rule is off in that stratum.

DataFrame functions only. Values are computed inside the row; only numbers
are shuffled, and labels meet documents' numbers, never their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACES, join_on, stage

SYMBOLS = "#*$%&|<>"
#: rule -> cutoffs from loose to strict
RULES = {
    "symbols_per_word": [8.0, 5.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4],
    "bangs_per_word": [5.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3],
    "upper_share": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25],
    "repeat_share": [0.48, 0.46, 0.44, 0.42, 0.4, 0.36, 0.32, 0.28, 0.24, 0.2],
    "chars_per_word": [60.0, 50.0, 40.0, 35.0, 30.0, 25.0, 22.0, 20.0, 18.0, 16.0],
}
N_CUTOFFS = 10


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array (null: empty)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def repeat_words(ws: Column) -> Column:
    """Number of words inside 3-word windows that occur at least twice in the array."""
    size = F.size

    def repeated(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)),
            )
            starts = F.array_sort(F.transform(again, lambda x: x["i"]))
            zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
            return F.aggregate(starts, zero, step, lambda a: a["n"])

        return F.when(size(F.array_distinct(h)) == size(h), F.lit(0)).otherwise(bind(by_hash, covered))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(size(w) < 4, F.lit(0)).otherwise(bind(hashes, repeated))

    return bind(ws, of)


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts per row of ``docs``: doc_id, stratum, the base counts and further ones.

    Null or blank text has zero counts and fails the base rule; null doc_id
    and null stratum are kept as they are; repeated rows stay repeated.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = words(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    letters_up = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    return docs.select(
        F.col("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        bind(ws, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("l"),
        count("!").cast("long").alias("n_bangs"),
        letters_up.cast("long").alias("n_upper"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"),
    ).select(
        "doc_id", "stratum", F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_bangs", "n_upper", "tie",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    w, part = F.greatest("n_words", F.lit(1)), lambda a, b: F.col(a).cast("double") / b
    return {
        "symbols_per_word": part("n_symbols", w),
        "bangs_per_word": part("n_bangs", w),
        "upper_share": part("n_upper", F.greatest("word_chars", F.lit(1))),
        "dup_line_share": part("n_dup_lines", F.greatest("n_lines", F.lit(1))),
        "repeat_share": part("n_repeat_words", w),
        "chars_per_word": part("word_chars", w),
    }


def levels() -> Column:
    """array<struct<rule, level>>: how many of a rule's cutoffs the row lies above."""
    def level(name: str, value: Column) -> Column:
        above = F.filter(F.array(*map(F.lit, RULES[name])), lambda c: value > c)
        return F.struct(F.lit(name).alias("rule"), F.size(above).alias("level"))

    return F.array(*[level(name, value) for name, value in rule_values().items()])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in logarithms (1 beyond the mean)."""
    odds = F.log(F.lit(p / (1 - p)))
    zero = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("all"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(a["all"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(a["all"], term) - top))).alias("all"))

    some = F.aggregate(F.sequence(F.lit(1).cast("long"), k), zero, add, lambda a: F.exp(a["all"]))
    return F.when(k >= n * p, F.lit(1.0)).when(k < 1, F.exp(zero["all"])).otherwise(some)


def cutoffs(held: DataFrame, alpha: float, delta: float, good_cost: float) -> DataFrame:
    """(stratum, allowed: map<rule, level>): the largest level a kept row may have.

    ``held`` has stratum, quality and levels. All steps after the first count
    work on at most strata x rules x cutoffs rows.
    """
    seen = held.select("stratum", "quality", F.explode("levels").alias("x")).groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level"))
    seen = seen.agg(F.sum(F.col("quality").cast("long")).alias("good"), F.sum(1 - F.col("quality").cast("long")).alias("bad"))
    # cutoff i rejects rows with a level of i or more: 1 is the strictest, N_CUTOFFS the loosest
    steps = seen.select("stratum", "rule", F.explode(F.sequence(F.lit(1), F.lit(N_CUTOFFS))).alias("i"), "level", "good", "bad")
    hit = lambda c: F.sum(F.when(F.col("level") >= F.col("i"), F.col(c)).otherwise(F.lit(0)))
    steps = steps.groupBy("stratum", "rule", "i").agg(F.sum("good").alias("n"), hit("good").alias("k"), hit("bad").alias("caught"))
    # one row per stratum, rule and cutoff: every stratum has the first rule's first cutoff
    tests = F.sum(F.when((F.col("rule") == next(iter(RULES))) & (F.col("i") == 1), len(RULES))).over(W.partitionBy(F.lit(0)))
    steps = steps.withColumn("ok", binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / tests)
    upto = W.partitionBy("stratum", "rule").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    steps = steps.withColumn("ok", F.min(F.col("ok").cast("int")).over(upto) == 1)
    gain = F.col("caught") - good_cost * F.col("k")
    best = steps.filter(F.col("ok") & (gain > 0)).groupBy("stratum", "rule").agg(F.max_by("i", F.struct(gain, F.col("i"))).alias("i"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.col("i") - 1))).alias("allowed"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05, good_cost: float = 10.0) -> DataFrame:
    """Counts and verdict per row of ``docs``: the base counts, base_failed, kept, tie.

    ``labels`` has doc_id and quality (1 good, 0 bad; other values and null
    ids are unused; a doc_id labelled twice counts twice). Without labels, or
    with too few to certify any cutoff, only the base rules reject.
    """
    f = stage(features(docs, stratum), "quality")
    f = f.withColumn("base_failed", base_failed()).withColumn("levels", levels())
    marks = labels.select(F.col("doc_id"), F.col("quality")).filter("quality in (0, 1)")
    allowed = cutoffs(f.join(marks, "doc_id"), alpha, delta, good_cost)
    out = join_on(f, allowed, ["stratum"], "left")
    above = F.exists("levels", lambda x: F.coalesce(x["level"] > F.try_element_at(F.col("allowed"), x["rule"]), F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~above).drop("levels", "allowed", "stratum")


def kept_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that pass; all their columns."""
    good = judge(docs, labels, **how).filter("kept").select("doc_id", "tie").distinct()
    tie = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    return docs.join(good, docs["doc_id"].eqNullSafe(good["doc_id"]) & (tie == good["tie"]), "left_semi")
