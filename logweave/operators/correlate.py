"""Cross-source analyses: rate correlation, error cascades, shared identifiers.

All three take one log table with a ``source`` column (not a dict of tables).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import jre
from ..plans.asof import lag_counts
from ..plans.bloom import maybe_shared
from ..plans.gram import pair_products
from ..plans.quantiles import exact_percentiles
from ..session import materialize
from .events import floor_minutes, with_event_time

def is_error(level: Column, msg: Column) -> Column:
    """Error for cascades: level ERROR/FATAL/WARN/WARNING or a 4xx/5xx code in msg."""
    return F.coalesce(F.upper(level).isin(*C.ERROR_LEVELS), F.lit(False)) | F.coalesce(
        msg.rlike(jre(C.ERROR_STATUS_PATTERN)), F.lit(False)
    )


# ── 1. event-rate correlation ──────────────────────────────────────────────

def rate_buckets(df: DataFrame, bucket_minutes: int = 1, weight_col: str | None = None, **time_kw) -> DataFrame:
    """Events per source per epoch-aligned bucket: (source, bucket, events).

    ``weight_col`` names a count per row, for tables that were aggregated before.
    """
    timed = with_event_time(df, **time_kw)
    return timed.groupBy("source", floor_minutes(F.col("ts"), bucket_minutes).alias("bucket")).agg(
        (F.sum(weight_col) if weight_col else F.count(F.lit(1))).cast("long").alias("events")
    )


_GRID = 32  # keys that spread the grid of all source pairs over tasks


def _source_pairs(sources: DataFrame, cols: list[str]) -> DataFrame:
    """Every pair a ≤ b of the rows of ``sources`` (one per source), as an equi-join on ``_GRID`` keys.

    The result asks for all pairs; each of them comes out of the task of its
    key, and no row holds all sources.
    """
    a = sources.select(*[F.col(c).alias(f"a_{c}") for c in cols], F.explode(F.sequence(F.lit(0), F.lit(_GRID - 1))).alias("__lw_k"))
    b = sources.select(*[F.col(c).alias(f"b_{c}") for c in cols], F.pmod(F.xxhash64("source"), F.lit(_GRID)).cast("int").alias("__lw_k"))
    return a.join(b, "__lw_k").where(F.col("a_source") <= F.col("b_source")).drop("__lw_k")


def rate_correlation(df: DataFrame, bucket_minutes: int = 1, digits: int | None = 3, **time_kw) -> DataFrame:
    """Pearson r of per-bucket event counts for every ordered source pair (long form).

    The series are aligned on the union of non-empty buckets, missing = 0. No
    wide pivot: r = (N·Sxy − Sx·Sy) / sqrt((N·Sxx − Sx²)(N·Syy − Sy²)), where
    Sxy comes from products of blocks of sources and buckets
    (:mod:`logweave.plans.gram`). Counts are whole numbers, all sums exact decimals. Pairs are
    computed for a ≤ b and mirrored. Constant series give NaN. Fewer than two
    sources → no rows.
    """
    c = materialize(rate_buckets(df, bucket_minutes, **time_kw))  # read four times below
    exact = lambda x: x.cast("decimal(38,0)")
    x = exact(F.col("events"))
    total = lambda v: F.sum(v).cast("decimal(38,0)")
    per_source = c.groupBy("source").agg(total(x).alias("s"), total(exact(x * x)).alias("ss"))
    shape = lambda col: c.select(col).distinct().agg(F.count(F.lit(1))).scalar()
    sxy = pair_products(c.withColumn("at", F.unix_micros("bucket")), "source", "at", "events")
    sxy = sxy.withColumnsRenamed({"a": "a_source", "b": "b_source", "product": "sxy"})
    g = _source_pairs(per_source, ["source", "s", "ss"]).join(sxy, ["a_source", "b_source"], "left")
    g = g.withColumn("n", shape("bucket")).where(shape("source") >= 2)
    scaled = lambda p, q: exact(exact(F.col("n")) * p) - exact(q)
    num = scaled(F.coalesce(F.col("sxy"), exact(F.lit(0))), F.col("a_s") * F.col("b_s"))
    da = scaled(F.col("a_ss"), F.col("a_s") * F.col("a_s"))
    db = scaled(F.col("b_ss"), F.col("b_s") * F.col("b_s"))
    root = F.sqrt(da.cast("double")) * F.sqrt(db.cast("double"))
    r = F.when((da > 0) & (db > 0), num.cast("double") / root).otherwise(F.lit(float("nan")))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)) if digits is None else F.bround(r, digits)
    r = F.when((da > 0) & (db > 0), r).otherwise(F.lit(float("nan")))
    pair = lambda p, q: F.struct(F.col(p).alias("source_a"), F.col(q).alias("source_b"))
    both = F.when(F.col("a_source") == F.col("b_source"), F.array(pair("a_source", "b_source"))).otherwise(F.array(pair("a_source", "b_source"), pair("b_source", "a_source")))
    return g.select(F.explode(both).alias("p"), r.alias("r")).select("p.source_a", "p.source_b", "r")


# ── 2. error cascades ──────────────────────────────────────────────────────

def error_instants(df: DataFrame, **time_kw) -> DataFrame:
    """Distinct error instants per source with their multiplicity: (source, t µs, n)."""
    timed = with_event_time(df, **time_kw)
    return (
        timed.where(is_error(F.col("level"), F.col("msg")))
        .groupBy("source", F.unix_micros("ts").alias("t"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def error_cascades(
    df: DataFrame,
    window_sec: int = 60,
    min_cascades: int = 2,
    digits: int | None = 2,
    **time_kw,
) -> DataFrame:
    """For every ordered pair A≠B: how often an A error is followed by a B error within W.

    For each A error at t the first B error in [t, t+W] counts (lag = its time − t).
    Errors are first reduced to distinct (source, instant) with a count, so a
    burst of identical times (e.g. untimed lines at 1970) is one row. The
    search goes by blocks of sources (:mod:`logweave.plans.asof`); out come
    the lags of each pair with their numbers, from which the exact median,
    the mean and the least lag are taken.
    """
    W = int(window_sec) * 1_000_000
    e = materialize(error_instants(df, **time_kw))
    totals = e.groupBy(F.col("source").alias("source_a")).agg(F.sum("n").alias("errors_a"))
    lags = lag_counts(e, W).groupBy("source_a", "source_b", "lag").agg(F.sum("w").alias("w"))
    lags = materialize(lags.withColumn("lag_s", F.col("lag") / F.lit(1_000_000.0)))
    out = (
        lags.groupBy("source_a", "source_b")
        .agg(
            F.sum("w").alias("cascades"),
            (F.sum(F.col("lag_s") * F.col("w")) / F.sum("w")).alias("mean_lag_s"),
            F.min("lag_s").alias("min_lag_s"),
        )
        .where(F.col("cascades") >= F.lit(int(min_cascades)))
        .join(totals, "source_a")
        # exact weighted median; bounded partitions (see plans/quantiles.py)
        .join(exact_percentiles(lags, ["source_a", "source_b"], "lag_s", [0.5], weight="w", distinct_values=True)
              .withColumnRenamed("p_0", "median_lag_s"), ["source_a", "source_b"])
    )
    rate = F.col("cascades") / F.col("errors_a") * F.lit(100.0)
    rnd = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    return out.select(
        "source_a", "source_b", "cascades", "errors_a",
        rate.alias("trigger_pct"),
        F.format_string("%.1f%%", rate).alias("trigger_rate"),
        rnd(F.col("mean_lag_s")).alias("mean_lag_s"),
        rnd(F.col("median_lag_s")).alias("median_lag_s"),
        rnd(F.col("min_lag_s")).alias("min_lag_s"),
    ).orderBy(F.col("cascades").desc(), "source_a", "source_b")


def cascade_matrix(cascades: DataFrame) -> DataFrame:
    """Long source × source cascade counts over the sources named in ``cascades``, 0 when absent."""
    cascades = materialize(cascades.select("source_a", "source_b", "cascades"))  # read twice below
    names = cascades.select(F.col("source_a").alias("source")).union(cascades.select("source_b")).distinct()
    half = _source_pairs(names, ["source"])
    pair = lambda p, q: F.struct(F.col(p).alias("source_a"), F.col(q).alias("source_b"))
    both = F.when(F.col("a_source") == F.col("b_source"), F.array(pair("a_source", "b_source"))).otherwise(F.array(pair("a_source", "b_source"), pair("b_source", "a_source")))
    grid = half.select(F.explode(both).alias("p")).select("p.source_a", "p.source_b")
    return grid.join(cascades, ["source_a", "source_b"], "left").select(
        "source_a", "source_b", F.coalesce(F.col("cascades"), F.lit(0)).cast("long").alias("cascades")
    )


# ── 3. identifiers shared across sources ───────────────────────────────────

def id_pattern(patterns: Sequence[str]) -> str:
    if not patterns:
        raise ValueError("no id patterns")
    joined = "|".join(patterns)
    re.compile(joined)  # an invalid pattern raises, as it should
    return jre(joined)


def id_occurrences(df: DataFrame, patterns: Sequence[str] = C.DEFAULT_ID_PATTERNS, **time_kw) -> DataFrame:
    """One row per identifier occurrence in a timed row: (id, source, ts)."""
    timed = with_event_time(df, **time_kw)
    return timed.select(
        F.explode(F.regexp_extract_all(F.coalesce(F.col("msg"), F.lit("")), F.lit(id_pattern(patterns)), 0)).alias("id"),
        "source",
        "ts",
    )


def shared_ids(df: DataFrame, patterns: Sequence[str] = C.DEFAULT_ID_PATTERNS, top: int | None = None, bloom_bits: int | None = None, **time_kw) -> DataFrame:
    """All identifiers seen in ≥2 sources; ``top`` keeps the first ones of a report.

    The report's order is most sources, then most occurrences, then the id.
    Occurrences are pre-aggregated per (id, source) before the per-id step, so
    a hot identifier costs one row per source there. ``bloom_bits`` adds a
    Bloom filter per source in front (:mod:`logweave.plans.bloom`): where most
    identifiers stand in one source, they never reach the shuffle; the text is
    then read twice.
    """
    occ = id_occurrences(df, patterns, **time_kw)
    if bloom_bits:
        occ = maybe_shared(occ, "id", "source", bloom_bits)
    per = occ.groupBy("id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    g = (
        per.groupBy("id")
        .agg(
            F.sort_array(F.collect_list("source")).alias("source_list"),
            F.count(F.lit(1)).alias("n_sources"),
            F.sum("n").alias("n_occurrences"),
            F.min("t0").alias("first_ts"),
            F.max("t1").alias("last_ts"),
        )
        .where(F.col("n_sources") >= 2)
    )
    out = g.select(
        "id",
        F.array_join("source_list", ", ").alias("sources"),
        "n_sources",
        "n_occurrences",
        F.date_format("first_ts", "HH:mm:ss").alias("first_seen"),
        F.date_format("last_ts", "HH:mm:ss").alias("last_seen"),
        F.bround((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1_000_000.0), 1).alias("span_s"),
        "first_ts",
        "last_ts",
    )
    if top is not None:
        out = out.orderBy(F.col("n_sources").desc(), F.col("n_occurrences").desc(), F.col("id")).limit(int(top))
    return out


def track_id(df: DataFrame, id_value: str, patterns: Sequence[str] = C.DEFAULT_ID_PATTERNS, snippet: int | None = None, **time_kw) -> DataFrame:
    """Timed rows that carry any identifier and contain ``id_value``: (source, ts, msg).

    ``snippet`` adds the first so many characters of ``msg`` for a list.
    """
    timed = with_event_time(df, **time_kw)
    msg = F.coalesce(F.col("msg"), F.lit(""))
    extra = [F.left(msg, F.lit(snippet)).alias("snippet")] if snippet else []
    # the cheap search first
    return timed.where(msg.contains(id_value) & msg.rlike(id_pattern(patterns))).select("source", "ts", msg.alias("msg"), *extra)
