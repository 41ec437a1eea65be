"""Exact percentiles (linear interpolation) without one task holding a group.

``percentile`` keeps a map of every distinct value of a group in one task.
This plan needs only bounded partitions:

1. count weights per (group, value) — a map-side combined aggregate;
2. put values into fine log-scale bins (``bins_per_octave`` per power of two,
   monotone in the value), count per (group, bin) and take running totals
   over the bins of a group — one row per non-empty bin;
3. for each wanted rank (⌊(n−1)p⌋ and ⌈(n−1)p⌉, 0-based, as numpy's
   'linear' method and Spark's ``percentile``) find its bin, then order only
   that bin's values (window over (group, bin)) to read the exact value;
4. interpolate between the two ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_OFFSET = 10_000_000


def value_bin(v: Column, bins_per_octave: int = 1024) -> Column:
    """A long key, non-decreasing in ``v``: fine bins on |v|'s log2, 0 in the middle."""
    k = float(bins_per_octave)
    pos = F.lit(_OFFSET) + F.floor(F.log2(v) * k).cast("long")
    neg = -(F.lit(_OFFSET) + F.floor(F.log2(-v) * k).cast("long"))
    return F.when(v > 0, pos).when(v < 0, neg).otherwise(F.lit(0).cast("long"))


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    ps: list[float],
    weight: str | None = None,
    bins_per_octave: int = 1024,
    distinct_values: bool = False,
) -> DataFrame:
    """One row per group: ``keys`` + ``p_<i>`` (double) for each ``ps[i]``; NULL values are ignored.

    ``distinct_values=True`` says ``df`` already holds one row per
    (group, value) and is cheap to read twice (e.g. materialized): the
    counting step and its checkpoint are skipped.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    base = df.where(F.col(value).isNotNull())
    if distinct_values:
        vals = base.select(*keys, F.col(value).cast("double").alias("__v"), w.alias("__w"))
    else:
        vals = base.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.sum(w).alias("__w"))
    vals = vals.withColumn("__b", value_bin(F.col("__v"), bins_per_octave))
    if not distinct_values:
        vals = materialize(vals)  # read by the bin totals and by the rank lookup
    bins = vals.groupBy(*keys, "__b").agg(F.sum("__w").alias("__bw"))
    grp = Window.partitionBy(*keys)
    bins = (
        bins.withColumn("__end", F.sum("__bw").over(grp.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__n", F.sum("__bw").over(grp))
        .withColumn("__start", F.col("__end") - F.col("__bw"))
    )
    # wanted ranks: (p index, which end, rank)
    h = [(i, float(p)) for i, p in enumerate(ps)]
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                 (F.floor((F.col("__n") - 1) * F.lit(p)) if side == 0 else F.ceil((F.col("__n") - 1) * F.lit(p))).cast("long").alias("r"),
                 ((F.col("__n") - 1) * F.lit(p) - F.floor((F.col("__n") - 1) * F.lit(p))).alias("frac"))
        for i, p in h for side in (0, 1)
    ])
    targets = (
        bins.select(*keys, "__b", "__start", "__end", F.explode(wanted).alias("t"))
        .where((F.col("t.r") >= F.col("__start")) & (F.col("t.r") < F.col("__end")))
        .select(*keys, "__b", "__start", F.col("t.i").alias("__i"), F.col("t.side").alias("__side"),
                F.col("t.r").alias("__r"), F.col("t.frac").alias("__frac"))
    )
    # values of the target bins only, with running weights inside the bin
    need = targets.select(*keys, "__b").distinct()
    inbin = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        vals.join(need, [*keys, "__b"])
        .withColumn("__ve", F.sum("__w").over(inbin))
        .withColumn("__vs", F.col("__ve") - F.col("__w"))
    )
    picked = (
        targets.join(ranked, [*keys, "__b"])
        .where((F.col("__r") - F.col("__start") >= F.col("__vs")) & (F.col("__r") - F.col("__start") < F.col("__ve")))
        .groupBy(*keys, "__i")
        .agg(
            F.max(F.when(F.col("__side") == 0, F.col("__v"))).alias("__lo"),
            F.max(F.when(F.col("__side") == 1, F.col("__v"))).alias("__hi"),
            F.max("__frac").alias("__frac"),
        )
        .withColumn("__q", F.col("__lo") + F.col("__frac") * (F.col("__hi") - F.col("__lo")))
    )
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(f"p_{i}") for i in range(len(ps))]
    )
