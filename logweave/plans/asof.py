"""For all pairs of event series: how long after each event of one the next event of the other comes.

Events are (source, t, n): an instant and how many events it stands for. Time
is cut into windows of the length asked for, so the answer to an event lies in
its own window or the next. A window's sources are dealt into as many groups
as keep a group near ``block`` instants; a task holds the events of one
group of sources and, from this and the next window, those of another group,
and searches each source's sorted instants for all events of the first at
once. An event is copied once per group (mostly there is one), not once per
source, and no row per (event, source) reaches a shuffle. A source with more
instants than ``block`` in one window fills a group alone; its distinct
microseconds bound it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

BLOCK = 100_000
ROWS_OUT = 50_000


def next_lags(
    t_a: np.ndarray, n_a: np.ndarray, s_a: np.ndarray, t_b: np.ndarray, s_b: np.ndarray, window: int
) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Per series b: (a, b, lag, n) of the events of other series that b follows within ``window``, equal lags together."""
    order = np.lexsort((t_b, s_b))
    t_b, s_b = t_b[order], s_b[order]
    cuts = np.flatnonzero(np.append(True, s_b[1:] != s_b[:-1])) if len(s_b) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(s_b))):
        at = np.searchsorted(t_b[lo:hi], t_a, "left")
        lag = t_b[lo:hi][np.minimum(at, hi - lo - 1)] - t_a
        ok = np.flatnonzero((at < hi - lo) & (lag <= window) & (s_a != s_b[lo]))
        if not len(ok):
            continue
        ok = ok[np.lexsort((lag[ok], s_a[ok]))]
        a, lags = s_a[ok], lag[ok]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (lags[1:] != lags[:-1])))
        yield a[first], int(s_b[lo]), lags[first], np.add.reduceat(n_a[ok], first)


def lag_counts(events: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """(source_a, source_b, lag, w): by lag up to ``window``, the a events whose next b event comes that much later.

    ``events`` holds each (source, t) once, with its number ``n``; it is read
    three times (give it materialized). A source is not paired with itself;
    null is a source of its own. An event at the same instant follows at lag 0.
    """
    ship_package(events.sparkSession)
    e = events.select("source", "t", "n", F.floor(F.col("t") / F.lit(window)).cast("long").alias("c"))
    seen = e.select("c").unionAll(e.select((F.col("c") - 1).alias("c")))
    parts = seen.groupBy("c").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    group = F.pmod(F.xxhash64("source"), "parts").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    first = e.join(parts, "c").select("c", group.alias("ga"), every.alias("gb"), "source", "t", "n", F.lit(True).alias("asks"))
    answers = e.unionByName(e.withColumn("c", F.col("c") - 1))
    second = answers.join(parts, "c").select("c", every.alias("ga"), group.alias("gb"), "source", "t", "n", F.lit(False).alias("asks"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        known = rows["source"].combine_chunks().dictionary_encode(null_encoding="encode")
        names, source = known.dictionary, known.indices.to_numpy()
        t, n, asks = rows["t"].to_numpy(), rows["n"].to_numpy(), rows["asks"].to_numpy(zero_copy_only=False)
        held: list[list[np.ndarray]] = [[], [], [], []]
        size = 0

        def out() -> pa.RecordBatch:
            a, b, lag, w = (np.concatenate(h) for h in held)
            return pa.RecordBatch.from_arrays(
                [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(lag), pa.array(w)], ["source_a", "source_b", "lag", "w"]
            )

        for a, b, lag, w in next_lags(t[asks], n[asks], source[asks], t[~asks], source[~asks], window):
            for h, v in zip(held, (a, np.full(len(a), b, a.dtype), lag, w)):
                h.append(v)
            size += len(a)
            if size >= ROWS_OUT:
                yield out()
                held, size = [[], [], [], []], 0
        if size:
            yield out()

    return first.unionByName(second).groupBy("c", "ga", "gb").applyInArrow(search, "source_a string, source_b string, lag long, w long")
