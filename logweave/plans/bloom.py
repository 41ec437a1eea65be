"""Which items may stand in two groups or more: one Bloom filter per group, compared bit by bit.

Each group's items set bits of a filter of ``bits`` places (one hash). Filters
are aggregated as pages of 32,768 bits, combined before the shuffle, so what
is shuffled is pages, not items. A bit that two groups set may belong to an
item of both; an item whose bit only one group set cannot. The pages of such
bits have a fixed size (``bits / 8`` bytes in all, 8 MB by default): Spark
broadcasts them below its limit, and drops the other items before their own
shuffle. Beyond about ``bits`` items the filter lets ever more through, and
the result stays right.

:func:`maybe_among` asks the same of one table's keys in another: a filter of
the other table's keys, sized by their number and at most ``MOST_PAGES`` pages,
is broadcast, and rows whose key surely stands there nowhere are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, ship_package

PAGE = 32_768  # bits of Spark's bitmap aggregate
BITS = 1 << 26
MOST_PAGES = 1 << 12  # of one table's keys: 16 MB in all
KEY_BITS = 16  # per key, below that
PROBES = 3  # bits a key sets, all in one page


def _place(item: str, bits: int) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64(item), F.lit(bits))
    return F.floor(slot / F.lit(PAGE)).cast("int"), (slot % F.lit(PAGE)).cast("int")


def shared_pages(df: DataFrame, item: str, group: str, bits: int = BITS) -> DataFrame:
    """(page, words): the bits that at least two groups set, 64 to a word; pages without one are left out."""
    ship_package(df.sparkSession)
    page, bit = _place(item, bits)
    own = df.select(F.col(group).alias("g"), page.alias("page"), bit.alias("bit")).groupBy("g", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def both(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, several = np.zeros(PAGE // 64, "<i8"), np.zeros(PAGE // 64, "<i8")
        for batch in batches:
            for raw in batch.column("bits"):
                mine = np.frombuffer(raw.as_py(), "<i8")
                several |= seen & mine
                seen |= mine
        if several.any():
            words = pa.array([several.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), words], ["page", "words"])

    return own.select("page", "bits").groupBy("page").applyInArrow(both, "page int, words array<long>")


def maybe_shared(df: DataFrame, item: str, group: str, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose ``item`` may stand in two groups: none of a shared item is lost. ``df`` is read twice."""
    ensure_checkpoint_dir(df.sparkSession)
    pages = materialize(shared_pages(df, item, group, bits)).withColumnRenamed("page", "__lw_page")
    page, bit = _place(item, bits)
    met = df.withColumn("__lw_page", page).withColumn("__lw_bit", bit).join(pages, "__lw_page")
    word = F.element_at("words", F.floor(F.col("__lw_bit") / 64).cast("int") + 1)
    return met.where(F.bit_get(word, F.col("__lw_bit") % 64) == 1).select(*df.columns)


def _probes(keys: list[str], pages: int) -> tuple[Column, list[Column]]:
    """A key's page and its bits there, from one hash: 15 bits each, the page from those above."""
    h = F.xxhash64(*keys)
    bits = [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(PAGE - 1)).cast("int") for i in range(PROBES)]
    return F.shiftrightunsigned(h, 15 * PROBES).bitwiseAND(F.lit(pages - 1)).cast("int"), bits


def pages_for(count: int) -> int:
    """A power of two, so many pages that each of ``count`` keys has ``KEY_BITS`` bits, ``MOST_PAGES`` at most."""
    return min(MOST_PAGES, 1 << max(0, -(-count * KEY_BITS // PAGE) - 1).bit_length())


def key_pages(df: DataFrame, keys: list[str], pages: int) -> DataFrame:
    """(page, words): a filter of the keys of ``df``; every page has all its words."""
    page, bits = _probes(keys, pages)
    one = F.lit(1).cast("long")
    held = df.select(page.alias("page"), F.explode(F.array(*bits)).alias("bit"))
    held = held.select("page", F.shiftright("bit", 6).alias("word"), F.call_function("shiftleft", one, F.col("bit") % 64).alias("mask"))
    width = PAGE // 64
    empty = df.sparkSession.range(pages * width).select(
        F.floor(F.col("id") / width).cast("int").alias("page"), (F.col("id") % width).cast("int").alias("word"), F.lit(0).cast("long").alias("mask")
    )
    words = held.unionByName(empty).groupBy("page", "word").agg(F.bit_or("mask").alias("mask"))
    words = words.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("words"))
    return words.select("page", F.transform("words", lambda w: w["mask"]).alias("words"))


def maybe_among(df: DataFrame, others: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The rows of ``df`` whose ``keys`` (no nulls) may stand in ``others``, which has about ``count`` different ones.

    No row that stands there is lost. What is broadcast has at most
    ``MOST_PAGES`` pages, whatever the sizes of the tables.
    """
    n = pages_for(count)
    page, bits = _probes(keys, n)
    pages = materialize(key_pages(others, keys, n))  # ready before the join runs: its broadcast waits for no other stage
    met = df.withColumn("__lw_page", page).join(F.broadcast(pages.withColumnRenamed("page", "__lw_page")), "__lw_page")
    for bit in bits:
        met = met.where(F.bit_get(F.get("words", F.shiftright(bit, 6)), bit % 64) == 1)
    return met.select(*df.columns)
