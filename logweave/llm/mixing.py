"""Mixing sources to target weights by a low-discrepancy source schedule.

Every document's words stand, in a hash-shuffled order, on one line per
source; the line is cut into blocks of ``block_tokens`` words. A source's
target (in words) is covered by as many slots. Slot numbers come from the van
der Corput points: point ``v`` of ``2**m`` belongs to the source whose
cumulative weight interval holds ``v``, and stands at the bit-reversed
position of ``v``, so that every stretch of the schedule holds each source in
proportion. The r-th slot of a source takes its r-th block, passing round the
line again when it ends; the last slot is cut where the target is reached.

DataFrame functions only. No global or per-source window sees documents or
slots: prefix sums run in two levels (hash buckets, then inside a bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import join_on, n_words, stage

_BUCKET_HEX = 3  # 4,096 hash buckets per source
_SLOT_CHUNK = 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, shuffle, tie): one row per row of ``docs``, written once."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        n_words(text).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("shuffle"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"),
    )


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, weight, target): water-filling below ``epochs`` times each size.

    Sources by code point (null last) take the weights in turn. Sorted by cap
    over weight, the capped sources are a prefix; what they leave is shared
    by weight among the rest. One row per source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(0))
    idx = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (idx % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    src = src.select(
        "*",
        F.row_number().over(by_ratio).alias("k"),
        (
            (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    free = F.col("weight") * F.col("level") <= F.col("cap")
    src = src.withColumn("first_free", F.min(F.when(free, F.struct("k", "level"))).over(everything))
    target = F.when(F.col("k") < F.col("first_free.k"), F.col("cap")).otherwise(F.col("weight") * F.col("first_free.level"))
    # a last bit of rounding must not lift a target above its cap
    return src.select("source", "source_size", "weight", F.least(F.coalesce(target, F.col("cap")), F.col("cap")).alias("target"))


def _bit_reversed(v: Column, m: Column) -> Column:
    return F.when(m == 0, F.lit(0)).otherwise(
        F.conv(F.reverse(F.lpad(F.bin(v), m.cast("int"), F.lit("0"))), 2, 10).cast("long")
    )


def schedule(goals: DataFrame, block_tokens: int) -> DataFrame:
    """(source, slot, rank, block, upto): which block each slot takes and how far into it."""
    length, quota = F.col("source_size"), F.floor("target").cast("long")
    everything = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = (
        goals.filter("source_size > 0 and target >= 1")
        .withColumn("quota", quota)
        .withColumn("blocks", F.ceil(length / block_tokens).cast("long"))
        .withColumn("passes", F.floor(F.col("quota") / length).cast("long"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil((F.col("quota") - F.col("passes") * length) / block_tokens).cast("long"))
        .withColumn("first", F.sum("slots").over(everything) - F.col("slots"))
        .withColumn("m", F.ceil(F.log2(F.sum("slots").over(W.partitionBy(F.lit(0))))).cast("long"))
    )
    chunks = s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / _SLOT_CHUNK)))).repartition("source", "chunk")
    lo = F.col("chunk") * _SLOT_CHUNK
    hi = F.least(lo + _SLOT_CHUNK, F.col("slots")) - 1
    pts = chunks.select("source", "source_size", "quota", "blocks", "m", F.explode(F.sequence(lo + F.col("first"), hi + F.col("first"))).alias("v"))
    pts = pts.withColumn("slot", _bit_reversed(F.col("v"), F.col("m"))).withColumn("part", F.floor(F.col("slot") / _SLOT_CHUNK))
    # rank of a slot in its source: slots in earlier parts, then inside the part
    parts = pts.groupBy("source", "part").agg(F.count("*").alias("n"))
    parts = parts.select("source", "part", (F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).alias("earlier"))
    ranked = join_on(pts, parts, ["source", "part"])
    rank = F.row_number().over(W.partitionBy("source", "part").orderBy("slot")) - 1 + F.col("earlier")
    ranked = ranked.withColumn("rank", rank.cast("long"))
    block = F.col("rank") % F.col("blocks")
    start = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + block * block_tokens
    return ranked.select("source", "slot", "rank", block.alias("block"), (block * block_tokens + F.least(F.lit(block_tokens), F.col("quota") - start)).alias("upto"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, epochs: int = 2, block_tokens: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, first_slot, tie.

    ``taken`` counts the words the mix takes of the document over all passes;
    ``first_slot`` is the earliest slot that takes some (null: none).
    Null or blank text has size 0 and takes 0; a null source is a source of
    its own; a null doc_id shuffles as an empty id; repeated rows are separate
    documents; extra columns are ignored; no rows give no rows.
    """
    d = stage(sized(docs), "sizes").withColumn("bucket", F.substring("shuffle", 1, _BUCKET_HEX))
    goals = targets(d, weights, share, epochs)
    per = d.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    per = per.select("source", "bucket", (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("earlier"))
    inside = W.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "tie").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    d = join_on(d, per, ["source", "bucket"]).withColumn("x", F.col("earlier") + F.col("inside"))
    d = join_on(d, goals, ["source"])
    row = ["doc_id", "source", "size", "source_size", "target", "tie", "x"]
    full = d.filter("size > 0").select(
        *row, F.explode(F.sequence(F.floor(F.col("x") / block_tokens), F.floor((F.col("x") + F.col("size") - 1) / block_tokens))).alias("block")
    )
    got = join_on(full, schedule(goals, block_tokens), ["source", "block"], "left")
    lo = F.greatest("x", F.col("block") * block_tokens)
    upto = F.coalesce("upto", F.lit(0))  # a block no slot takes
    words = F.greatest(F.least(F.col("x") + F.col("size"), upto) - lo, F.lit(0))
    got = got.withColumn("words", words)
    taken = got.groupBy(*row).agg(
        F.sum("words").cast("long").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot")
    )
    none = d.filter("size = 0").select(*row, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return taken.unionByName(none).drop("x")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture as whole documents: each row of ``docs`` as often as it was taken.

    A document is repeated ``taken / size`` times, rounded: at most one
    document per source and pass is cut by a target, so each source stays
    within one document of it. Documents without words leave.
    """
    whole = mix(docs, **how).filter("size > 0").groupBy("doc_id", "source", "tie").agg(
        F.round(F.sum("taken") / F.sum("size")).cast("int").alias("n")  # repeated rows share their passes evenly
    ).filter("n > 0")
    tie = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    same = docs["doc_id"].eqNullSafe(whole["doc_id"]) & docs["source"].eqNullSafe(whole["source"]) & (tie == whole["tie"])
    times = F.explode(F.sequence(F.lit(1), whole["n"]))
    return docs.join(whole, same).select(*[docs[c] for c in docs.columns], times.alias("__pass")).drop("__pass")
