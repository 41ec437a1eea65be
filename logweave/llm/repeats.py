"""Where sequences of a fixed length recur: the search behind the two substring operators.

Both ask, for every window of ``window`` positions (words or bytes), whether
the same window also starts earlier. Exact answers need no row per window:

* a window's *anchor* is its gram (``gram`` positions) with the smallest
  hash; equal windows have equal anchors at equal offsets. Consecutive windows
  with the same anchor are a *unit* (about ``(window - gram) / 2`` windows);
  units up to and including one whose anchor hash ends in some zero bits are
  a *block* (about 16 units of words, 8 of bytes);
* equal blocks are found by a 128-bit hash, with one combining aggregate:
  all later copies of a block are covered as a whole;
* anchors outside covered blocks are counted over all documents, as packed
  arrays per shard of documents and bucket of hashes; a window can only recur
  if its anchor does;
* only units of recurring anchors in first copies of blocks remain.

Nothing is grouped by an anchor or a passage in one task: counting combines
before it shuffles, and joins back to occurrences can be split by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, joined, mix64, shards_for, sliding_argmin, span_hashes, stage, total_bytes, word_spans

SHARD_BYTES = 8 << 20  # text per shard of documents
BUCKET_BYTES = 16 << 20  # text per bucket of anchor hashes
NO_ID = (1 << 63) - 1  # a null doc_id comes last


@dataclass
class Runs:
    """The units of a batch of texts, in order: arrays of equal length."""

    doc: np.ndarray  # row in the batch
    start: np.ndarray  # first window's position in its text
    n: np.ndarray  # windows
    place: np.ndarray  # the anchor's position in its text
    anchor: np.ndarray  # its hash
    block: np.ndarray  # number of the unit's block in the batch


@dataclass
class Level:
    """What a position is. ``hashes``: column -> per-position gram hashes, n+1 text bounds, values to hash spans of."""

    name: str
    window: int
    gram: int
    within: bool  # whether a repeat inside one text counts (words), or only between documents (bytes)
    batch: int  # bytes of text worked on at once
    block_units: int  # units in a block on average, a power of two
    hashes: Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray, np.ndarray]]

    def runs(self, column: pa.Array) -> tuple[Runs, np.ndarray, np.ndarray]:
        h, bounds, values = self.hashes(column, self.gram)
        at = sliding_argmin(h, self.window - self.gram + 1)
        owner = np.repeat(np.arange(len(column)), np.diff(bounds))
        if not self.within:  # the byte behind each text belongs to no window
            owner[bounds[1:] - 1] = -1 - np.arange(len(column))
        s = np.flatnonzero(owner[: len(at)] == owner[self.window - 1 : self.window - 1 + len(at)]) if len(at) else np.zeros(0, np.int64)
        at, owner = at[s], owner[s]
        new = np.ones(len(s), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        doc, place, anchor = owner[first], at[first], h[at[first]] if len(first) else np.zeros(0, np.uint64)
        # a block ends behind a unit whose anchor hash ends in zero bits, and with its text
        ends = np.zeros(len(first), np.int64)
        ends[1:] = ((anchor[:-1] & np.uint64(self.block_units - 1)) == 0) | (doc[1:] != doc[:-1])
        n = np.diff(np.concatenate([first, [len(s)]]))
        return Runs(doc, s[first] - bounds[doc], n, place - bounds[doc], anchor, np.cumsum(ends)), bounds, values


def _byte_hashes(column: pa.Array, gram: int):
    data, bounds = joined(column)
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), bounds, data
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # eight bytes from each place on
    h = mix64(wide[:n] * np.uint64(0x9E3779B97F4A7C15) + wide[gram - 8 : gram - 8 + n])
    return h, bounds, data


def _word_hashes(column: pa.Array, gram: int):
    data, ends = joined(column)
    starts, stops = word_spans(data)
    words = span_hashes(data, starts, stops)
    bounds = np.searchsorted(starts, ends)
    h = np.zeros(max(0, len(words) - gram + 1), np.uint64)
    for i in range(gram):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + len(h)]
    return mix64(h), bounds, words


def bytes_level(window: int = 50) -> Level:
    return Level("bytes", window, 16, False, 1 << 18, 8, _byte_hashes)


def words_level(window: int = 20) -> Level:
    return Level("words", window, 8, True, 1 << 21, 16, _word_hashes)


# ── documents ──────────────────────────────────────────────────────────────
def identified(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(doc_id, key, tie, shard, text), the number of shards and of hash buckets.

    ``key`` is doc_id with null last; ``tie`` tells rows of one doc_id apart.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = total_bytes(docs, "text")
    shards, buckets = shards_for(size, SHARD_BYTES), shards_for(size, BUCKET_BYTES)
    tie = F.coalesce(F.xxhash64("text"), F.lit(0))
    key = F.coalesce("doc_id", F.lit(NO_ID).cast("long"))
    out = docs.select("doc_id", key.alias("key"), tie.alias("tie"), "text")
    return out.withColumn("shard", F.pmod(F.xxhash64("key", "tie"), F.lit(shards)).cast("int")), shards, buckets


# ── blocks ─────────────────────────────────────────────────────────────────
def blocks(docs: DataFrame, level: Level) -> DataFrame:
    """(b0, b1, key, tie, start, end): every block by its 128-bit hash; ``end`` is behind its last window."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches(rows, "text", level.batch):
            r, bounds, values = level.runs(batch.column("text"))
            if not len(r.doc):
                continue
            first = np.flatnonzero(np.concatenate([[True], r.block[1:] != r.block[:-1]]))
            last = np.concatenate([first[1:], [len(r.doc)]]) - 1
            doc, start = r.doc[first], r.start[first]
            end = r.start[last] + r.n[last] - 1 + level.window
            raw, width = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
            lo, hi = (bounds[doc] + start) * width, (bounds[doc] + end) * width
            digest = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist())])
            two = np.frombuffer(digest, "<i8").reshape(-1, 2)
            pick = lambda c: batch.column(c).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1])), pick("key"), pick("tie"), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))],
                ["b0", "b1", "key", "tie", "start", "end"],
            )

    return docs.select("key", "tie", "text").mapInArrow(run, "b0 long, b1 long, key long, tie long, start long, end long")


# ── anchors ────────────────────────────────────────────────────────────────
def recurring_anchors(docs: DataFrame, covers: DataFrame, level: Level, shards: int, buckets: int) -> DataFrame:
    """(shard, anchors binary): sorted hashes of the shard's anchors that stand in two places or more outside covered blocks."""

    def packed(texts: pa.Table, facts: pa.Table) -> pa.Table:
        _, covered = shard_facts(facts)
        held = [np.zeros(0, np.uint64)]
        for batch in shard_batches(texts, level):
            r, _, _ = level.runs(batch.column("text"))
            keep = uncovered(r, batch, covered, level.window)
            held.append(r.anchor[keep] if level.within else _distinct(r.doc[keep], r.anchor[keep]))
        u, c = np.unique(np.concatenate(held), return_counts=True)
        h = np.concatenate([u, u[c > 1]])  # twice: it recurs here
        at = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(at, kind="stable")
        h, cut = h[order], np.searchsorted(at[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        blobs = [h[cut[b] : cut[b + 1]].tobytes() for b in some]
        shard = texts.column("shard")[0].as_py() if texts.num_rows else 0
        return pa.table({"bucket": pa.array(some, pa.int32()), "shard": pa.array([shard] * len(some), pa.int32()), "h": pa.array(blobs, pa.binary())})

    def found(table: pa.Table) -> pa.Table:
        cells = table.column("h").to_pylist()
        sizes = np.array([len(c) // 8 for c in cells])
        h = np.frombuffer(b"".join(cells), "<u8")
        u, c = np.unique(h, return_counts=True)
        u = u[c > 1]
        hit = member(u, h)
        ends = np.cumsum(sizes)
        out = [np.unique(h[e - n : e][hit[e - n : e]]).tobytes() for n, e in zip(sizes, ends)]
        return pa.table({"shard": table.column("shard").cast(pa.int32()), "anchors": pa.array(out, pa.binary())})

    sent = with_facts(docs, by_shard(None, covers, shards), shards).applyInArrow(packed, "bucket int, shard int, h binary")
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(found, "shard int, anchors binary").filter(F.length("anchors") > 0)


def _distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return x[keep]


# ── units ──────────────────────────────────────────────────────────────────
def member(of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def uncovered(r: Runs, batch: pa.RecordBatch, covered: dict[tuple[int, int], np.ndarray], window: int) -> np.ndarray:
    """Which units of a batch do not lie in a covered block."""
    keep = np.ones(len(r.doc), bool)
    cut = np.searchsorted(r.doc, np.arange(batch.num_rows + 1))
    for d, name in enumerate(zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist())):
        spans, lo, hi = covered.get(name), cut[d], cut[d + 1]
        if spans is not None and lo < hi:
            at = np.searchsorted(spans[:, 0], r.start[lo:hi], "right") - 1
            keep[lo:hi] = (at < 0) | (r.start[lo:hi] + r.n[lo:hi] - 1 + window > spans[np.maximum(at, 0), 1])
    return keep


def merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of a set of (start, end) spans."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(spans)]]) - 1
    return np.stack([spans[first, 0], reach[last]], axis=1)


def by_shard(anchors: DataFrame | None, covers: DataFrame, shards: int) -> DataFrame:
    """What each shard's task needs beside its documents: (shard, key, tie, start, end, anchors)."""
    nothing = F.lit(None).cast("binary")
    done = covers.select(
        F.pmod(F.xxhash64("key", "tie"), F.lit(shards)).cast("int").alias("shard"), "key", "tie", "start", "end", nothing.alias("anchors")
    )
    if anchors is None:
        return done
    zero = F.lit(None).cast("long")
    know = anchors.select("shard", zero.alias("key"), zero.alias("tie"), zero.alias("start"), zero.alias("end"), "anchors")
    return done.unionByName(know)


def with_facts(docs: DataFrame, facts: DataFrame, shards: int):
    """A shard's documents beside its facts; as many tasks as shards, so that a task's input does not grow."""
    texts = docs.select("shard", "key", "tie", "text").repartition(shards, "shard")
    return texts.groupBy("shard").cogroup(facts.repartition(shards, "shard").groupBy("shard"))


def shard_batches(texts: pa.Table, level: Level) -> Iterator[pa.RecordBatch]:
    return batches(texts.select(["key", "tie", "text"]).combine_chunks().to_batches(), "text", level.batch)


def shard_facts(table: pa.Table) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
    """A shard's recurring anchors, and the covered blocks of its texts sorted by start."""
    blobs = [a for a in table.column("anchors").to_pylist() if a]
    recurring = np.unique(np.frombuffer(b"".join(blobs), "<u8")) if blobs else np.zeros(0, np.uint64)
    spans = table.filter(pc.is_valid(table.column("key")))
    covered: dict[tuple[int, int], list] = {}
    for k, t, a, b in zip(*(spans.column(c).to_pylist() for c in ("key", "tie", "start", "end"))):
        covered.setdefault((k, t), []).append((a, b))
    return recurring, {k: np.array(sorted(v), np.int64) for k, v in covered.items()}


def digested(docs: DataFrame, covers: DataFrame, digest: Callable, schema: str) -> DataFrame:
    """``digest(doc_ids, texts, spans)`` over every document with its merged covered spans."""
    per = covers.groupBy("key", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    per = stage(per, "covers", free=True)
    rows = docs.select("doc_id", "key", "tie", "text").join(per, ["key", "tie"], "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            spans = [merge(np.array([a, b], np.int64).T if a else np.zeros((0, 2), np.int64)) for a, b in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())]
            yield digest(batch.column("doc_id"), batch.column("text"), spans)

    return rows.mapInArrow(run, schema)
