"""Suffix-array dedup on bytes by bucket-pointer refinement.

Every byte covered by a ``window``-byte string that also starts in a document
with a smaller doc_id is removed. The corpus's recurring stretches are found
by anchors (see ``repeats``): the anchor's q-gram is a suffix's initial
bucket, and the shuffle deals the buckets out in their order, a large one over several
partitions. In a task, the suffixes of a chunk of
stretches are sorted by bucket-pointer refinement: buckets of equal
7-byte prefixes first, then every bucket is split by the bucket pointers of
the suffixes that stand as many places later as its depth, so each pass
reuses the pointers of the last one and doubles the depth, until buckets are
strings of ``window`` bytes. Only suffixes in buckets of two or more are
sorted again. Where an anchor's stretches fill several chunks, the final
buckets of its chunks are put together by a hash of their string, so no
anchor is held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_on, span_hashes, stage
from .repeats import Level, blocks, by_shard, bytes_level, digested, identified, member, recurring_anchors, shard_batches, shard_facts, uncovered, with_facts

CHUNK_BYTES = 1 << 20  # stretches refined at once; a task holds about 150 bytes for each
_UNITS = "anchor long, unit long, key long, tie long, start long, n int, body binary"
_SCHEMA = pa.schema([("anchor", pa.int64()), ("unit", pa.int64()), ("key", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])


# ── bucket-pointer refinement ──────────────────────────────────────────────
def bucket_pointers(data: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, the rank of its first ``depth`` bytes: equal strings share a pointer.

    A pointer is the bucket's first place in the sorted order, counted from 1.
    Suffixes shorter than a depth sort before their longer equals.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # initial buckets: q-grams of 7 bytes as numbers, 0 behind the end
    q = min(7, depth)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(q, np.uint64)])
    gram = np.zeros(n, np.uint64)
    for i in range(q):
        gram = gram * np.uint64(257) + padded[i : i + n]
    order = np.argsort(gram, kind="stable")
    ranked = gram[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    pointer = np.empty(n + 1, np.int64)
    pointer[order] = np.repeat(first, size) + 1
    pointer[n] = 0
    active = order[np.repeat(size, size) > 1]  # in bucket order
    while q < depth and len(active):
        step = min(q, depth - q)
        own, later = pointer[active], pointer[np.minimum(active + step, n)]
        key = own * (n + 2) + later
        by = np.argsort(key, kind="stable")
        active, own, key = active[by], own[by], key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        bucket = np.concatenate([[True], own[1:] != own[:-1]])
        place = np.arange(len(active))
        start_of = np.maximum.accumulate(np.where(bucket, place, 0))
        new_at = np.maximum.accumulate(np.where(fresh, place, 0))
        pointer[active] = own + new_at - start_of
        ends = np.flatnonzero(fresh)
        size = np.diff(np.concatenate([ends, [len(active)]]))
        active = active[np.repeat(size, size) > 1]
        q += step
    return pointer[:n]


def earlier_windows(bodies: list[bytes], ids: np.ndarray, window: int) -> list[np.ndarray]:
    """Per stretch, the offsets of its windows that also stand in a stretch with a smaller id."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    pointer = bucket_pointers(np.frombuffer(b"".join(bodies), np.uint8), window)
    ends = np.cumsum(sizes)
    n = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(bodies)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = pointer[(ends - sizes)[owner] + offset]
    least = np.full(int(sizes.sum()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, at, ids[owner])
    hit = least[at] < ids[owner]
    return np.split(offset[hit], np.cumsum(np.bincount(owner[hit], minlength=len(bodies)))[:-1])


# ── documents ──────────────────────────────────────────────────────────────
def _stretches(level: Level, docs: pa.Table, facts: pa.Table) -> pa.Table:
    """Units of recurring anchors, with their bytes, in uncovered blocks of one shard's documents."""
    recurring, covered = shard_facts(facts)
    out = [_SCHEMA.empty_table()]
    if not docs.num_rows or not len(recurring):
        return out[0]
    for batch in shard_batches(docs, level):
        r, bounds, data = level.runs(batch.column("text"))
        keep = uncovered(r, batch, covered, level.window) & member(recurring, r.anchor)
        keys, ties = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
        doc, start, n, place = r.doc[keep], r.start[keep], r.n[keep], r.place[keep]
        lo = bounds[doc] + start
        hi = lo + n - 1 + level.window
        unit = span_hashes(data, lo, hi) + (place - start).astype(np.uint64)
        raw = data.tobytes()
        bodies = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        out.append(pa.table([
            pa.array(r.anchor[keep].view(np.int64)), pa.array(unit.view(np.int64)), pa.array(keys[doc]), pa.array(ties[doc]),
            pa.array(start.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(bodies, pa.binary()),
        ], schema=_SCHEMA))
    return pa.concat_tables(out)


_HITS = "anchor long, unit long, first long, x int, y int, h0 long, h1 long"


def _refined(window: int):
    """Rows (anchor, unit, first, body) in range partitions sorted by (anchor, unit) -> windows of them.

    An anchor's stretches are refined together. A window that also stands in
    a stretch of a smaller document is a hit (no hash). An anchor that may go
    on in another chunk (a partition's first and last, and one larger than a
    chunk) also sends its other windows with their 128-bit hash, so that
    its chunks can be put together.
    """

    def solve(rows: pa.Table, going_on: set[int]) -> pa.RecordBatch:
        import xxhash

        anchor = rows.column("anchor").to_numpy()
        new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(new, len(anchor)))
        spans = np.isin(anchor, list(going_on))
        some = np.flatnonzero((np.repeat(size, size) > 1) | spans)
        rows, anchor, spans = rows.take(pa.array(some)), anchor[some], spans[some]
        unit, first, bodies = rows.column("unit").to_numpy(), rows.column("first").to_numpy(), rows.column("body").to_pylist()
        hits = earlier_windows(bodies, first, window)
        runs: list[list[int]] = [[], [], []]  # stretch, first and last window of neighbouring hits
        open_at, open_i, digests = [], [], []
        for k, h in enumerate(hits):
            if len(h):
                new = np.flatnonzero(np.append(True, np.diff(h) > 1))
                runs[0] += [k] * len(new)
                runs[1] += h[new].tolist()
                runs[2] += h[np.append(new[1:], len(h)) - 1].tolist()
            if spans[k]:
                body, known = bodies[k], set(h.tolist())
                for j in range(len(body) - window + 1):
                    if j not in known:
                        open_at.append(k)
                        open_i.append(j)
                        digests.append(xxhash.xxh3_128_digest(body[j : j + window]))
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        where = np.array(runs[0] + open_at, np.int64)
        none = pa.nulls(len(runs[0]), pa.int64())
        hashes = [pa.concat_arrays([none, pa.array(np.ascontiguousarray(both[:, c]))]) for c in (0, 1)]
        columns = [pa.array(x[where]) for x in (anchor, unit, first)]
        columns += [pa.array(runs[c] + open_i, pa.int32()) for c in (1, 2)]
        return pa.RecordBatch.from_arrays([*columns, *hashes], ["anchor", "unit", "first", "x", "y", "h0", "h1"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        before: set[int] = set()  # anchors that began in an earlier chunk; the partition's first one may have
        for batch in it:
            if not batch.num_rows:
                continue
            if held is None and not before:
                before = {batch.column("anchor")[0].as_py()}
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.nbytes < CHUNK_BYTES:
                continue
            anchor = held.column("anchor").to_numpy()
            other = np.flatnonzero(anchor != anchor[-1])
            cut = int(other[-1]) + 1 if len(other) else len(anchor)  # before the last anchor; inside it if it fills the chunk
            whole = cut < len(anchor)
            yield solve(held.slice(0, cut), before if whole else before | {int(anchor[-1])})
            before = set() if whole else {int(anchor[-1])}
            held = held.slice(cut) if whole else None
        if held is not None and held.num_rows:
            yield solve(held, before | {held.column("anchor")[-1].as_py()})

    return run


def covered_bytes(docs: DataFrame, shards: int, buckets: int, level: Level) -> DataFrame:
    """(key, tie, start, end): byte spans covered by windows that also start in a smaller document."""
    all_blocks = stage(blocks(docs, level), "blocks", free=True)
    firsts = all_blocks.groupBy("b0", "b1").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").drop("last")
    copies = join_on(all_blocks, firsts, ["b0", "b1"]).filter("key > first")
    copies = stage(copies.select("key", "tie", "start", "end"), "copies", free=True)
    discard(all_blocks)
    anchors = stage(recurring_anchors(docs, copies, level, shards, buckets), "anchors", free=True)

    def stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        return _stretches(level, left, right)

    units = with_facts(docs, by_shard(anchors, copies, shards), shards).applyInArrow(stretches, _UNITS)
    units = stage(units, "units", free=True)
    discard(anchors)
    # each different stretch once, with its smallest and largest document
    least = F.min(F.struct("key", "body"))
    firsts = units.groupBy("anchor", "unit").agg(least.alias("least"), F.max("key").alias("last"))
    firsts = stage(firsts.select("anchor", "unit", F.col("least.key").alias("first"), "last", F.col("least.body").alias("body")), "firsts", free=True)
    # different stretches of one anchor, refined window by window; a hot anchor is spread over partitions
    dealt = firsts.select("anchor", "unit", "first", "body").repartitionByRange(shards, "anchor", "unit").sortWithinPartitions("anchor", "unit")
    hits = stage(dealt.mapInArrow(_refined(level.window), _HITS), "hits", free=True)
    # from here on no bytes: the stretches' places alone
    spread = stage(firsts.filter("first < last").select("anchor", "unit", "first"), "spread", free=True)
    discard(firsts)
    places = stage(units.drop("body"), "places")
    discard(units)
    parts = hits.where("h0 is not null")
    shared = parts.groupBy("h0", "h1").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most").drop("most")
    across = join_on(parts, shared, ["h0", "h1"]).filter("first > least")
    # what is covered of a stretch: all of it in larger documents (no x), runs of windows in its smallest one
    nothing = F.lit(None).cast("int")
    whole = spread.select("anchor", "unit", "first", nothing.alias("x"), nothing.alias("y"))
    names = ["anchor", "unit", "first", "x", "y"]
    fates = whole.unionByName(hits.where("h0 is null").select(names)).unionByName(across.select(names))
    found = join_on(places, fates, ["anchor", "unit"])
    found = found.filter("(x is null and key > first) or (x is not null and key = first)")
    start, end = F.col("start") + F.coalesce("x", F.lit(0)), F.col("start") + F.coalesce(F.col("y"), F.col("n") - 1) + level.window
    found = stage(found.select("key", "tie", start.alias("start"), end.alias("end")), "found", free=True)
    for used in (places, spread, hits):
        discard(used)
    return copies.union(found)


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes per row of ``docs`` (doc_id, text).

    Null text has no bytes. Rows that share a doc_id are one document and
    never remove each other's bytes; a null doc_id comes last. Extra columns
    are ignored; no rows give no rows.
    """
    rows, shards, buckets = identified(docs)
    spans = covered_bytes(rows, shards, buckets, bytes_level(window))

    def digest(ids: pa.Array, texts: pa.Array, spans: list[np.ndarray]) -> pa.RecordBatch:
        n, gone, sha, kept = [], [], [], []
        for text, cut in zip(texts, spans):
            body = (text.as_py() or "").encode()
            left, at = [], 0
            for a, b in cut.tolist():
                left.append(body[at:a])
                at = b
            left = b"".join([*left, body[at:]])
            n.append(len(body))
            gone.append(len(body) - len(left))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        cols = [ids, *(pa.array(c, pa.int64()) for c in (n, gone, [len(c) for c in spans])), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return digested(rows, spans, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
