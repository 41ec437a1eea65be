"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Signatures use two permutations of a ring of 2**32 places: the first sends a
shingle (its 64-bit hash) to a place, the second ranks places; coordinate
``j`` of a signature is the smallest rank over a text's places after a
circular shift by ``j`` steps. ``BANDS`` bands of ``ROWS`` coordinates make
the bucket keys: two texts of similarity 0.8 meet in no bucket with
probability (1 - 0.8**4)**32 = 5e-8.

Texts with equal shingle sets are one class from the start (a 128-bit digest
of the full set), so copies are never expanded into pairs. Between classes, a
few rounds link each class with one hub of its buckets; only then the classes
that share a bucket but stand in different components are compared with each
other. Every link is confirmed on the full sets.

Three tests spare pairs that cannot reach the threshold, inside the joins, so
that no row is made for them: the sizes; a parity map (each shingle flips one
of PARITY_BITS bits: two maps never differ in more bits than the sets in
shingles); and two bits of each coordinate (a pair at the threshold differs in
more than SKETCH_MOST of 128 coordinates with probability below 1e-8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, join_on, joined, lower_ascii, mix64, span_hashes, stage, word_spans

BANDS, ROWS = 32, 4
COORDS = BANDS * ROWS
SKETCH_MOST = 46
PARITY_BITS = 1024
_SPARING = [*(f"s{i}" for i in range(4)), *(f"p{i}" for i in range(PARITY_BITS // 64))]
STAR_ROUNDS = 2
_STEP = 0x9E3779B1  # one step of the circular shift; odd, so all shifts differ
_JOIN = np.uint64(0xD6E8FEB86659FD93)
_PAIR_BITS = 0x5555555555555555


# ── shingles and signatures ────────────────────────────────────────────────
def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text then hash, and the n+1 offsets.

    Words are lower-cased (A-Z) and split at ASCII white space; a text with
    fewer than ``k`` words has its whole sequence as the one shingle.
    """
    data, ends = joined(column)
    n = len(column)
    starts, stops = word_spans(data)
    words = span_hashes(lower_ascii(data), starts, stops)
    doc = np.searchsorted(ends, starts, "right") - 1
    count = np.bincount(doc, minlength=n)
    h = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        h = h * _JOIN + words[i : i + len(h)]
    own = doc[: len(h)] == doc[k - 1 : k - 1 + len(h)] if len(h) else np.zeros(0, bool)
    h, owner = mix64(h[own]), doc[: len(own)][own]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        whole = [np.uint64(0)] * len(short)
        with np.errstate(over="ignore"):
            for j, d in enumerate(short):
                v = np.uint64(count[d])  # the length keeps it apart from full shingles
                for w in words[first[d] : first[d + 1]]:
                    v = v * _JOIN + w
                whole[j] = v
        h, owner = np.concatenate([h, mix64(np.array(whole, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint32 of shape (COORDS, texts): the circulant signature of each non-empty set."""
    place = (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)  # first permutation
    out = np.empty((COORDS, len(offsets) - 1), np.uint32)
    x, t = np.empty_like(place), np.empty_like(place)
    for j in range(COORDS):
        np.add(place, np.uint32((j * _STEP) & 0xFFFFFFFF), out=x)  # shifted round the ring
        np.multiply(x, np.uint32(0x85EBCA6B), out=x)  # second permutation: multiply, fold, multiply
        np.right_shift(x, np.uint32(15), out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, np.uint32(0xC2B2AE35), out=x)
        np.right_shift(x, np.uint32(13), out=t)
        np.bitwise_xor(x, t, out=x)
        np.minimum.reduceat(x, offsets[:-1], out=out[j])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    wide = sig.astype(np.uint64).reshape(BANDS, ROWS, -1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.ones((1, sig.shape[1]), np.uint64)
    for r in range(ROWS):
        key = mix64(key * _JOIN + wide[:, r])
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, packed into four words."""
    two = (sig & np.uint32(3)).astype(np.uint64).reshape(4, COORDS // 4, -1)
    shift = (2 * np.arange(COORDS // 4, dtype=np.uint64))[None, :, None]
    return (two << shift).sum(axis=1, dtype=np.uint64).view(np.int64)


def parities(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """int64 of shape (PARITY_BITS / 64, texts): bit b is set if an odd number of shingles fall on b."""
    n = len(offsets) - 1
    bit = (h >> np.uint64(20)).astype(np.int64) & (PARITY_BITS - 1)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * PARITY_BITS + bit, minlength=n * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, PARITY_BITS), axis=1).view(np.int64).T


_SIGNED = "doc_id long, n_shingles long, lo long, hi long, bands array<long>, " + ", ".join(f"{c} long" for c in _SPARING)


def _sign(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            h, offs = shingles(batch.column("text"), k)
            size, n = np.diff(offs), batch.num_rows
            some = np.flatnonzero(size)
            cols = {c: np.zeros(n, np.int64) for c in ("lo", "hi", *_SPARING)}
            bands = np.zeros((0, BANDS), np.int64)
            if len(some):
                inner = np.concatenate([offs[some], [len(h)]])
                sig = signatures(h, inner)
                bands = np.ascontiguousarray(band_keys(sig).T)
                for c, v in zip(_SPARING, [*sketches(sig), *parities(h, inner)]):
                    cols[c][some] = v
                cols["lo"][some] = np.add.reduceat(mix64(h ^ _JOIN), inner[:-1]).view(np.int64)
                cols["hi"][some] = np.add.reduceat(mix64(h + np.uint64(0x632BE59BD9B4E019)), inner[:-1]).view(np.int64)
            ends = np.cumsum(np.where(size > 0, BANDS, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(cols["lo"]), pa.array(cols["hi"]), lists, *(pa.array(cols[c]) for c in _SPARING)],
                ["doc_id", "n_shingles", "lo", "hi", "bands", *_SPARING],
            )

    return run


def _sets(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            h, offs = shingles(batch.column("text"), k)
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["node", "set"])

    return run


# ── links ──────────────────────────────────────────────────────────────────
def _possible(percent: int) -> Column:
    """Sizes, parity maps and sketches leave the threshold open (columns n, s*, p* and n_, s*_, p*_)."""
    least, most, total = F.least("n", "n_"), F.greatest("n", "n_"), F.col("n") + F.col("n_")
    apart = [F.col(c).bitwiseXOR(F.col(f"{c}_")) for c in _SPARING]
    coords = sum(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_PAIR_BITS))) for x in apart[:4])
    flips = sum(F.bit_count(x) for x in apart[4:])
    # |x| + |y| - 2 |x and y| is at least the flips and at most this at the threshold
    return (100 * least >= percent * most) & ((100 + percent) * flips <= (100 - percent) * total) & (coords <= SKETCH_MOST)


def _other(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_") for c in df.columns])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of ``edges`` (a, b).

    Smallest neighbour labels and pointer jumping in turns, each turn written
    to the shared folder, until nothing changes. A hub only meets the join
    (which can be split) and a combining minimum.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    changed = not label.isEmpty()
    while changed:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = label.select("node", "comp").join(near, "node").select("node", "comp", F.least("comp", "m").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        nxt = stage(step.join(jump, "new", "left").select("node", F.col("comp").alias("was"), F.least("new", "far").alias("comp")), "labels")
        changed = not nxt.filter("comp != was").isEmpty()
        discard(label)
        label = nxt
    discard(both)
    return label


def linked(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, comp) after further links: only the links between components are contracted."""
    comp = lambda c: label.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    ends = links.join(comp("a"), "a", "left").join(comp("b"), "b", "left")
    ends = ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a != b")
    merged = components(ends)
    moved = merged.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = label.select("node", "comp").join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = merged.select("node", "comp").join(label.select("node"), "node", "left_anti")
    out = stage(old.unionByName(new), "labels")
    discard(merged)
    discard(label)
    return out


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, set): the shingle sets of the named documents, cut from their texts."""
    rows = docs.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    return stage(rows.mapInArrow(_sets(k), "node long, set array<long>"), "sets", free=True)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets reach the threshold.

    A pair travels with one set at a time; joins on a hub can be split by Spark.
    """
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    met = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    good = met.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both")))
    return stage(good.select("a", "b").distinct(), "links", free=True)


def _hub_pairs(member: DataFrame, about: DataFrame, spent: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """One hopeful pair (a, b) per class, and the hubs: the bucket hub it shares most buckets with.

    A bucket's hub is its member of highest ``degree`` (how many buckets it
    shares with how many classes): the text a family of copies was made from
    shares more with each copy than copies do with each other. Hubs of earlier
    rounds are ``spent``.
    """
    hubs = member.join(spent, "node", "left_anti").groupBy("key").agg(F.max(F.struct("degree", "node", "comp")).alias("h"))
    met = member.join(hubs, "key").filter(F.col("comp") != F.col("h.comp"))
    met = met.groupBy(F.col("h.node").alias("hub"), "node").agg(F.count("*").alias("shared"))
    met = met.join(about, "node").join(_other(about), F.col("hub") == F.col("node_")).filter(_possible(percent))
    best = met.groupBy("node").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    pairs = stage(best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    return pairs, hubs.select("h.node").distinct()


def _mixed(member: DataFrame) -> DataFrame:
    """The rows of buckets whose members stand in more than one component."""
    keys = member.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("key")
    return member.join(keys, "key", "left_semi")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs`` (doc_id, text).

    Documents are linked if ``100 * intersection >= percent * union`` of their
    word ``k``-shingle sets; a component is named by its smallest doc_id,
    whose rows are kept. Null or wordless text has no shingles and is linked
    with nothing. Rows that share a doc_id are one document. A null doc_id
    cannot be named: its component is null and the row is kept. Extra columns
    are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = stage(docs.mapInArrow(_sign(k), _SIGNED), "signed")
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    sketch = F.struct("bands", *_SPARING)
    classes = stage(named.groupBy("lo", "hi", "n_shingles").agg(F.min("doc_id").alias("node"), F.first(sketch).alias("k")), "classes")
    about = classes.select("node", F.col("n_shingles").alias("n"), *[f"k.{c}" for c in _SPARING])
    banded = classes.select("node", F.explode("k.bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x != y").select("key")
    member = stage(banded.join(shared, "key", "left_semi"), "buckets")

    owner = join_on(named.select("doc_id", "lo", "hi", "n_shingles"), classes.select("lo", "hi", "n_shingles", "node"), ["lo", "hi", "n_shingles"]).select("doc_id", "node").distinct()
    first = owner.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").select("doc_id", "a")
    links = stage(owner.join(first, "doc_id").filter("a != node").select("a", F.col("node").alias("b")).distinct(), "links")

    label = components(links)
    discard(links)
    current = lambda m: m.select("key", "node", "degree").join(label.select("node", "comp"), "node", "left").select("key", "node", "degree", F.coalesce("comp", "node").alias("comp"))
    sizes = member.groupBy("key").agg(F.count("*").alias("c"))
    degree = member.join(sizes, "key").groupBy("node").agg(F.sum("c").alias("degree"))
    buckets, member = member, stage(member.join(degree, "node"), "buckets", free=True)
    discard(buckets)
    spent = spark.createDataFrame([], "node long")
    for _ in range(STAR_ROUNDS):
        buckets, member = member, stage(_mixed(current(member)), "buckets", free=True)
        discard(buckets)
        if member.isEmpty():
            break
        pairs, hubs = _hub_pairs(member, about, spent, percent)
        hubs = stage(hubs, "hubs")
        spent = spent.union(hubs)
        sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), k)
        links = confirm(pairs, sets, percent)
        label = linked(label, links)
        for used in (sets, pairs, links):
            discard(used)
    # what hubs left open: classes of one bucket in different components, compared with each other;
    # of each pair at least one side stands outside the component of the bucket's hub
    rest = _mixed(current(member))
    main = rest.groupBy("key").agg(F.max(F.struct("degree", "node", "comp")).alias("h")).select("key", F.col("h.comp").alias("main"))
    rest = stage(rest.join(main, "key").join(about, "node").drop("degree"), "rest", free=True)
    outside, all_ = rest.filter("comp != main").drop("main"), _other(rest)
    once = (F.col("comp_") == F.col("main_")) | (F.col("node") < F.col("node_"))
    pairs = outside.join(all_, (F.col("key") == F.col("key_")) & (F.col("comp") != F.col("comp_")) & once & _possible(percent))
    pairs = stage(pairs.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct(), "pairs", free=True)
    sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), k)
    links = confirm(pairs, sets, percent)
    label = linked(label, links)
    for used in (sets, pairs, links, rest, member):
        discard(used)

    comp = classes.select("lo", "hi", "n_shingles", "node").join(label.select("node", "comp"), "node", "left").select("lo", "hi", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    out = join_on(signed.select("doc_id", "n_shingles", "lo", "hi"), comp, ["lo", "hi", "n_shingles"], "left")
    empty = F.col("n_shingles") == 0
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).when(empty, F.col("doc_id")).otherwise(F.col("comp")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose document names its component; all their columns."""
    gone = near_duplicates(docs, **how).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
