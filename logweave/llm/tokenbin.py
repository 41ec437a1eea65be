"""Token ids as binary files: byte planes of fixed-size id blocks, each compressed alone.

A file holds whole documents in ascending ``doc_id`` order::

    magic
    blocks   ids in blocks of BLOCK_IDS; a block of n ids is four byte planes
             (all lowest bytes, then the next, ...), each one zstd frame
    docs     zstd frame of (doc_id int64, has_id uint8, n_tokens uint32) arrays
    index    per block and plane: offset uint64, size uint32
    footer   n_ids, n_docs, n_blocks, docs offset, index offset (uint64), magic

Any block is read by itself through the index. Files are the rows of a table
(``part``, ``seq``, ``n_ids``, ``data``): Spark's writer commits them, so a
lost executor leaves no half-written file, and any store Spark can write will
do. ``part`` and ``seq`` give the files' global order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import batches, join_on, stage

MAGIC = b"LWPLANE1"
BLOCK_IDS = 1 << 16
BATCH_BYTES = 1 << 19  # text encoded at once
FILE_IDS = 1 << 21  # a file is closed at the first document end beyond this
_FOOTER = struct.Struct("<QQQQQ8s")
_INDEX = np.dtype([("offset", "<u8"), ("size", "<u4")])


# ── the format ─────────────────────────────────────────────────────────────
def pack(ids: np.ndarray, doc_ids: list, counts: list[int]) -> bytes:
    """One file of the given ids; ``counts`` are the ids per document."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    out, at, index = [MAGIC], len(MAGIC), []
    ids = ids.astype("<u4", copy=False)
    for lo in range(0, len(ids), BLOCK_IDS):
        planes = ids[lo : lo + BLOCK_IDS].view(np.uint8).reshape(-1, 4).T
        for plane in planes:
            frame = z.compress(np.ascontiguousarray(plane).tobytes())
            index.append((at, len(frame)))
            out.append(frame)
            at += len(frame)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    docs = z.compress(keys.tobytes() + known.tobytes() + np.array(counts, "<u4").tobytes())
    table = np.array(index, _INDEX).tobytes()
    footer = _FOOTER.pack(len(ids), len(doc_ids), len(index) // 4, at, at + len(docs), MAGIC)
    return b"".join([*out, docs, table, footer])


def _footer(data: bytes):
    n_ids, n_docs, n_blocks, docs_at, index_at, magic = _FOOTER.unpack(data[-_FOOTER.size :])
    if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token plane file")
    return n_ids, n_docs, n_blocks, docs_at, index_at


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, found through the index."""
    import zstandard

    n_ids, _, n_blocks, _, index_at = _footer(data)
    index = np.frombuffer(data, _INDEX, n_blocks * 4, index_at)[4 * block : 4 * block + 4]
    n = min(BLOCK_IDS, n_ids - block * BLOCK_IDS)
    z = zstandard.ZstdDecompressor()
    planes = [np.frombuffer(z.decompress(data[int(o) : int(o) + int(s)], max_output_size=n), np.uint8) for o, s in index]
    return np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()


def read_docs(data: bytes) -> tuple[list, np.ndarray]:
    """doc_ids (None where null) and ids per document."""
    import zstandard

    _, n, _, docs_at, index_at = _footer(data)
    raw = zstandard.ZstdDecompressor().decompress(data[docs_at:index_at], max_output_size=13 * n + 1) if n else b""
    keys, known = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
    return [int(k) if ok else None for k, ok in zip(keys, known)], np.frombuffer(raw, "<u4", n, 9 * n)


# ── encoding ───────────────────────────────────────────────────────────────
class ChunkEncoder:
    """The tokenizer over whole texts, remembering the ids of pieces between white space.

    A byte-level tokenizer with a pattern pre-tokenizer cuts before a single
    space or line feed that stands between two characters that are no white
    space; a line feed there is a piece of its own. Between such cuts a text
    may be encoded in parts. Parts seen before (most words) are not encoded
    again; new ones go to the tokenizer together, one on a line. The memory
    is emptied at ``limit`` parts. Texts with other white space, texts holding
    an added token's string, and tokenizers of another kind are encoded whole.
    """

    MARKS = ",.;:!?|*#$%&"

    def __init__(self, path: str, limit: int = 3 << 19):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.splits = len(feed) == 1 and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.feed_id, self.feed = feed[0] if self.splits else 0, np.array(feed[:1], "<u4").tobytes()
        self.seen: dict[str, bytes] = {}  # parts behind a space, or with the line feed they follow
        self.tails: dict[str, bytes] = {}  # marks behind a word
        self.limit = limit

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _lines(self, parts: set[str], lead: str) -> list[tuple[str, bytes]]:
        """Ids of each part behind ``lead``, one part on a line of one text."""
        if not parts:
            return []
        parts = list(parts)
        ids = np.array(self.tok.encode_batch_fast([lead + f"\n{lead}".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        cut = 4 * np.flatnonzero(ids == self.feed_id)
        raw, at = ids.tobytes(), [0, *(cut + 4).tolist()]
        return list(zip(parts, (raw[a:b] for a, b in zip(at, [*cut.tolist(), len(raw)]))))

    def _learn(self, new: set[str]) -> set[str]:
        """Remember new parts; returns those that are empty or touch white space with their ends."""
        marked, cores, bad = [], [], set()
        for p in new:
            body = p[1:] if p[:1] == "\n" else p
            if not body or body[0].isspace() or p[-1].isspace():
                bad.add(p)
            elif p[-1].isalnum():
                cores.append(p)
            else:
                # a word and the marks behind it are cut apart by the pattern: most such parts hold known words
                core = p.rstrip(self.MARKS)
                if core and core[-1].isalnum():
                    marked.append((p, core, p[len(core) :]))
                    cores.append(core)
                else:
                    cores.append(p)
        if len(self.seen) > self.limit:
            self.seen.clear()
        seen = self.seen
        unseen = {c for c in cores if c not in seen}
        heads = {c for c in unseen if c[0] == "\n"}
        seen.update(self._lines(unseen - heads, " "))
        seen.update(("\n" + c, self.feed + ids) for c, ids in self._lines({c[1:] for c in heads}, ""))
        if len(self.tails) > self.limit:
            self.tails.clear()
        self.tails.update(self._lines({t for _, _, t in marked if t not in self.tails}, ""))
        for p, core, t in marked:
            seen[p] = seen[core] + self.tails[t]
        return bad

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        held, new, get = [], set(), self.seen.get
        for n, text in enumerate(texts):
            if not text:
                continue
            if not self.splits or any(a in text for a in self.added):
                out[n] = self._whole(text)
                continue
            parts = ("\n" + text).replace("\n", " \n")[1:].split(" ")  # as if the text followed a line feed
            ids = list(map(get, parts))
            gaps = [i for i, v in enumerate(ids) if v is None]
            new.update([parts[i] for i in gaps])
            held.append((n, parts, ids, gaps))
        bad = self._learn(new) if new else new
        seen, skip = self.seen, len(self.feed)
        for n, parts, ids, gaps in held:
            if bad and any(parts[i] in bad for i in gaps):
                out[n] = self._whole(texts[n])
                continue
            for i in gaps:
                ids[i] = seen[parts[i]]
            out[n] = b"".join(ids)[skip:]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_ENCODERS: dict[str, ChunkEncoder] = {}


def forget() -> None:
    _ENCODERS.clear()


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


FILES = "part int, seq int, n_ids long, data binary"


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """The file table over ``docs`` (doc_id, text) in ascending doc_id order, written to the shared folder.

    Null text is empty; null doc_ids come first; rows of one doc_id stand in
    the order of a hash of their text, equal rows in any order.
    ``tokenizer_path`` must exist on every executor.
    """
    end = np.array([end_id], "<u4").tobytes()

    def to_files(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc, blobs, keys, counts, held = encoder(tokenizer_path), [], [], [], 0

        def file() -> pa.RecordBatch:
            data = pack(np.frombuffer(b"".join(blobs), "<u4"), keys, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())],
                ["part", "seq", "n_ids", "data"],
            )

        for batch in batches(rows, "text", BATCH_BYTES):
            encoded = enc.encode_many([t or "" for t in batch.column("text").to_pylist()])
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                blobs.append(ids + end)
                keys.append(key)
                counts.append(len(blobs[-1]) // 4)
                held += counts[-1]
                if held >= FILE_IDS:
                    yield file()
                    blobs, keys, counts, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield file()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stage(rows.mapInArrow(to_files, FILES), "tokens")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a file table, from the files' bytes."""

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the files stand: a worker need not hold what it remembered for writing them
        for batch in rows:
            for part, seq, data in zip(*(batch.column(c) for c in ("part", "seq", "data"))):
                raw = data.as_py()
                blocks = [read_block(raw, b) for b in range(_footer(raw)[2])]
                ids = memoryview(np.concatenate(blocks) if blocks else np.zeros(0, "<u4")).cast("B")
                keys, counts = read_docs(raw)
                ends = np.cumsum(counts, dtype=np.int64)
                crcs = [zlib.crc32(ids[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(keys, pa.int64()),
                     pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    found = files.select("part", "seq", "data").mapInArrow(decode, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # ids before a file: whole parts before its part, then files before it in the part
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    base = join_on(sizes.select("part", "seq", inside.alias("inside")), parts, ["part"])
    base = base.select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))
    out = join_on(found, base, ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files, read them back: one row per row of ``docs``.

    Handles null and empty text (the end id alone), null and repeated doc_ids,
    repeated rows, extra columns (ignored) and no rows (no files, no rows).
    """
    return read_files(write_files(docs, tokenizer_path, end_id))
