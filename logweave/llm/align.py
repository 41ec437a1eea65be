"""Cross-tokenizer alignment: groups of tokens that cover the same bytes, found by pointer jumping.

Two tokenizers cut the same bytes: A is a byte-level BPE over space + text, B
a sentencepiece model that adds the space itself. Tokens overlap where their
byte ranges do; the components of that overlap are the groups.

Pointer jumping: every token points to the overlapping token that ends
farthest right (to itself if none ends farther; where an A and a B token end
together, both to the B token). Doubling the pointers (``p = p[p]`` on whole
arrays) until nothing changes leads every token to the terminal token of its
component, which labels the group.

Both tokenizers cut before a space that follows a character that is no white
space, and before a line feed between two such characters, so a text is the sequence of such parts. The alignment of a part is
computed once per worker and part (most are words) and remembered; new parts
are tokenized and aligned together in one batch of arrays; where A's ids are in
the order of its merges, its vocabulary runs in tiktoken (same ids, faster). At
``MEMORY`` parts or ``MEMORY_BYTES`` all but the parts of the batch at hand are forgotten. ``B`` is read in parts only if no piece joins a
character to a space behind it, else texts are encoded whole.

Counts over all documents: texts are read once; per block (about 4 MB of
text, stamped when the rows are written) the links go to a staged table with
their digests. Each block sends its distinct id pairs with their numbers;
they are summed over all blocks, compared with the best of their B id, joined
back to the blocks that hold them, and cogrouped with the blocks' links. No
row per link is shuffled, no table of pairs is broadcast, and a pair that is
in every block costs one row per block.

Defined cases: texts that are null or empty, or whose joined A or B bytes
differ from space + text, have no tokens (zeros, empty arrays, empty digest).
Documents are rows: repeated rows and ids (null ids too) are each reported.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, shards_for, stage

MEMORY = 1 << 18  # parts a worker remembers
MEMORY_BYTES = 64 << 20  # and the bytes of their written groups
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20  # text aligned at once: bounds what a worker holds beside its memory
TASK_BYTES = 32 << 20  # links scored by a task
SPACE_MARK = "▁"
_CUT = re.compile(r"(?<=\S)(?= [\s\S])")  # a lone last space stays with its word
_CUT_LINES = re.compile(r"(?<=\S)(?= [\s\S]|\n\S)")
# fixed value: how byte-level pre-tokenizers cut a text
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = "\u0250"  # below it, every Unicode version knows the same letters and numbers


# ── pointer jumping ────────────────────────────────────────────────────────
def components(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A and each B token of two cuts of the same bytes (ascending end offsets, equal last)."""
    n_a, n_b = len(end_a), len(end_b)
    if not n_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the other side's token over the own last byte is the overlapping one that ends farthest right
    over_a = np.searchsorted(end_b, end_a, "left")  # B token of each A token
    over_b = np.searchsorted(end_a, end_b, "left")  # A token of each B token
    # nodes: A tokens, then B tokens; equal ends point to the B token
    to_a = n_a + over_a
    to_b = np.where(end_a[over_b] > end_b, over_b, n_a + np.arange(n_b))
    pointer = np.concatenate([to_a, to_b])
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            break
        pointer = farther
    terminal = pointer == np.arange(n_a + n_b)  # all on the B side, in text order
    label = (np.cumsum(terminal) - 1)[pointer]
    return label[:n_a], label[n_a:]


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B token of every overlapping pair, in text order.

    Two tokens of two cuts share at most one stretch, so the pairs are the
    stretches between neighbouring ends of either cut.
    """
    either = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 0, bool)
    either[end_a] = either[end_b] = True
    ends = np.flatnonzero(either)
    return np.searchsorted(end_a, ends, "left"), np.searchsorted(end_b, ends, "left")


# ── the two tokenizers ─────────────────────────────────────────────────────
def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _by_ranks(path: str, letters: dict[str, int]):
    """The same vocabulary in tiktoken, several times faster, or None where its merges are not in the order of their ids.

    A byte-level BPE merges the pair of lowest rank first; if the n-th merge
    makes the n-th id after the bytes, ids are ranks and both libraries agree.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    if not usual or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    added = {a["content"] for a in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=len(ranks))


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and where each list ends."""
    at = np.cumsum([len(x) for x in ids])
    return np.fromiter(chain.from_iterable(ids), np.int64, int(at[-1])), at


class Pair:
    """Both tokenizers, with the bytes each id stands for and the alignments of parts seen."""

    def __init__(self, path_a: str, path_b: str, memory: int = MEMORY):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self.quick = _by_ranks(path_a, letters)
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(letters[c] for c in names[i]) if i in names and all(c in letters for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.len_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.in_parts = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        feed = self.a.encode("x\n x", add_special_tokens=False).ids
        self.feed = feed[1] if len(feed) == 3 and self.bytes_a[feed[1]] == b"\n" else None
        # a line feed between two words is cut before as well, if it joins no piece of B and is a token of A
        space = self.b.encode("\nx")[:1]
        lines = self.feed is not None and space and self.bytes_b[space[0]] == b" " and not any("\n" in p for p in pieces)
        self.cut = _CUT_LINES if lines else _CUT
        # every id written with each sign that can follow it
        self.words = [b"%d%s" % (i, sign) for sign in (b",", b"|", b",", b";") for i in range(1 << 16)]
        self.word_sizes = np.array([len(w) for w in self.words], np.int64)
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, tuple | None] = {}
        self.held = 0

    def keep(self, parts: set[str]) -> None:
        """Forget all but the parts at hand: common words stay."""
        kept = {p: self.seen[p] for p in parts if p in self.seen}
        self.forget()
        self.seen, self.held = kept, sum(len(v[5]) for v in kept.values() if v)

    def split(self, text: str) -> list[str]:
        """space + text in parts that both tokenizers treat alone; each begins with a space or a line feed."""
        return self.cut.split(" " + text) if self.in_parts else [" " + text]

    def learn(self, parts: list[str]) -> None:
        """Tokenize and align new parts, all in one batch of arrays; None marks parts whose bytes differ."""
        ids_a = self._encode_a(parts)
        # B adds a space: the parts' own, or one too many before a line feed
        ids_b = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        ids_b = [y if p[0] == " " else y[1:] for p, y in zip(parts, ids_b)]
        raw = [p.encode() for p in parts]
        flat_a, at_a = _flat(ids_a)
        flat_b, at_b = _flat(ids_b)
        if not (self._cover(flat_a, at_a, self.bytes_a, self.len_a, raw) and self._cover(flat_b, at_b, self.bytes_b, self.len_b, raw)):
            joined = zip(raw, ([self.bytes_a[i] for i in x] for x in ids_a), ([self.bytes_b[i] for i in y] for y in ids_b))
            ok = [b"".join(x) == t == b"".join(y) for t, x, y in joined]
            self.seen.update((p, None) for p, good in zip(parts, ok) if not good)
            parts, ids_a, ids_b = (list(compress(x, ok)) for x in (parts, ids_a, ids_b))
            if not parts:
                return
            flat_a, at_a = _flat(ids_a)
            flat_b, at_b = _flat(ids_b)
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        group_a, group_b = components(end_a, end_b)
        link_a, link_b = overlaps(end_a, end_b)
        codes = (flat_a[link_a] << 16 | flat_b[link_b]).astype("<u4")
        links_to = np.searchsorted(link_a, at_a, "left")
        groups_to = group_a[at_a - 1] + 1
        text, text_to = self._written(flat_a, flat_b, group_a, group_b)
        number = zip(*(np.diff(x, prepend=0).tolist() for x in (at_a, at_b, groups_to, links_to)))
        packed, l0, t0 = codes.tobytes(), 0, 0
        for part, counts, l1, t1 in zip(parts, number, (4 * links_to).tolist(), text_to[groups_to - 1].tolist()):
            self.seen[part] = (*counts, packed[l0:l1], text[t0 : t1 - 1])
            l0, t0 = l1, t1
        self.held += len(text)

    def _encode_a(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part. Parts whose only white space leads them are encoded in one text: the pattern cuts around line feeds."""
        out: list[list[int]] = [[]] * len(parts)
        joint: dict[tuple[str, bool], list[int]] = {}
        others = []
        for i, p in enumerate(parts):
            words = p.split(None, 1)
            if self.feed is not None and len(words) == 1 and len(words[0]) == len(p) - 1:
                joint.setdefault((p[0], p.isascii() or max(p) < _LATIN), []).append(i)
            else:
                others.append(i)
        for (lead, latin), some in joint.items():
            text = ("\n" if lead == " " else "").join([parts[i] for i in some])
            if latin and self.quick:
                ids = self.quick.encode_ordinary(text)
            else:
                ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
            at = np.flatnonzero(np.array(ids) == self.feed).tolist()
            from_, to = ([0, *(c + 1 for c in at)], [*at, len(ids)]) if lead == " " else (at, [*at[1:], len(ids)])
            for i, lo, hi in zip(some, from_, to, strict=True):
                out[i] = ids[lo:hi]
        for i, e in zip(others, self.a.encode_batch_fast([parts[i] for i in others], add_special_tokens=False)):
            out[i] = e.ids
        return out

    @staticmethod
    def _cover(flat: np.ndarray, at: np.ndarray, token: list[bytes], size: np.ndarray, raw: list[bytes]) -> bool:
        """Whether the joined tokens of every part are the part's bytes."""
        sizes = np.diff(np.append(0, np.cumsum(size[flat]))[np.append(0, at)])
        return np.array_equal(sizes, [len(r) for r in raw]) and b"".join(map(token.__getitem__, flat.tolist())) == b"".join(raw)

    def _written(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as ``a1,a2|b1;`` in one, and where each ends."""
        n_a, n_b, n = len(ids_a), len(ids_b), int(group_a[-1]) + 1
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        before_a = np.searchsorted(group_b, group_a, "left")  # B tokens of earlier groups
        before_b = np.searchsorted(group_a, group_b, "right")  # A tokens up to the own group
        code = np.empty(n_a + n_b, np.int64)
        code[np.arange(n_a) + before_a] = ids_a + np.where(last_a, 1 << 16, 0)
        code[np.arange(n_b) + before_b] = ids_b + np.where(last_b, 3 << 16, 2 << 16)
        ends = np.cumsum(self.word_sizes[code])
        return b"".join(map(self.words.__getitem__, code.tolist())), ends[code >= 3 << 16][:n]

    def align(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """The aligned parts of each text; None for texts without tokens."""
        split = [self.split(t) if t else None for t in texts]
        if len(self.seen) > self.memory or self.held > MEMORY_BYTES:
            self.keep({p for parts in split if parts for p in parts})
        new = {p for parts in split if parts for p in parts if p not in self.seen}
        if new:
            self.learn(list(new))
        out: list[list[tuple] | None] = []
        for parts in split:
            got = list(map(self.seen.__getitem__, parts)) if parts else None
            out.append(None if got is None or None in got else got)
        return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


# ── Spark ──────────────────────────────────────────────────────────────────
def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_ids, b_ids (token ids), a_group, b_group (group number of each token, from 0)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for batch in batches(rows, "text", SLICE_BYTES):
            lists: list[list[list[int]]] = [[], [], [], []]
            for parts in pair.align(batch.column("text").to_pylist()):
                groups = b";".join([p[5] for p in parts or []]).decode()
                sides = [[side.split(",") for side in g.split("|")] for g in groups.split(";") if g]
                for k in (0, 1):
                    lists[k].append([int(i) for g in sides for i in g[k]])
                    lists[2 + k].append([n for n, g in enumerate(sides) for _ in g[k]])
            columns = [pa.array(v, pa.list_(pa.int32())) for v in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "a_ids", "b_ids", "a_group", "b_group"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its block, numbers of tokens, groups and links, the digest, and the links' id pairs packed."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for batch in batches(rows, "text", BLOCK_BYTES):
            numbers, sums, links = [], [], []
            texts = (part.column("text").to_pylist() for part in batches(iter([batch]), "text", SLICE_BYTES))
            for parts in chain.from_iterable(map(pair.align, texts)):
                if parts is None:
                    numbers.append((0, 0, 0, 0))
                    sums.append("")
                    links.append(b"")
                    continue
                a, b, g, n, codes, written = zip(*parts)
                numbers.append((sum(a), sum(b), sum(g), sum(n)))
                sums.append(hashlib.sha256(b";".join(written)).hexdigest())
                links.append(b"".join(codes))
            block = int.from_bytes(os.urandom(8), "little") >> 1  # two blocks of one number would only be read together
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([block] * batch.num_rows, pa.int64()), *columns, pa.array(sums, pa.string()), pa.array(links, pa.binary())],
                ["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _block_pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct id pairs of the links of each block in a batch, with their numbers."""
    for batch in rows:
        blocks = batch.column("block").to_numpy()
        packed = batch.column("links").to_pylist()
        for block in np.unique(blocks).tolist():
            held = b"".join([packed[i] for i in np.flatnonzero(blocks == block)])
            pair, n = np.unique(np.frombuffer(held, "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pair), block)), pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))],
                ["block", "pair", "n"],
            )


def _score(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """n_best and count_sum of the documents of a block, from the corpus-wide counts of its id pairs."""
    pair = counts.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, count = pair[order], counts.column("count").to_numpy()[order]
    best = counts.column("best").to_numpy(zero_copy_only=False)[order]
    n_best, total = [], []
    for packed in docs.column("links").to_pylist():
        at = np.searchsorted(pair, np.frombuffer(packed, "<u4"))
        n_best.append(int(best[at].sum()))
        total.append(int(count[at].sum()))
    docs = docs.drop_columns(["links", "block"])
    return docs.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens, groups, links, links that are their B id's best, the sum of the links' counts, the digest."""
    held = stage(_digests(docs, path_a, path_b), "links", free=True)
    sent = held.select("block", "links").where("length(links) > 0").mapInArrow(_block_pairs, "block long, pair long, n long")
    need = stage(sent.groupBy("block", "pair").agg(F.sum("n").alias("n")), "pairs", free=True)
    counts = need.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFF))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    known = counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    looked = need.select("block", "pair").join(known, "pair")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    # as many tasks as the links' bytes ask for, so that a task's input does not grow with the corpus
    size = held.agg(F.sum(F.length("links"))).first()[0] or 0
    tasks = shards_for(size, TASK_BYTES)
    blocks = held.repartition(tasks, "block").groupBy("block")
    return blocks.cogroup(looked.repartition(tasks, "block").groupBy("block")).applyInArrow(_score, schema)
