"""Spelling variant grouping: words one edit apart, found by products of letter-count blocks.

Words are the letter runs of all texts with one code point deleted from some
(by a checksum of document and run), of at least ``min_length`` code points
and ``min_count`` occurrences.

*Blocked Gram matrices.* A word is the vector of its letter counts. Words one
edit apart have vectors at squared distance 1 (an inserted or deleted letter)
or 2 (a replaced one). Vectors of one length are dealt into cells by the
numbers of letters of a few letter groups (balanced by the letters' measured
frequency). One edit moves a word at most to a neighbour cell: the same cell,
one more letter in one group (the next length), or one letter moved between two groups. Cells
are cut into blocks of about ``BLOCK_LETTERS`` letters; every pair of blocks
of neighbour cells is a row, and a task multiplies its two count matrices:
``|a|^2 + |b|^2 - 2ab`` is the squared distance of all pairs at once. Pairs
at most two apart are verified letter by letter, whole arrays at a time.

The groups are one more for each fourfold vocabulary, so that cells do not
grow with it. No pair of words is a row: a block pair gives each word's number
of near words and its best one, which Spark combines.

*Roots.* A form has at least ``ratio`` times its word's occurrences, so a
chain has fewer than 19 forms; five rounds of doubling (root := root's root)
reach its end, by equi-joins of the words that have a form.

Scale: texts are read once and never shuffled; word counts combine before the
shuffle, so a word with a third of all occurrences is one row per task. All
later steps work on the vocabulary. Everything but the products is DataFrame
functions.

Defined cases: null and empty texts have no runs; a null doc_id is written as
an empty id in the checksum; repeated rows and ids count as often as they
occur; words of any length are handled (a block holds at least one word); an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage
from .linkgraph import ascii_lower

LETTERS = r"a-zÀ-ÿ"
BLOCK_LETTERS = 8192
VERIFY = 1 << 16  # pairs verified at once, for words of up to 16 letters
ROUNDS = 5  # 2 ** 5 forms; occurrences below 2 ** 63 allow 19


# ── words ──────────────────────────────────────────────────────────────────
def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, deleted_of: int = 31) -> DataFrame:
    """(word, n): the words and their occurrences in all texts."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.col("h") % F.length("run")
    shorter = F.concat(F.expr("substr(run, 1, cast(h % length(run) as int))"), F.expr("substr(run, cast(h % length(run) as int) + 2)"))
    word = F.when((F.col("h") % deleted_of == 0) & (at >= 0), shorter).otherwise(F.col("run"))
    counted = words.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


# ── cells and blocks ───────────────────────────────────────────────────────
def letter_groups(vocab: DataFrame, n_words: int) -> list[str]:
    """Letters dealt into groups of about equal frequency; one group more for each fourfold vocabulary."""
    n_groups = 5 + max(0, math.ceil((math.log2(max(n_words, 1)) - 18.5) / 2))
    seen = vocab.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    seen = seen.where(F.col("letter") != "").collect()  # at most the 90 letters of the pattern
    groups, load = [""] * n_groups, [0] * n_groups
    for row in sorted(seen, key=lambda r: (-r["count"], r["letter"])):
        least = load.index(min(load))
        groups[least] += row["letter"]
        load[least] += row["count"]
    return groups


def blocks(vocab: DataFrame, groups: list[str]) -> DataFrame:
    """(cell, part, words, ns): the vocabulary in blocks; a cell is the numbers of letters per group."""
    numbers = [F.length("word") - F.length(F.translate("word", g, "")) for g in groups]
    placed = vocab.withColumn("cell", F.array(*[n.cast("int") for n in numbers]))
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum(F.length("word")) / BLOCK_LETTERS).cast("int").alias("parts"))
    placed = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    held = placed.groupBy("cell", "part").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    return held.select("cell", "part", F.array_join("held.word", " ").alias("words"), F.col("held.n").alias("ns"))


def block_pairs(blocks_: DataFrame, n_groups: int) -> DataFrame:
    """Every pair of blocks of neighbour cells once: same cell, one letter more, one letter moved to an earlier group."""
    moves = [[0] * n_groups]
    for i in range(n_groups):
        moves.append([int(g == i) for g in range(n_groups)])
        moves += [[(g == i) - (g == j) for g in range(n_groups)] for j in range(i + 1, n_groups)]
    cells = F.array(*[F.array(*[F.col("cell")[g] + F.lit(m[g]) for g in range(n_groups)]) for m in moves])
    left = blocks_.select(
        F.col("cell").alias("from_cell"), F.col("part").alias("from_part"), F.col("words").alias("words_a"),
        F.col("ns").alias("ns_a"), F.explode(cells).alias("cell"),
    )
    right = blocks_.select("cell", "part", F.col("words").alias("words_b"), F.col("ns").alias("ns_b"))
    once = (F.col("cell") != F.col("from_cell")) | (F.col("from_part") <= F.col("part"))
    same = (F.col("cell") == F.col("from_cell")) & (F.col("from_part") == F.col("part"))
    return left.join(right, "cell").where(once).select("words_a", "ns_a", "words_b", "ns_b", same.alias("same"))


# ── the products ───────────────────────────────────────────────────────────
def _codes(words: str) -> tuple[np.ndarray, np.ndarray]:
    """Blank-separated words of one length as a matrix of small numbers per letter, and the matrix of their letter counts."""
    points = np.frombuffer(words.encode("utf-32-le"), "<u4")
    letters = np.where(points < 128, points - 96, points - 0xC0 + 27).astype(np.uint8)
    length = int(np.argmax(points == 32)) if (points == 32).any() else len(points)
    rows = np.append(letters, np.uint8(0)).reshape(-1, length + 1)[:, :length]
    counts = np.zeros((len(rows), 91), np.float32 if length < 2000 else np.float64)
    np.add.at(counts, (np.repeat(np.arange(len(rows)), length), rows.ravel()), 1)
    return rows, counts


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of equal number differ by exactly one replaced letter, or by one letter more in ``b``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    differs = a != b[:, :-1]
    first = np.where(differs.any(1), differs.argmax(1), a.shape[1])
    moved = a == b[:, 1:]
    return (moved | (np.arange(a.shape[1]) < first[:, None])).all(1)


def near_pairs(left: tuple, right: tuple, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words of two blocks (codes, counts); of one block each pair once."""
    (a, x), (b, y) = left, right
    used = np.flatnonzero(x.any(0) | y.any(0))
    x, y = x[:, used], y[:, used]
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    near = (squared > 0.5) & (squared < 2.5)
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return i, j
    step = max(1, VERIFY * 16 // a.shape[1])
    ok = np.concatenate([_one_edit(a[i[s : s + step]], b[j[s : s + step]]) for s in range(0, len(i), step)])
    return i[ok], j[ok]


def _best(words: np.ndarray, at: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (at, other): per ``at`` the number of others, and the other of largest n (then the smallest word)."""
    order = np.lexsort((other, -n[other], at))
    at, other = at[order], other[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], np.diff(np.append(first, len(at))), other[first], n[other[first]]


def _near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = lru_cache(64)(_codes)  # a block meets many others in a row
    for batch in rows:
        out: list[list] = [[], [], [], []]
        words_a, words_b, same = batch.column("words_a"), batch.column("words_b"), batch.column("same")
        for r in range(batch.num_rows):
            texts = words_a[r].as_py(), words_b[r].as_py()
            sides = codes(texts[0]), codes(texts[1])
            i, j = near_pairs(*sides, same[r].as_py())
            if not len(i):
                continue
            # both blocks' words in code-point order: numbers then compare as words do
            both = texts[0].split(" ") + texts[1].split(" ")
            n = np.concatenate([batch.column("ns_a")[r].values.to_numpy(), batch.column("ns_b")[r].values.to_numpy()])
            order = sorted(range(len(both)), key=both.__getitem__)
            place = np.empty(len(both), np.int64)
            place[order] = np.arange(len(both))
            sorted_words, sorted_n = [both[k] for k in order], n[order]
            p, q = place[i], place[j + len(texts[0].split(" "))]
            at, number, other, most = _best(sorted_words, np.concatenate([p, q]), np.concatenate([q, p]), sorted_n)
            out[0] += [sorted_words[k] for k in at.tolist()]
            out[1] += number.tolist()
            out[2] += [sorted_words[k] for k in other.tolist()]
            out[3] += most.tolist()
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["word", "n_near", "other", "other_n"])


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n): how many words are one edit away, and the commonest of them."""
    groups = letter_groups(vocab, vocab.count())
    held = stage(blocks(vocab, groups), "blocks")
    pairs = block_pairs(held, len(groups))
    found = pairs.mapInArrow(_near, "word string, n_near long, other string, other_n long")
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.other").alias("best"), (-F.col("best.rank")).alias("best_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form, by doubling: the end of each chain of forms."""
    held = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        onward = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(held.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(held)
        held = longer
    return held


def group(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, deleted_of: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocab = stage(vocabulary(docs, min_length, min_count, deleted_of), "vocabulary")
    near = near_words(vocab)
    formed = (F.col("best_n") >= ratio * F.col("n"))
    known = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"),
    )
    known = stage(known, "forms")
    discard(vocab)
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
