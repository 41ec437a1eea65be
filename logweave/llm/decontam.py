"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased with white space runs as one space. An
item of ``m`` characters may be found with up to ``e = floor(rate * m)`` edits.
Items shorter than ``short`` are found only exactly and between word edges
("art" does not stand in "party"); items shorter than ``least`` characters are
no evidence and are not searched. An item is split into ``e + 1``
pieces: any occurrence within the budget holds one piece unchanged. One
Aho-Corasick automaton finds all pieces of all items in one pass over a text;
around each hit, the shared q-grams are counted (an occurrence keeps at least
``m - q + 1 - q * e``) and Myers' bit-parallel algorithm gives the distance.

Items are the small side: the driver reads them in shards of at most
``SHARD_BYTES`` and chains one pass per shard, so no automaton grows with the
benchmark. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, prepare, shards_for, total_bytes

SHARD_BYTES = 4 << 20
Q = 4


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def peq(pattern: str) -> dict[str, int]:
    """Bit mask of the places of each character."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any substring of ``text``, and that substring's end."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph <<= 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
    return best, end


@dataclass
class Item:
    item_id: int | None
    text: str
    budget: int


class Matcher:
    """The pieces of some items as one automaton; picklable, compiled per task."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float, short: int, least: int = 16):
        self.items = []
        for item_id, text in items:
            norm = normalise(text)
            if len(norm) >= max(1, least):
                self.items.append(Item(item_id, norm, int(rate * len(norm)) if len(norm) >= short else 0))

    def __getstate__(self):
        return {"items": self.items}

    def _compile(self) -> None:
        import ahocorasick

        self.auto, pieces = ahocorasick.Automaton(), {}
        for n, item in enumerate(self.items):
            m, parts = len(item.text), item.budget + 1
            cuts = [i * m // parts for i in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(item.text[a:b], []).append((n, a))
        for piece, at in pieces.items():
            self.auto.add_word(piece, (len(piece), at))
        if pieces:
            self.auto.make_automaton()
        self.masks = [peq(i.text) for i in self.items]
        self.grams = [{i.text[j : j + Q] for j in range(len(i.text) - Q + 1)} for i in self.items]

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, from, to, distance) in the normalised text: for each item its nearest occurrence."""
        if not self.items:
            return []
        if not hasattr(self, "auto"):
            self._compile()
        norm = normalise(text)
        near: dict[int, list[int]] = {}
        for end, (size, places) in self.auto.iter(norm):
            for n, offset in places:
                near.setdefault(n, []).append(end + 1 - size - offset)
        out = []
        for n, starts in near.items():
            item = self.items[n]
            m, e, best = len(item.text), item.budget, None
            for lo, hi in _merged(sorted(starts), m, e):
                lo, hi = max(0, lo), min(len(norm), hi)
                window = norm[lo:hi]
                if len(window) < m - e:
                    continue
                if e == 0:
                    at = window.find(item.text)
                    while at >= 0 and not stands_alone(norm, lo + at, lo + at + m):
                        at = window.find(item.text, at + 1)
                    found = (0, at + m) if at >= 0 else (1, 0)
                else:
                    grams, least = self.grams[n], m - Q + 1 - Q * e
                    if least > 0 and sum(window[j : j + Q] in grams for j in range(len(window) - Q + 1)) < least:
                        continue
                    found = myers(self.masks[n], m, window)
                if found[0] <= e and (best is None or found[0] < best[3]):
                    best = (item.item_id, max(0, lo + found[1] - m - found[0]), lo + found[1], found[0])
            if best:
                out.append(best)
        return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit goes on over either end of text[start:end]."""
    left = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    right = end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    return not left and not right


def _merged(starts: list[int], m: int, e: int) -> Iterator[tuple[int, int]]:
    """Windows around likely starts; starts within the budget of each other share one."""
    first = last = starts[0]
    for s in starts[1:]:
        if s - last > e:
            yield first - e, last + m + e
            first = s
        last = s
    yield first - e, last + m + e


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("distance", T.LongType())]))
_HITS_PA = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64())]))
_COL = "__test_hits"


def matchers(bench: DataFrame, rate: float, short: int, least: int) -> Iterator[Matcher]:
    """One matcher per shard of at most about SHARD_BYTES of items."""
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    n = shards_for(total_bytes(items, "text"), SHARD_BYTES)
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i) if n > 1 else items
        yield Matcher([(r["item_id"], r["text"]) for r in part.collect()], rate, short, least)


def find(docs: DataFrame, bench: DataFrame, rate: float = 0.1, short: int = 32, least: int = 16, column: str = _COL) -> DataFrame:
    """``docs`` with an array of hits per row: item_id, start, end, distance.

    All rows and columns are kept. Null or empty text has no hits; null,
    empty and very short items are never found; repeated items are each reported; an empty
    benchmark finds nothing.
    """
    prepare(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, HITS)])
    out = docs.withColumn(column, F.lit(None).cast(HITS))
    for matcher in matchers(bench, rate, short, least):

        def run(rows: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches(rows, "text"):
                hits = []
                for text, old in zip(batch.column("text"), batch.column(column).to_pylist()):
                    new = [dict(zip(("item_id", "start", "end", "distance"), h)) for h in matcher.find(text.as_py())]
                    hits.append((old or []) + new)
                cols = [c for n, c in zip(batch.schema.names, batch.columns) if n != column]
                names = [n for n in batch.schema.names if n != column]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(hits, _HITS_PA)], [*names, column])

        out = out.mapInArrow(run, schema)
    return out


def report(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted, distinct), n_edits (of the nearest hit) per row of ``docs``."""
    out = find(docs.select("doc_id", "text"), bench, **how)
    ids = F.array_sort(F.array_distinct(F.transform(_COL, lambda h: h["item_id"])))
    return out.select("doc_id", (F.size(_COL) > 0).alias("contaminated"), ids.alias("item_ids"), F.array_min(F.transform(_COL, lambda h: h["distance"])).alias("n_edits"))


def clean_documents(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without a hit; all their columns."""
    return find(docs, bench, **how).filter(F.size(_COL) == 0).drop(_COL)
