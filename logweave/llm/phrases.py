"""Substring dedup on words by repeated-phrase automata.

A window is ``window`` consecutive words; every word covered by a window whose
words also start earlier (smaller doc_id, or earlier in the same document) is
removed. Windows are judged on the input.

Phrases are the windows' anchors (see ``repeats``). Those that recur anywhere
are confirmed by counting their hashes; each shard of documents compiles the
confirmed phrases it holds, as words, into an Aho-Corasick automaton and
streams all its texts through it. The automaton's hits alone say where
phrases stand; a phrase that only shares a confirmed one's hash is not found. The units around
located phrases (their windows by hash within their anchor) then meet across
shards: equal units by one combining aggregate, windows of differing units of
one anchor by another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_on, span_hashes, stage
from .repeats import Level, blocks, by_shard, digested, identified, member, recurring_anchors, shard_batches, shard_facts, uncovered, with_facts, words_level

SALTS = 16
_UNITS = "anchor long, unit long, key long, tie long, start long, n int, windows array<long>"
_EMPTY = pa.table({
    "anchor": pa.array([], pa.int64()), "unit": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "tie": pa.array([], pa.int64()),
    "start": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "windows": pa.array([], pa.list_(pa.int64())),
})


class PhraseAutomaton:
    """An Aho-Corasick automaton over phrases written as `` w1 ... wk `` in one-byte characters."""

    def __init__(self):
        import ahocorasick

        self.auto, self.size = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0

    def add(self, phrase: str) -> None:
        if self.auto.add_word(phrase, len(phrase)):
            self.size += 1

    def compile(self) -> None:
        if self.size:
            self.auto.make_automaton()

    def starts(self, text: str) -> np.ndarray:
        """Places of the first words of all phrase occurrences in a text of the same form."""
        if not self.size:
            return np.zeros(0, np.int64)
        return np.array([end - size + 2 for end, size in self.auto.iter(text)], np.int64)


def spaced(text: bytes) -> tuple[str, np.ndarray]:
    """The words with one space before, between and behind them, and the places where words start."""
    words = text.split()
    size = np.array([len(w) for w in words], np.int64) + 1
    return f" {b' '.join(words).decode('latin-1')} ", np.concatenate([[1], 1 + np.cumsum(size)])


def phrase_list(level: Level, docs: pa.Table, recurring: np.ndarray) -> list[str]:
    """The words of each confirmed phrase, from its first place in the shard's texts (one per hash)."""
    out, missing = [], recurring
    for batch in shard_batches(docs, level):
        r, _, _ = level.runs(batch.column("text"))
        some = np.flatnonzero(member(missing, r.anchor))
        if not len(some):
            continue
        hashes, first = np.unique(r.anchor[some], return_index=True)
        first = some[first]
        for d in np.unique(r.doc[first]).tolist():
            text, at = spaced(batch.column("text")[d].as_py().encode())
            place = r.place[first[r.doc[first] == d]]
            out += [text[x - 1 : y] for x, y in zip(at[place].tolist(), at[place + level.gram].tolist())]
        missing = np.setdiff1d(missing, hashes, assume_unique=True)
    return out


def _located(level: Level, docs: pa.Table, facts: pa.Table) -> pa.Table:
    """The uncovered units whose anchors the automaton finds in one shard's texts; its hits alone decide."""
    confirmed, covered = shard_facts(facts)
    out = [_EMPTY]
    if not docs.num_rows or not len(confirmed):
        return _EMPTY
    automaton = PhraseAutomaton()
    for phrase in phrase_list(level, docs, confirmed):
        automaton.add(phrase)
    automaton.compile()
    for batch in shard_batches(docs, level):
        r, bounds, words = level.runs(batch.column("text"))
        keep = uncovered(r, batch, covered, level.window)
        keys, ties = batch.column("key").to_pylist(), batch.column("tie").to_pylist()
        cut = np.searchsorted(r.doc, np.arange(batch.num_rows + 1))
        for d in range(batch.num_rows):
            open_ = cut[d] + np.flatnonzero(keep[cut[d] : cut[d + 1]])
            if not len(open_):
                continue
            text, at = spaced(batch.column("text")[d].as_py().encode())
            seen = np.unique(np.searchsorted(at, automaton.starts(text)))
            mine = open_[member(seen, r.place[open_])]
            if not len(mine):
                continue
            w = words[bounds[d] : bounds[d + 1]]
            start, n, place, anchor = r.start[mine], r.n[mine], r.place[mine], r.anchor[mine]
            # windows by their words and their offset to the anchor
            which = np.repeat(np.arange(len(start)), n)
            s = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + start[which]
            win = span_hashes(w, s, s + level.window) + (place[which] - s).astype(np.uint64)
            unit = span_hashes(w, start, start + n - 1 + level.window) + (place - start).astype(np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(win.view(np.int64)))
            m = len(start)
            out.append(pa.table({
                "anchor": anchor.view(np.int64), "unit": unit.view(np.int64), "key": np.full(m, keys[d], np.int64), "tie": np.full(m, ties[d], np.int64),
                "start": start.astype(np.int64), "n": n.astype(np.int32), "windows": lists,
            }))
    return pa.concat_tables(out)


def covered_words(docs: DataFrame, shards: int, buckets: int, level: Level) -> DataFrame:
    """(key, tie, start, end): word spans covered by windows that also start earlier."""
    place = F.struct("key", "start")
    all_blocks = stage(blocks(docs, level), "blocks", free=True)
    firsts = all_blocks.groupBy("b0", "b1").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    copies = join_on(all_blocks, firsts, ["b0", "b1"]).filter(place != F.col("first"))
    copies = stage(copies.select("key", "tie", "start", "end"), "copies", free=True)
    discard(all_blocks)
    anchors = stage(recurring_anchors(docs, copies, level, shards, buckets), "anchors", free=True)

    def located(left: pa.Table, right: pa.Table) -> pa.Table:
        return _located(level, left, right)

    units = with_facts(docs, by_shard(anchors, copies, shards), shards).applyInArrow(located, _UNITS)
    units = stage(units, "units", free=True)
    discard(anchors)
    # equal units: all but the first are covered
    firsts = stage(units.groupBy("anchor", "unit").agg(F.min(place).alias("first"), F.count("*").alias("c")), "firsts", free=True)
    again = firsts.filter("c > 1").drop("c")
    later = join_on(units.drop("windows"), again, ["anchor", "unit"]).filter(place != F.col("first"))
    later = later.select("key", "tie", "start", (F.col("start") + F.col("n") - 1 + level.window).alias("end"))
    # first units of anchors that have several different ones: window by window
    several = firsts.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1")
    # a common anchor has many different units: it is dealt over SALTS keys
    several = several.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = firsts.drop("c").withColumn("salt", F.pmod("unit", F.lit(SALTS)).cast("int")).join(several, ["anchor", "salt"], "left_semi")
    open_ = join_on(units, salted.drop("salt"), ["anchor", "unit"]).filter(place == F.col("first"))
    wins = open_.select("anchor", "key", "tie", F.col("start").alias("at"), F.posexplode("windows").alias("i", "window"))
    wins = stage(wins.select("anchor", "window", "key", "tie", (F.col("at") + F.col("i")).alias("start")), "windows", free=True)
    early = wins.groupBy("anchor", "window").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    single = join_on(wins, early, ["anchor", "window"]).filter(place != F.col("first"))
    single = single.select("key", "tie", "start", (F.col("start") + level.window).alias("end"))
    out = stage(copies.union(later).union(single), "spans", free=True)
    for used in (copies, units, firsts, wins):
        discard(used)
    return out


def dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words per row of ``docs`` (doc_id, text).

    Words are split at ASCII white space and otherwise unchanged; null text
    has none. Rows that share a doc_id count as one document, compared by
    word position; equal rows are treated alike. A null doc_id comes last.
    Extra columns are ignored; no rows give no rows.
    """
    rows, shards, buckets = identified(docs)
    spans = covered_words(rows, shards, buckets, words_level(window))

    def digest(ids: pa.Array, texts: pa.Array, spans: list[np.ndarray]) -> pa.RecordBatch:
        n, gone, sha, kept = [], [], [], []
        for text, cut in zip(texts, spans):
            words = (text.as_py() or "").encode().split()
            left, at = [], 0
            for a, b in cut.tolist():
                left += words[at:a]
                at = b
            left += words[at:]
            body = b" ".join(left)
            n.append(len(words))
            gone.append(len(words) - len(left))
            sha.append(hashlib.sha256(body).hexdigest())
            kept.append(body.decode())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return digested(rows, spans, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
