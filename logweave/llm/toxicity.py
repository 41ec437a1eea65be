"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones
and, inside words, digits and signs that stand for letters; then all but
letters becomes single spaces. The lexicon (whole words and word beginnings,
with log-odds weights) and exception phrases (two words around an entry that
clean texts use) are learned from a bounded sample of labelled rows; one
automaton holds both. A document's hits, weighted and set against its length,
give a probability by a logistic curve fitted on scores that each half of the
sample gets from the other half's lexicon.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, stage
from .langid import held_out

# ── fixed values: letters and digits that look like Latin letters ──────────
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# ── end of fixed values ────────────────────────────────────────────────────

STEMS = (4, 5, 6)  # word beginnings that may be entries
_HOMOGLYPH = re.compile(f"[{''.join(HOMOGLYPHS)}Ａ-ｚ]")
_FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_LEET = str.maketrans(LEET)
_LEET_RUN = re.compile(f"[{re.escape(''.join(LEET))}]+")
_OTHER = re.compile(r"[\W\d_]+")


def _unleet(s: str) -> str:
    """Substitute digits and signs in words that also have letters; plain numbers stay."""
    out, done = [], 0
    for m in _LEET_RUN.finditer(s):
        a, b = m.span()
        if a < done:
            continue
        part = lambda c: c.isalnum() or c in "@$"
        while a > done and part(s[a - 1]):
            a -= 1
        while b < len(s) and part(s[b]):
            b += 1
        word = s[a:b]
        if any(c.isalpha() for c in word):
            out += [s[done:a], word.translate(_LEET)]
            done = b
    return "".join([*out, s[done:]]) if out else s


def fold(text: str | None) -> str:
    """`` w1 w2 ... wn `` of the folded words (one space for no words)."""
    s = (text or "").lower()
    if not s.isascii() and _HOMOGLYPH.search(s):
        s = s.translate(_FOLD)
    return f" {_OTHER.sub(' ', _unleet(s)).strip()} "


@dataclass
class Lexicon:
    """Entries with weights: ``word`` in full, ``stem*`` for word beginnings; two-word exceptions."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        """The compiled automaton (None without entries); not pickled, built per task."""
        if not self.entries:
            return None
        if not hasattr(self, "_auto"):
            import ahocorasick

            a = ahocorasick.Automaton()
            for key, weight in self.entries.items():
                word = f" {key[:-1]}" if key.endswith("*") else f" {key} "
                a.add_word(word, (weight, len(word)))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (None, len(phrase) + 2))
            a.make_automaton()
            self._auto = a
        return self._auto

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_auto"}

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of the strongest entry by the place of the word it hits."""
        auto = self.automaton()
        found: dict[int, float] = {}
        if auto is None:
            return found
        spared: list[tuple[int, int]] = []
        for end, (weight, size) in auto.iter(folded):
            at = end - size + 1
            if weight is None:
                spared.append((at, end))
            elif weight > found.get(at, 0.0):
                found[at] = weight
        for a, b in spared:
            for at in [x for x in found if a <= x < b]:
                del found[at]
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Strongest weight, summed weight and weight by length (both in logarithms)."""
        folded = fold(text)
        found = self.hits(folded)
        if not found:
            return 0.0, 0.0, 0.0
        total = sum(found.values())
        return max(found.values()), math.log1p(total), math.log1p(100 * total / max(20, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 100) -> tuple[float, ...]:
    """Logistic regression with intercept by Newton's method; no feature may lower the score."""
    use = list(range(x.shape[1]))
    while True:
        a = np.hstack([np.ones((len(x), 1)), x[:, use]])
        w, keep = np.zeros(a.shape[1]), np.diag([1e-3] + [ridge] * len(use))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
            w += step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-8:
                break
        wrong = [f for f, v in zip(use, w[1:]) if v < 0]
        if not wrong:
            out = np.zeros(x.shape[1])
            out[use] = w[1:]
            return (float(w[0]), *(float(v) for v in out))
        use = [f for f in use if f not in wrong]


def chance(k: int, c: int, share: float) -> float:
    """P(at least k of k + c texts are toxic) if the token had nothing to do with it."""
    n = k + c
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share) for i in range(k, n + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def tokens(folded: str) -> set[str]:
    words = set(folded.split())
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, half, toxic, clean): in how many texts a token stands, summed while memory allows."""
    sums: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys, ns = list(sums), list(sums.values())
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32())]
        cols += [pa.array([n if k[2] else 0 for k, n in zip(keys, ns)], pa.int64()), pa.array([0 if k[2] else n for k, n in zip(keys, ns)], pa.int64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(cols, ["token", "half", "toxic", "clean"])

    for batch in batches(rows, "text"):
        for text, half, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "half", "toxic"))):
            sums.update((t, half, toxic) for t in tokens(fold(text)))
            if len(sums) > 300_000:
                yield flush()
    if sums:
        yield flush()


def sample_labels(labels: DataFrame, per_class: int) -> list[tuple[int, int, int]]:
    """(doc_id, toxic, half) of at most ``per_class`` labelled ids per class outside the held-out fold, by hash."""
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter(~held_out(F.col("doc_id"))).distinct().withColumn("h", F.xxhash64("doc_id"))
    rows = [r for c in (0, 1) for r in usable.filter(F.col("toxic") == c).orderBy("h", "doc_id").limit(per_class).collect()]
    return [(r["doc_id"], r["toxic"], r["h"] & 1) for r in rows]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, least_weight: float = 2.0, luck: float = 1e-4) -> Lexicon:
    """The lexicon, its exceptions and its curve from a sample of at most ``2 * per_class`` labelled rows.

    An entry stands in at least 3 of the sample's toxic texts (2 of a half's),
    has a smoothed log-odds of ``least_weight`` or more and so many toxic
    texts by chance with probability ``luck`` at most. Every token that passes
    all three is an entry, and every phrase of clean texts alone (3 at least) an exception: their number
    is bounded by the sample's words. Without texts of both classes the
    lexicon is empty and every score is the share of toxic texts (0 for none).
    """
    spark = docs.sparkSession
    picked = sample_labels(labels, per_class)
    schema = "doc_id long, toxic int, half int"
    ids = spark.createDataFrame(picked, schema)
    # at most 2 * per_class rows of 16 bytes: a bounded broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", "half")
    counts = sample.mapInArrow(_counted, "token string, half int, toxic long, clean long")
    one = lambda c, h: F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}")
    size = {(h, t): max(1, sum(1 for _, tt, hh in picked if hh == h and tt == t)) for h in (0, 1) for t in (0, 1)}
    counts = counts.groupBy("token").agg(one("toxic", 0), one("toxic", 1), one("clean", 0), one("clean", 1)).filter("toxic0 + toxic1 > 1")
    odds = lambda k, n: math.log((k + 0.5) / (n + 1))

    def tested(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lexicon, token, toxic, weight) of the entries of the lexicon of both halves (2) and of each one (0, 1)."""
        for batch in rows:
            out = []
            for r in batch.to_pylist():
                for which, halves in enumerate(((0,), (1,), (0, 1))):
                    k, c = (sum(r[f"{name}{h}"] for h in halves) for name in ("toxic", "clean"))
                    pos, neg = (sum(size[h, t] for h in halves) for t in (1, 0))
                    weight = odds(k, pos) - odds(c, neg)
                    if k > len(halves) and weight >= least_weight and chance(k, c, pos / (pos + neg)) <= luck:
                        out.append((which, r["token"], k, weight))
            cols = zip((pa.int32(), pa.string(), pa.int64(), pa.float64()), zip(*out) if out else [()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in cols], ["lexicon", "token", "toxic", "weight"])

    real = stage(counts.mapInArrow(tested, "lexicon int, token string, toxic long, weight double"), "lexicon")

    def entries(which: int) -> dict[str, float]:
        return {r["token"]: r["weight"] for r in real.filter(F.col("lexicon") == which).orderBy("token").collect()}

    full = Lexicon(entries(2))
    halves = [Lexicon(entries(1 - h)) for h in (0, 1)]  # each half is scored by the other half's words
    discard(real)

    def contexts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches(rows, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                folded, pairs = fold(text), set()
                for at in full.hits(folded):
                    end = folded.index(" ", at + 1)
                    before, after = folded.rfind(" ", 0, max(at, 0)), folded.find(" ", end + 1)
                    pairs |= {folded[a + 1 : b] for a, b in ((before, end), (at, after)) if a >= 0 and b > 0 and a != b}
                seen.update((p, toxic) for p in pairs if " " in p)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen]), pa.array([n if k[1] else 0 for k, n in seen.items()], pa.int64()), pa.array([0 if k[1] else n for k, n in seen.items()], pa.int64())],
                ["phrase", "toxic", "clean"],
            )

    if full.entries:
        spared = sample.select("text", "toxic").mapInArrow(contexts, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        rows = spared.filter("c >= 3 and t = 0").orderBy("phrase").collect()
        for lex in (full, *halves):
            lex.exceptions = [r["phrase"] for r in rows]

    def scored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            found = [halves[h].features(t) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
            cols = [pa.array([f[i] for f in found], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *cols], ["toxic", "a", "b", "c"])

    got = sample.mapInArrow(scored, "toxic int, a double, b double, c double").toPandas()
    y = got["toxic"].to_numpy(np.float64)
    if len(set(y.tolist())) == 2:
        full.curve = fit_curve(got[["a", "b", "c"]].to_numpy(), y)
    else:
        full.entries, full.curve = {}, (50.0 if len(y) and y[0] else -50.0, 0.0, 0.0, 0.0)
    return full


def predict(docs: DataFrame, lexicon: Lexicon, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``; only the text decides.

    Null and empty text has no hits and the curve's lowest score; null and
    repeated doc_ids and repeated rows are kept; extra columns are ignored.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            scores = [lexicon.score(t.as_py()) for t in batch.column("text")]
            flags = [int(s >= cut) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(flags, pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows outside the held-out fold, score every row."""
    return predict(docs, learn(docs, labels))
