"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything that is no letter counts as a word edge.
The n-grams (1 to 3 code points) of a word with one edge on either side are
hashed into ``buckets`` columns. Training counts them per language, summed by
Spark over all training rows; the table of log-probabilities has
``buckets + 1`` floats per language and is broadcast. Scoring adds up, for a whole batch of texts at once, the columns of
the n-grams that occur (numpy gather and segment sums).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches

BUCKETS = 1 << 16
MAX_LABELS = 1000  # bounds the table: 256 KiB a label
UNKNOWN = "und"
_EDGE = 32
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per order (bucket ids, segment starts), and whether a text has a letter.

    Segment ``i`` holds text ``i``'s n-grams; an id of ``buckets`` stands for
    a position that is no n-gram of its order.
    """
    low = [(t or "").lower() for t in texts]
    # a space before each text: the edge of its first word, and behind the text before it
    cps = np.frombuffer("".join(" " + x for x in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in low])
    letter = _is_letter()[cps]
    keep = letter.copy()  # letters, and the first of each run of other characters
    keep[1:] |= letter[:-1]
    keep[0] = True
    keep[ends[:-1]] = True  # a text's first position, so that no segment is empty
    count = np.concatenate([[0], np.cumsum(keep)])
    starts = count[np.concatenate([[0], ends[:-1]])]
    at = np.concatenate([[0], np.cumsum(letter)])
    has_letter = at[ends] > at[np.concatenate([[0], ends[:-1]])]
    c = np.where(letter, cps, np.uint32(_EDGE))[keep]
    inner = c != _EDGE
    out, h = [], np.zeros(len(c), np.uint32)
    pad = np.concatenate([c, np.full(2, _EDGE, np.uint32)])
    pad_in = np.concatenate([inner, np.zeros(2, bool)])
    n = len(c)
    for order in (1, 2, 3):
        h = h + pad[order - 1 : n + order - 1] * _MULT[order - 1]
        if order == 1:
            ok = inner
        elif order == 2:
            ok = inner | pad_in[1 : n + 1]
        else:
            ok = pad_in[1 : n + 1]
        x = h + np.uint32(order)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out.append((np.where(ok, x % np.uint32(buckets), np.uint32(buckets)), starts))
    return out, has_letter


def train(docs: DataFrame, label: str, text: str = "text", buckets: int = BUCKETS, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Labels (sorted) and their log-probabilities, float32 of shape (labels, buckets + 1).

    Rows with a null label or text are left out. No such rows: no labels.
    The prior is uniform. Counting runs over all rows; the driver gets at most
    ``buckets`` numbers per label, for at most MAX_LABELS labels.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches(rows, "text"):
            labels = np.array(batch.column("label").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for name in sorted(set(labels)):
                mine = [texts[i] for i in np.flatnonzero(labels == name)]
                total = sums.setdefault(name, np.zeros(buckets + 1, np.int64))
                for ids, _ in grams(mine, buckets)[0]:
                    total += np.bincount(ids, minlength=buckets + 1)
        for name, total in sums.items():
            at = np.flatnonzero(total[:buckets])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])], ["label", "bucket", "n"])

    rows = docs.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).dropna()
    counts = rows.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c"))
    got = counts.select("label", "c.bucket", "c.n").orderBy("label").limit(MAX_LABELS + 1).toPandas()
    if len(got) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = got["label"].tolist()
    table = np.zeros((len(labels), buckets + 1), np.float64)
    for i, (b, n) in enumerate(zip(got["bucket"], got["n"])):
        table[i, np.asarray(b, np.int64)] = n
    table[:, :buckets] += smooth
    logs = np.log(table[:, :buckets] / table[:, :buckets].sum(axis=1, keepdims=True)) if labels else np.zeros((0, buckets))
    return labels, np.hstack([logs, np.zeros((len(labels), 1))]).astype(np.float32)


def score(texts: list[str | None], labels: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Label and posterior per text; the posterior is tempered, as n-grams of a text are not independent."""
    if not labels:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    parts, has_letter = grams(texts, logs.shape[1] - 1)
    total, n = np.zeros((len(labels), len(texts))), np.zeros(len(texts))
    for ids, starts in parts:
        for row, col in zip(total, logs):
            row += np.add.reduceat(col[ids], starts, dtype=np.float64)
        n += np.add.reduceat((ids < logs.shape[1] - 1).astype(np.int64), starts)
    z = (total - total.max(axis=0)) / np.maximum(1.0, n / 100)
    p = np.exp(z)
    p /= p.sum(axis=0)
    best = total.argmax(axis=0)
    return [labels[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)], np.where(has_letter, p.max(axis=0), 0.0)


def held_out(doc_id: Column) -> Column:
    """The fold no model may learn from: crc32 of the id's text, modulo 3, is 1 (a null id counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs``; only the text decides.

    Null text and text without a letter: ``und`` with score 0, as is every
    text under a model without labels. Null and repeated doc_ids and repeated
    rows are kept; extra columns are ignored.
    """
    model_ = docs.sparkSession.sparkContext.broadcast(model)  # once per executor; 256 KiB a label, MAX_LABELS at most

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            names, p = score(batch.column("text").to_pylist(), *model_.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn ``lang`` from the rows outside the held-out fold, predict every row."""
    return predict(docs, train(docs.filter(~held_out(F.col("doc_id"))), "lang"))
