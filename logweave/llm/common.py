"""Helpers shared by the operators of this subpackage.

``WORD`` and ``SPACE`` spell the ASCII word split that several contracts fix.
``stage`` writes an intermediate table into the folder every executor shares
and reads it back: it cuts lineage, survives lost executors and frees the
shuffle files above it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
#: the same separators as characters, for translate()
SPACES = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Session settings of these operators: small Arrow batches, and workers that find this package.

    Python workers started from a plain checkout have not its folder on their
    path; on a cluster the package is installed or sent with ``--py-files``.
    """
    configure(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "2000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One given table, only the named columns."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


#: Spark's own removal of an execution's shuffle files at its end
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    ``free`` has Spark remove the shuffle files of this one execution when it
    ends, instead of when the driver next collects garbage: the written table
    stands for them. (Were a file still wanted, its stage would run again.)
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    if free:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(staged: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    sc = staged.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(staged._llm_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shards_for(df_bytes: int, per_shard: int, least: int = 1) -> int:
    """How many shards keep each near ``per_shard`` bytes."""
    return max(least, -(-int(df_bytes) // per_shard))


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows (one aggregate)."""
    got = df.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()
    return int(got["n"] or 0)


def n_words(text: Column) -> Column:
    """Number of ASCII-separated words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ── numpy hashing of word and byte sequences ───────────────────────────────
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = int(_BASE)):
        self._b, self._i = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            ones = np.ones(n, np.uint64)
            up, down = ones.copy(), ones.copy()
            up[1:], down[1:] = np.uint64(self._b), np.uint64(self._i)
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


POWERS = Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end]; equal spans hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = POWERS.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the ASCII-separated words in a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z on UTF-8 bytes; other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of the smallest (by upper half, then leftmost)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done < width:  # minima of windows of doubling width
        step = min(done, width - done)
        key = np.minimum(key[: len(key) - step], key[step:])
        done += step
    return (key[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def batches(rows: Iterator[pa.RecordBatch], text: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes of text (one row at least)."""
    for batch in rows:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes, each value followed by a space, and the n+1 offsets; nulls are empty."""
    values = column.cast(pa.large_binary()).fill_null(b"").to_pylist()
    ends = np.cumsum([len(v) + 1 for v in values]) if values else np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join([*values, b""]), np.uint8)
    return data, np.concatenate([[0], ends]).astype(np.int64)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left side's key columns only."""
    for k in keys:
        right = right.withColumnRenamed(k, f"__{k}")
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{k}" for k in keys])
