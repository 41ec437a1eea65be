"""Block-wise plans: next events of pairs of series, products of all pairs, whole-name n-grams."""

import random
from bisect import bisect_left
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import persons
from logweave.plans import asof, bloom, gram


def events(spark, rows):
    return spark.createDataFrame(rows, "source string, t long, n long")


def lags_twin(rows, window):
    by = {}
    for s, t, _ in rows:
        by.setdefault(s, []).append(t)
    out = Counter()
    for a, t, n in rows:
        for b, ts in by.items():
            ts.sort()
            i = bisect_left(ts, t)
            if b != a and i < len(ts) and ts[i] - t <= window:
                out[a, b, ts[i] - t] += n
    return {(*k, w) for k, w in out.items()}


@pytest.mark.parametrize("block", [100_000, 20, 3])
def test_next_lags_of_all_pairs(spark, block):
    """Also when a window's sources are dealt into many groups, and with a null source and negative times."""
    rng = random.Random(block)
    rows = {(rng.choice(["a", "b", "c", "d", "", None]), rng.randrange(-50, 400)) for _ in range(300)}
    rows = [(s, t, rng.randrange(1, 4)) for s, t in rows] + [(f"s{i}", 7, 1) for i in range(12)]
    got = asof.lag_counts(events(spark, rows), 30, block=block).groupBy("source_a", "source_b", "lag").sum("w").collect()
    assert {tuple(r) for r in got} == lags_twin(rows, 30) and len(got) > 200


def test_no_events(spark):
    assert asof.lag_counts(events(spark, []), 30).count() == 0


def test_products_of_all_pairs(spark, monkeypatch):
    """Many blocks, one column that all rows share, and sums beyond 64 bits."""
    monkeypatch.setattr(gram, "BLOCK_ROWS", 8)
    monkeypatch.setattr(gram, "BLOCK_COLUMNS", 8)
    rng = random.Random(4)
    cells = {(f"r{i:02d}", 0): 3 for i in range(40)}
    for _ in range(600):
        cells[f"r{rng.randrange(40):02d}", rng.randrange(60)] = rng.choice([1, 7, -5, 10**12 + 3, 3 * 10**15])
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()] + [(None, 0, 5)], "source string, at long, events long")
    got = {(r["a"], r["b"]): r["product"] for r in gram.pair_products(df, "source", "at", "events").collect()}
    want = Counter()
    for (r, c), v in cells.items():
        for (q, d), w in cells.items():
            if c == d and r <= q:
                want[r, q] += v * w
    assert {k: Decimal(v) for k, v in want.items() if v} == {k: v for k, v in got.items() if v}
    assert max(want.values()) > 1 << 64


def test_products_are_exact_over_many_columns():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 50, (2, 9000)), rng.integers(-(1 << 50), 1 << 50, (3, 9000))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert gram.products(a, b).tolist() == want
    assert gram.products(a >> 40, b >> 40).dtype == np.int64


def test_no_cells(spark):
    assert gram.pair_products(spark.createDataFrame([], "source string, at long, events long"), "source", "at", "events").count() == 0


def found(spark, texts, names):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = persons.person_names(df, spark.createDataFrame([(n,) for n in names], "name string"), ["id"])
    return [r["persons"] for r in out.orderBy("id").collect()]


def test_names_in_scripts_without_spaces(spark):
    texts = ["田中マイケルさんが来た", "ผู้ใช้สมชายเข้าสู่ระบบ", "欧阳娜娜和欧阳", "マイケル・ジャクソン です", None, ""]
    got = found(spark, texts, ["マイケル", "สมชาย", "欧阳娜娜", "欧阳", "ジャクソン", "マイケル・ジャクソン"])
    assert got == [["マイケル"], ["สมชาย"], ["欧阳", "欧阳娜娜"], ["ジャクソン", "マイケル", "マイケル・ジャクソン"], [], []]


def test_names_across_the_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(persons, "CHUNK", 5)
    names = ["Ann", "Ann Lee", "Juan Carlos de Borbon y Borbon", "王小明", "王", "...", " "]
    words = [f"w{i}" for i in range(23)]
    texts = []
    for k in range(0, 23, 3):
        texts.append(" ".join([*words[:k], "(Juan Carlos de Borbon y Borbon),", *words[k:], "Ann", "lee"]))
        texts.append("".join("甲" for _ in range(k)) + "王小明" + "乙" * (23 - k))
    got = found(spark, texts, names)
    assert got == [["Ann", "Juan Carlos de Borbon y Borbon"], ["王", "王小明"]] * 8


def test_names_equal_brute_force(spark):
    rng = random.Random(6)
    names = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(30))) for _ in range(60)]
    want = [sorted({n for n in names if f" {n} " in f" {t} "}) for t in texts]
    assert found(spark, texts, names) == want


def test_common_name_and_empty_name_table(spark):
    assert found(spark, ["x Ann y"] * 50, ["Ann"]) == [["Ann"]] * 50
    assert found(spark, ["x"], []) == [[]]


@pytest.mark.parametrize("bits", [64, 1 << 17])
def test_bloom_filters_lose_no_shared_item(spark, bits):
    """Small filters let more through, a wide one nearly nothing else."""
    rng = random.Random(3)
    rows = [(f"id{rng.randrange(900)}", rng.choice("abc")) for _ in range(1200)] + [(None, "a"), ("x", None), ("x", "a")]
    df = spark.createDataFrame(rows, "id string, source string").repartition(5)
    groups = {}
    for i, s in rows:
        groups.setdefault(i, set()).add(s)
    shared = {i for i, s in groups.items() if len(s) > 1}
    kept = [tuple(r) for r in bloom.maybe_shared(df, "id", "source", bits).collect()]
    assert sorted((r for r in rows if r[0] in shared), key=str) == sorted((r for r in kept if r[0] in shared), key=str)
    others = {r[0] for r in kept} - shared
    assert len(others) < 20 if bits > 64 else len(others) > 20
    assert bloom.maybe_shared(df.limit(0), "id", "source", bits).count() == 0


def test_shared_ids_with_and_without_filters(spark):
    from logweave.operators import correlate

    rng = random.Random(5)
    rows = [(f"s{rng.randrange(3)}", "2024-01-01 00:00:01", f"trace {1700000000000 + rng.randrange(300)} x {1800000000000 + i}") for i in range(500)]
    df = spark.createDataFrame(rows, "source string, time string, msg string")
    plain = correlate.shared_ids(df).collect()
    assert sorted(plain) == sorted(correlate.shared_ids(df, bloom_bits=1 << 16).collect()) and len(plain) > 50
    top = correlate.shared_ids(df, top=10, bloom_bits=1 << 16).collect()
    assert [r["id"] for r in top] == [r["id"] for r in sorted(plain, key=lambda r: (-r["n_sources"], -r["n_occurrences"], r["id"]))[:10]]


@pytest.mark.parametrize("count", [1, 3000, 10**9])
def test_key_filter_loses_no_key_and_is_bounded(spark, monkeypatch, count):
    monkeypatch.setattr(bloom, "MOST_PAGES", 4)
    keys = spark.range(0, 9000, 3).select((F.col("id") % 2 == 0).alias("kind"), F.col("id").cast("string").alias("form"))
    df = spark.range(9000).select("id", (F.col("id") % 2 == 0).alias("kind"), F.col("id").cast("string").alias("form"))
    kept = {r["id"] for r in bloom.maybe_among(df, keys, ["kind", "form"], count).collect()}
    assert kept >= set(range(0, 9000, 3)) and bloom.pages_for(count) <= 4
    if count > 1:  # sized for its keys: few others
        assert len(kept) < 3200
    assert bloom.maybe_among(df, keys.limit(0), ["kind", "form"], 0).count() == 0
