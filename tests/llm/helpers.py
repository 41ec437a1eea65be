"""Small document tables for the operator tests."""

SCHEMA = "doc_id long, text string, lang string, source string, size long, key long, tie string, start int, shard string, node long, comp long"


def table(spark, rows):
    """rows of (doc_id, text[, lang, source]) plus columns whose names the operators use themselves."""
    full = [(*r, *([None] * (4 - len(r))), 7, 8, "x", 9, "y", 10, 11) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary):04d}" for _ in range(n))


def hard_rows(rng):
    """Nulls, empty and blank texts, repeated rows, repeated ids, one very long text."""
    base = prose(rng, 120)
    long_text = prose(rng, 30_000, 20_000)
    return [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n "), (None, base), (None, None),
        (6, "one two"), (7, "one two"), (8, long_text), (9, base + " tail words here"), (9, "another text of the same id"),
        (10, "Ünïcödé wörds 用户 登录 " * 8), (11, "Ünïcödé wörds 用户 登录 " * 8), (12, prose(rng, 60) + " " + base[:300]),
    ]
