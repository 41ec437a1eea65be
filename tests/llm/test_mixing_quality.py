import random

import duckdb
import pytest

from logweave.llm import mixing, quality, queries

from .helpers import hard_rows, prose, table


def _same(spark, name, view, docs, **tables):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    for t, df in tables.items():
        con.register(t, df.toArrow())
    cur = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(repr(tuple(r)) for r in view.select(*cols).collect())
    assert got == want


@pytest.mark.parametrize("block", [16, 4096])
def test_mix_matches_sql_and_keeps_its_limits(spark, block):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 200)) if i % 11 else None, "en", rng.choice(["a", "b", "c", "ä", "", None])) for i in range(300)]
    rows += [(5, "same row", "en", "a")] * 3 + [(None, "no id", "en", "b")]
    docs = table(spark, rows)
    out = mixing.mix(docs, block_tokens=block)
    got = out.collect()
    assert len(got) == len(rows)
    taken, goal = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first_slot"] is None) == (r["taken"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        goal[r["source"]] = r["target"]
    assert all(taken[s] == int(goal[s]) for s in goal)
    ids = [r for r in got if r["doc_id"] is not None and r["doc_id"] != 5]
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5), block_tokens=block).collect()}
    assert all(again[r["doc_id"]] == r["taken"] for r in ids)


def test_mix_query_equals_its_sql(spark):
    rng = random.Random(4)
    docs = table(spark, [(i, prose(rng, rng.randrange(0, 90)), "en", f"s{i % 7}") for i in range(150)] + hard_rows(rng)[:1])
    _same(spark, "op1_mixing", mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken"), docs)


def test_schedule_is_spread(spark):
    goals = spark.createDataFrame([("a", 1000, 5, 800.0), ("b", 400, 2, 400.0), ("c", 300, 1, 100.0)], "source string, source_size long, weight int, target double")
    rows = mixing.schedule(goals, 10).orderBy("slot").collect()
    assert len({r["slot"] for r in rows}) == len(rows) == 130
    for s, n in (("a", 80), ("b", 40), ("c", 10)):
        mine = [r for r in rows if r["source"] == s]
        assert [r["rank"] for r in mine] == list(range(n))
        half = sum(r["slot"] < 128 for r in mine)  # of 256 places
        assert abs(half - n / 2) <= 4


def test_mix_of_nothing_and_of_blank_texts(spark):
    assert mixing.mix(table(spark, []).limit(0)).collect() == []
    got = mixing.mix(table(spark, [(1, None), (2, ""), (2, "")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 3


def test_mixed_documents_repeat_whole_rows(spark):
    rng = random.Random(5)
    docs = table(spark, [(i, prose(rng, 50), "en", "abc"[i % 3]) for i in range(90)] + [(200, None, "en", "a")])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    per = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    # 30 documents of 50 words a source; targets 3000, 2500 and 1250 words
    assert (per["a"], per["c"]) == (60, 25) and abs(per["b"] - 50) <= 1


def _repeat_words(text):
    w = text.split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)})


def test_repeat_words_by_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in range(0, 40)] + ["a a a a", "a b c a b c", "x"]
    docs = table(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in quality.features(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_repeat_words"] == _repeat_words(t), t
        assert got[i]["n_words"] == len(t.split())


def _labelled(spark, n=900):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(n):
        bad = i % 9 == 0
        text = prose(rng, 80)
        rows.append((i, text.replace(" ", "## ") if bad else text, "en" if i % 2 else None, "s"))
        marks.append((i, 0 if bad else 1))
    rows += [(10_000, None), (10_001, ""), (10_001, ""), (None, prose(rng, 70)), (10_002, prose(rng, 9)), (10_003, "a b c " * 40)]
    return table(spark, rows), spark.createDataFrame([*marks, (None, 1), (3, 7)], "doc_id long, quality int")


def test_rules_catch_bad_rows_and_match_sql(spark):
    docs, labels = _labelled(spark)
    out = quality.judge(docs, labels, alpha=0.02)
    got = {r["doc_id"]: r for r in out.collect()}
    assert not any(got[i]["kept"] for i in range(0, 900, 9))
    assert all(got[i]["kept"] for i in range(900) if i % 9)
    assert not got[10_000]["kept"] and got[10_002]["base_failed"] and got[10_003]["base_failed"] and got[None]["kept"]
    view = quality.judge(docs, labels)
    _same(spark, "op8_quality_rules", view, docs, labels=labels)
    assert quality.kept_documents(docs, labels, alpha=0.02).columns == docs.columns
    assert quality.kept_documents(docs, labels, alpha=0.02).count() == 801


def _cutoffs_by_hand(held, alpha, delta, good_cost):
    """{(stratum, rule): cutoff} as the module's docstring has it; held: (stratum, quality, {rule: value})."""
    from math import comb

    strata, out = {s for s, _, _ in held}, {}
    for s in strata:
        for rule, cuts in quality.RULES.items():
            good = [v[rule] for t, q, v in held if t == s and q == 1]
            bad = [v[rule] for t, q, v in held if t == s and q == 0]
            best = 0
            for cut in sorted(cuts, reverse=True):  # a higher cutoff rejects less
                k, n = sum(x > cut for x in good), len(good)
                p = 1.0 if k >= n * alpha else sum(comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1))
                if p > delta / (len(strata) * len(quality.RULES)):
                    break
                gain = sum(x > cut for x in bad) - good_cost * k
                if gain > best:
                    best, out[s, rule] = gain, cut
    return out


def test_cutoffs_are_tested_from_the_loose_end(spark):
    # the strictest cutoff rejects 30 of 900 good texts; the looser ones none
    plain, some, junk = "word " * 100, "word " * 55 + "word# " * 45, "word### " * 100
    texts = [plain] * 870 + [some] * 30 + [junk] * 40
    share = [t.count("#") / 100 for t in texts]
    marks = [(i, int(i < 900)) for i in range(len(texts))]
    # only symbols differ; distinct words keep the base rules quiet
    own = [" ".join(f"{w.replace('word', 'w')}{j}" for j, w in enumerate(t.split())) for t in texts]
    docs = table(spark, [(i, t, "en") for i, t in enumerate(own)])
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    held = [("en", q, {r: share[i] if r == "symbols_per_word" else 0.0 for r in quality.RULES}) for i, q in marks]
    want = _cutoffs_by_hand(held, 0.01, 0.05, 10.0)
    assert want == {("en", "symbols_per_word"): 2.0}  # 3.0 catches nothing; the looser of equal ones
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert got == {i: share[i] <= 2.0 for i in range(len(texts))}
    f = quality.features(docs).withColumn("levels", quality.levels()).join(labels, "doc_id")
    allowed = {r["stratum"]: r["allowed"] for r in quality.cutoffs(f, 0.01, 0.05, 10.0).collect()}
    assert allowed == {"en": {"symbols_per_word": 6}}  # a kept row may lie above 0.4, 0.5, 0.6, 0.8, 1.0 and 1.5


def test_few_labels_certify_nothing(spark):
    docs, labels = _labelled(spark, 60)
    got = quality.judge(docs, labels).filter("not base_failed and not kept").count()
    assert got == 0
    assert quality.judge(docs.limit(0), labels).collect() == []
    assert quality.judge(docs, labels.limit(0)).filter("kept").count() == 61


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 10), (1, 200), (3, 500), (30, 1000), (0, 100_000), (900, 100_000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))
    for r in df.collect():
        k, n = r["k"], r["n"]
        if k >= n * 0.01:
            assert r["p"] == 1.0
        elif n <= 1000:
            want = sum(comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1))
            assert r["p"] == pytest.approx(want, rel=1e-9)
        else:
            assert 0 <= r["p"] < 0.01


def test_order_and_ties_of_cutoffs_decide_alike_in_spark_and_sql(spark):
    """The strictest cutoffs fail and looser ones certify; cutoffs that catch alike: the loosest is taken."""
    import duckdb

    from logweave.llm import queries

    rows, marks = [], []
    body = " ".join(f"word{j}" for j in range(100))
    for i in range(1500):
        # 90 of the good texts lie above the two strictest cutoffs of bangs (0.3, 0.4 a word): over 1 %
        rows.append((i, body + "!" * (45 if i % 16 == 0 else 0), "en"))
        marks.append((i, 1))
    for i in range(1500, 1560):
        rows.append((i, body + "!" * (90 if i % 2 else 250), "en"))  # 0.9 and 2.5 a word
        marks.append((i, 0))
    rows += [(2000 + i, body + "!" * n, "en") for i, n in enumerate((35, 55, 65, 85, 150, 250))] + [(2100, body + "!" * 400, "xx"), (2101, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    # 0.8 catches all bad texts as 0.6 and 0.5 do, and is the loosest of them
    assert [got[2000 + i] for i in range(6)] == [True, True, True, False, False, False] and got[2100] and not got[2101]
    assert not any(got[i] for i in range(1500, 1560)) and all(got[i] for i in range(1500))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    con.execute("create table labels as select unnest(?) as doc_id, unnest(?) as quality", [[m[0] for m in marks], [m[1] for m in marks]])
    assert dict(con.execute(f"select doc_id, kept from ({queries.OP8})").fetchall()) == got
