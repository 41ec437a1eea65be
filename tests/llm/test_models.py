import math
import random

import numpy as np

from logweave.llm import langid, toxicity

from .helpers import hard_rows, prose, table

LANGS = {"xx": "ka lu mi to re", "yy": "bra fli gno stu vex", "zz": "éa öu ñi çe ßo"}


def _text(rng, lang, n=40):
    parts = LANGS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_grams_equal_a_plain_count():
    texts = ["Ab c", None, "", "...", "éa1b", "a" * 300]
    parts, letters = langid.grams(texts, 1 << 16)
    alone = [langid.grams([t], 1 << 16)[0] for t in texts]
    assert letters.tolist() == [True, False, False, False, True, True]
    for order, (ids, starts) in enumerate(parts, 1):
        segments = np.split(ids, starts[1:])
        for text, seg in zip(texts, segments):
            words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
            n = 0
            for w in words:  # grams of a word with an edge on either side
                n += len(w) if order == 1 else len(w) + 1 if order == 2 else len(w)
            assert int((seg < 1 << 16).sum()) == n, (order, text)


def test_language_is_learned_and_held_out_rows_are_not_used(spark):
    rng = random.Random(1)
    rows = [(i, _text(rng, lang), lang, "s") for i in range(300) for lang in [rng.choice(list(LANGS))]]
    rows += [(1000, None, "xx"), (1001, "123 ...", "xx"), (1002, "", None), (None, _text(rng, "yy"), None), (1, _text(rng, "zz"), None), (1003, _text(rng, "xx", 50_000), None)]
    docs = table(spark, rows)
    got = [r.asDict() for r in langid.identify(docs).collect()]
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, *_ in rows if lang and i < 1000 and i != 1}
    assert all(g["lang_pred"] == truth[g["doc_id"]] and 0.5 < g["score"] <= 1 for g in got if g["doc_id"] in truth)
    by = {g["doc_id"]: g for g in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0
    assert by[None]["lang_pred"] == "yy" and by[1003]["lang_pred"] == "xx"
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    twisted = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"], r["score"])
    assert sorted(map(key, got)) == sorted(key(r) for r in langid.identify(twisted).collect())


def _plain_grams(text, buckets):
    """Bucket of every n-gram, from the rule: words of letters with an edge on either side, each n-gram with a letter in its middle."""
    edge, mult, m32 = 32, [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], 0xFFFFFFFF
    out = []
    low = (text or "").lower()
    for word in "".join(c if c.isalpha() else " " for c in low).split():
        cps = [edge, *map(ord, word), edge]
        for order in (1, 2, 3):
            for i in range(len(cps) - order + 1):
                g = cps[i : i + order]
                if (order == 1 and g[0] == edge) or (order == 2 and g == [edge, edge]):
                    continue
                h = sum(c * k for c, k in zip(g, mult)) + order & m32
                h = (h ^ h >> 15) * 0x2C1B3C6D & m32
                out.append((h ^ h >> 13) % buckets)
    return out


def test_posterior_equals_a_plain_naive_bayes(spark):
    """Counts, smoothing, log-probabilities and tempered posterior against a count in dictionaries."""
    rng = random.Random(11)
    rows = [(i, _text(rng, lang, rng.randrange(1, 30)) + rng.choice(["", " 9!", "\nÄx"]), lang) for i in range(120) for lang in [rng.choice(list(LANGS))]]
    rows += [(500, "ka bra éa", None), (501, None, "xx"), (502, "...", "yy"), (503, "k", None)]
    got = {r["doc_id"]: r for r in langid.identify(table(spark, rows)).collect()}
    counts = {lang: np.zeros(langid.BUCKETS) for lang in LANGS}
    for i, text, lang in rows:
        if lang and text is not None and not got[i]["held_out"]:
            np.add.at(counts[lang], _plain_grams(text, langid.BUCKETS), 1)
    labels = sorted(lang for lang in counts)
    logs = {lang: np.log((c + 0.5) / (c + 0.5).sum()) for lang, c in counts.items()}
    for i, text, _ in rows:
        ids = _plain_grams(text, langid.BUCKETS)
        if not ids:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        total = np.array([logs[lang][ids].sum() for lang in labels])
        p = np.exp((total - total.max()) / max(1.0, len(ids) / 100))
        assert got[i]["lang_pred"] == labels[int(total.argmax())]
        assert abs(got[i]["score"] - (p / p.sum()).max()) < 1e-4
    assert len({r["lang_pred"] for r in got.values()}) == 4


def test_language_of_nothing_learned(spark):
    rows = hard_rows(random.Random(2))
    got = langid.identify(table(spark, rows)).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == {"und"}
    assert langid.identify(table(spark, []).limit(0)).collect() == []


def test_folding():
    assert toxicity.fold("M0r0n! іdіоt 2024 $tup1d ＩＤＩＯＴ") == " moron idiot stupid idiot "
    assert toxicity.fold(None) == "  " and toxicity.fold("12 34") == "  "


def test_hits_take_the_strongest_entry_and_spare_exceptions():
    lex = toxicity.Lexicon({"trash": 3.0, "trash*": 2.0, "foul*": 2.5}, ["trash collection"])
    assert lex.hits(toxicity.fold("trash collection")) == {}
    assert sorted(lex.hits(toxicity.fold("trash, foulest trash")).values()) == [2.5, 3.0, 3.0]
    assert toxicity.Lexicon({}).hits(" a ") == {}


def test_toxicity_is_learned(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(rng, 60).replace("w0", "k").replace("w", "v").translate(str.maketrans("0123456789", "abcdefghij")).split()
        if bad:
            for p in range(0, 60, 12):
                words[p] = rng.choice(["grubble", "snark" + rng.choice("abcdef"), "p1ffle"])
        elif i % 7 == 0:
            words[5:7] = ["grubble", "soup"]  # a harmless phrase
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "grubble snarka piffle grubble"), (1002, "grubble soup " * 30), (1002, "grubble soup " * 30)]
    docs, labels = table(spark, rows), spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, toxic int")
    got = [r.asDict() for r in toxicity.detect(docs, labels).collect()]
    assert len(got) == len(rows)
    by = {g["doc_id"]: g for g in got}
    held = [i for i in range(400) if by[i]["held_out"]]
    assert np.mean([by[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    assert by[1000]["predicted"] == by[1001]["predicted"] == by[1002]["predicted"] == 0 and by[None]["predicted"] == 1
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.7) for g in got)


def test_toxicity_learns_a_long_tail(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    plain, slurs = [word(7) for _ in range(1500)], [word(8) for _ in range(150)]
    rows, marks = [], []
    for i in range(9900):
        bad = i % 11 == 0  # 900 toxic texts; a slur stands in 12 of them, under 2 %
        words = rng.choices(plain, k=10)
        if bad:
            j = i // 11
            words[3], words[7] = slurs[j % 150], slurs[(j + 1 + j // 150) % 150]
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = table(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert len(lexicon.entries.keys() & set(slurs)) > 120
    got = toxicity.predict(docs, lexicon).filter("held_out").collect()
    assert np.mean([r["predicted"] for r in got if r["doc_id"] % 11 == 0]) > 0.9
    assert np.mean([r["predicted"] for r in got if r["doc_id"] % 11]) < 0.02
    # common words of both classes are no entries
    assert all(any(w.startswith(e.rstrip("*")) for w in slurs) for e in lexicon.entries)


def test_toxicity_without_two_classes(spark):
    docs = table(spark, hard_rows(random.Random(4)))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.detect(docs, none).collect()} == {0}
    assert toxicity.detect(docs.limit(0), none).collect() == []


def test_lexicon_equals_a_plain_count(spark):
    """Weights, chances, exceptions and scores against counts in dictionaries; the curve is where the penalised likelihood is flat."""
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [rng.choice(["alpha", "bravo", "carol", "delta", "echoes", "foxes"]) for _ in range(rng.randrange(5, 25))]
        if bad and i % 3:
            words += ["snarkle" + rng.choice("abc")] * rng.randrange(1, 4)
        elif not bad and i % 37 == 0:
            words[1:3] = ["snarklea", "pie"]  # a harmless phrase around an entry
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = table(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    lex = toxicity.learn(docs, labels)
    picked = toxicity.sample_labels(labels, 10_000)
    text = dict(rows)

    def lexicon(halves):
        mine = [(toxicity.tokens(toxicity.fold(text[d])), t) for d, t, h in picked if h in halves]
        pos, neg = sum(t for _, t in mine), sum(1 - t for _, t in mine)
        out = {}
        for token in set().union(*(w for w, _ in mine)):
            k, c = sum(token in w for w, t in mine if t), sum(token in w for w, t in mine if not t)
            weight = np.log((k + 0.5) / (pos + 1)) - np.log((c + 0.5) / (neg + 1))
            share = pos / (pos + neg)
            luck = sum(math.comb(k + c, i) * share**i * (1 - share) ** (k + c - i) for i in range(k, k + c + 1))
            if k > len(halves) and weight >= 2.0 and luck <= 1e-4:
                out[token] = weight
        return out

    want = lexicon((0, 1))
    assert lex.entries.keys() == want.keys() and all(abs(lex.entries[t] - w) < 1e-9 for t, w in want.items()) and want
    assert "snarklea pie" in lex.exceptions and all("snarklea" in e for e in lex.exceptions)

    def features(entries, t):
        words = toxicity.fold(t).split()
        pairs = [f"{a} {b}" in lex.exceptions for a, b in zip(words, words[1:])] + [False]
        spared = [p or (i > 0 and pairs[i - 1]) for i, p in enumerate(pairs)]
        hits = [max([entries.get(w, 0), *(entries.get(w[:n] + "*", 0) for n in toxicity.STEMS if len(w) > n)]) for w in words]
        hits = [h for h, s in zip(hits, spared) if h and not s]
        if not hits:
            return 0.0, 0.0, 0.0
        return max(hits), math.log1p(sum(hits)), math.log1p(100 * sum(hits) / max(20, len(words)))

    for _, t in rows[:120]:
        assert np.allclose(lex.features(t), features(lex.entries, t))
        z = lex.curve[0] + np.dot(lex.curve[1:], features(lex.entries, t))
        assert abs(lex.score(t) - 1 / (1 + math.exp(-z))) < 1e-9
    other = [lexicon((1 - h,)) for h in (0, 1)]
    x = np.array([features(other[h], text[d]) for d, _, h in picked])
    y = np.array([t for _, t, _ in picked], float)
    w = np.array(lex.curve)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    slope = x.T @ (y - p) - 0.5 * w[1:]
    assert abs((y - p).sum() - 1e-3 * w[0]) < 1e-4 and (w[1:] >= 0).all()
    assert all(abs(s) < 1e-4 for s, v in zip(slope, w[1:]) if v > 0)
