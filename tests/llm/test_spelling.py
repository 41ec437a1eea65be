import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from logweave.llm import spelling
from tests.llm.helpers import hard_rows, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def result(spark, rows):
    got = spelling.group(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len({r["word"] for r in got})
    return {tuple(r) for r in got}


def variants(rng, word):
    k, c = rng.randrange(len(word)), rng.choice("abeiorsté÷")
    return rng.choice([word[:k] + c + word[k + 1 :], word[:k] + word[k + 1 :], word[:k] + c + word[k:]])


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("abeiorst") for _ in range(rng.randrange(7, 14))) for _ in range(25)]
    rows = []
    for doc in range(60):
        words = []
        for w in bases:
            words += [w.upper() if rng.random() < 0.2 else w] * rng.randrange(5)
            if rng.random() < 0.7:
                words += [variants(rng, w)] * rng.randrange(1, 3)
        rows.append((doc, " ".join(words) + ", été_naïveté×naïveté 1naiveté"))
    want = brute(rows)
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)
    assert result(spark, rows) == want


def test_forms_chain_to_the_last(spark):
    words = {"abcdefgh": 2, "abcdefgx": 40, "abcdefyx": 800}
    rows = [(i, " ".join(w for w, n in words.items() for _ in range(n // 2))) for i in (1, 2)]
    got = {r[0]: r for r in result(spark, rows)}
    assert brute(rows) == set(got.values())
    assert got["abcdefgh"][1:3] == ("abcdefgx", "abcdefyx") and got["abcdefyx"][1:3] == (None, "abcdefyx")


def test_ties_repeats_nulls_and_long_words(spark):
    giant = "ab" * 4000
    rows = [(1, "wordone " * 30 + "wordons " * 30), (1, "wordonx wordonx"), (None, "wordonx"), (None, None), (2, ""), (3, " \t"),
            (4, giant), (5, giant), (6, giant + "a"), (6, giant + "a"), (7, "ÀÉÎÕÜÿþ ÀÉÎÕÜÿþ àéîõüÿþ àéîõüÿþ")]
    rows += hard_rows(random.Random(5))
    assert result(spark, rows) == brute(rows)


def test_no_documents(spark):
    assert result(spark, []) == set()


def test_block_products_find_every_near_pair(monkeypatch, spark):
    """Cells of many blocks: every pair of blocks is compared once."""
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", 40)
    rng = random.Random(9)
    words = list({"".join(rng.choice("aab") for _ in range(rng.randrange(7, 10))) for _ in range(250)})
    rows = [(i, " ".join(words)) for i in (1, 2, 3)]
    assert result(spark, rows) == brute(rows)


def test_near_pairs_of_two_blocks():
    a, b = spelling._codes("kitchen mitchen chicken"), spelling._codes("kitchens mitcheen")
    i, j = spelling.near_pairs(a, b, False)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 0), (1, 1)}
    i, j = spelling.near_pairs(a, a, True)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 1)}
    assert a[1].dtype == np.float32


def test_one_more_group_for_a_fourfold_vocabulary(spark):
    vocab = spark.createDataFrame([("abcdefg", 2), ("abcdefh", 3)], "word string, n long")
    assert [len(spelling.letter_groups(vocab, n)) for n in (0, 1 << 18, 1 << 20, 1 << 24)] == [5, 5, 6, 8]
    groups = defaultdict(int)
    for g in spelling.letter_groups(vocab, 2):
        for letter in g:
            groups[letter] += 1
    assert dict(groups) == {c: 1 for c in "abcdefgh"}
