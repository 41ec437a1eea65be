import random

from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import decontam

from .helpers import hard_rows, prose, table


def _nearest(pattern, text):
    """Smallest edit distance of ``pattern`` to a substring, by the textbook table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=100))
def test_myers_equals_the_table(pattern, text):
    assert decontam.myers(decontam.peq(pattern), len(pattern), text)[0] == _nearest(pattern, text)


def _edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        rng.choice([lambda: s.__setitem__(i, "q"), lambda: s.insert(i, "q"), lambda: s.pop(i)])()
    return "".join(s)


def test_matcher_equals_brute_force():
    rng = random.Random(1)
    items = [(i, prose(rng, rng.randrange(7, 30), 50)) for i in range(12)] + [(20, "short one"), (21, ""), (22, None), (20, "short one")]
    m = decontam.Matcher(items, 0.1, 32, least=5)
    for n in range(60):
        text = prose(rng, 40, 50)
        if n % 2:
            item = rng.choice(items[:12])[1]
            text += " " + _edited(rng, item, rng.randrange(0, len(item) // 7)).upper() + "\n " + prose(rng, 10, 50)
        norm = decontam.normalise(text)
        want = sorted(i.item_id for i in m.items if _nearest(i.text, norm) <= i.budget)
        got = m.find(text)
        assert sorted(h[0] for h in got) == want
        by = {i.item_id: i.text for i in m.items}
        assert all(h[3] == _nearest(by[h[0]], norm) for h in got)


def test_report_and_clean_documents(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_BYTES", 300)  # several passes
    rng = random.Random(2)
    items = [(i, prose(rng, 25)) for i in range(6)] + [(9, None), (None, prose(rng, 25)), (10, "")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    rows = hard_rows(rng) + [(100, "before " + items[0][1] + " after " + items[3][1]), (101, items[7][1]), (102, _edited(rng, items[1][1], 5)), (102, prose(rng, 80))]
    docs = table(spark, rows)
    assert sum(1 for _ in decontam.matchers(bench, 0.1, 32, 16)) > 1
    got = decontam.report(docs, bench).collect()
    assert len(got) == len(rows)
    bad = sorted((r["doc_id"], r["item_ids"]) for r in got if r["contaminated"])
    assert bad == [(100, [0, 3]), (101, [None]), (102, [1])]
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 3
    assert decontam.report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.report(docs.limit(0), bench).collect() == []


def test_short_items_stand_between_word_edges():
    items = [(1, "art"), (2, "A"), (3, "yes"), (4, "the answer is 42"), (5, "( a + b ) = c ok"), (6, "a" * 40)]
    m = decontam.Matcher(items, 0.1, 32)
    assert [i.item_id for i in m.items] == [4, 5, 6]
    ids = lambda text: [h[0] for h in m.find(text)]
    assert ids("We went to the party yesterday") == [] and ids("The  answer is 42.") == [4]
    assert ids("breathe answer is 42") == ids("the answer is 425") == []
    assert ids("the answer is 421, the answer is 42!") == [4]  # the first place does not count, the second does
    assert ids("x( a + b ) = c ok") == [5] and ids("( a + b ) = c okay") == []
    at = m.find("the answer is 421, the answer is 42!")[0]
    assert at[1:] == (19, 35, 0)
    assert [h[0] for h in decontam.Matcher(items, 0.1, 32, least=1).find("this is art, yes")] == [1, 3]
