import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import minhash, phrases, repeats, suffix

from .helpers import hard_rows, prose, table


# ── near-duplicates ────────────────────────────────────────────────────────
def _words(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return lower.split()


def _shingles(text, k):
    w = _words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _components(rows, k, percent):
    sets = [_shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (both and 100 * both >= percent * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, t) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least[root(i)], d)
    return [(d, len(s), None if d is None else d if not s else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def _family(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_links_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [prose(rng, 150) for _ in range(30)]
    for base, n, most in ((texts[0], 40, 12), (texts[1], 25, 30), (texts[2], 10, 3)):
        texts += _family(rng, base, n, most)
    texts += [texts[3].upper(), texts[3] + " more", "a b", "A  b", "a b c d", "a b c d"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(100 + o, t) for o, t in zip(order, texts)] + [r for r in hard_rows(rng) if r[0] != 9]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table(spark, rows), k=4).collect()), key=repr)
    assert got == sorted(_components(rows, 4, 80), key=repr)
    kept = minhash.near_duplicates(table(spark, rows), k=4).filter("kept").select("doc_id").distinct().count()
    assert kept == len({c for _, _, c in got})


def test_no_rows_and_rows_without_words(spark):
    assert minhash.near_duplicates(table(spark, []).limit(0)).collect() == []
    got = minhash.near_duplicates(table(spark, [(2, None), (1, ""), (3, " "), (None, None)])).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got) and len(got) == 4


def test_rows_of_one_id_are_one_document(spark):
    a, b = prose(random.Random(2), 50), prose(random.Random(3), 50)
    got = minhash.near_duplicates(table(spark, [(5, a), (5, b), (4, b), (9, a)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 4), (4, 4), (9, 4)}


def test_kept_documents_keep_all_columns(spark):
    docs = table(spark, hard_rows(random.Random(4)))
    out = minhash.kept_documents(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} >= {1, 3, 4, 5, None} and not out.filter("doc_id = 2").count()


def test_signature_similarity_follows_jaccard():
    rng = np.random.default_rng(5)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 200, 200))
    sig = minhash.signatures(np.concatenate([common, a, common, b]), np.array([0, 1000, 2000]))
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 800 / 1200) < 0.15
    assert (minhash.sketches(sig)[:, 0] == minhash.sketches(sig[:, :1])[:, 0]).all()


# ── repeated words ─────────────────────────────────────────────────────────
def _phrase_truth(rows, window):
    at, docs = defaultdict(lambda: (1 << 63, 0)), [(d if d is not None else (1 << 63) - 1, (t or "").encode().split()) for d, t in rows]
    for d, w in docs:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            at[g] = min(at[g], (d, s))
    out = []
    for (d, w), (doc, _) in zip(docs, rows):
        gone = set()
        for s in range(len(w) - window + 1):
            if at[tuple(w[s : s + window])] < (d, s):
                gone |= set(range(s, s + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def _passages(rng, unit, n_docs):
    shared = [prose(rng, rng.randrange(15, 90), 300) for _ in range(4)] + ["a b " * 40]
    rows = []
    for i in range(n_docs):
        parts = [prose(rng, rng.randrange(0, 60)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared).split()
            cut = rng.randrange(0, max(1, len(s) - 5))
            parts.insert(rng.randrange(len(parts)), " ".join(s[cut:]))
        rows.append((rng.randrange(1000), "\n".join(parts)))
    return rows


def test_repeated_words_equal_brute_force(spark):
    rng = random.Random(7)
    rows = list({d: (d, t) for d, t in _passages(rng, "w", 80)}.values()) + hard_rows(rng)
    out = phrases.dedup(table(spark, rows))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()), key=repr)
    assert got == _phrase_truth(rows, 20)
    assert phrases.dedup(table(spark, []).limit(0)).collect() == []


def test_phrase_automaton_finds_overlaps():
    a = phrases.PhraseAutomaton()
    for p in (" x y ", " y x "):
        a.add(p)
    a.compile()
    text, at = phrases.spaced(b"x y x\ty z")
    assert text == " x y x y z " and np.searchsorted(at, a.starts(text)).tolist() == [0, 1, 2]
    assert phrases.PhraseAutomaton().starts("x").tolist() == []


# ── repeated bytes ─────────────────────────────────────────────────────────
def _byte_truth(rows, window):
    least, docs = {}, [(d if d is not None else (1 << 63) - 1, (t or "").encode()) for d, t in rows]
    for d, b in docs:
        for s in range(len(b) - window + 1):
            g = b[s : s + window]
            least[g] = min(least.get(g, 1 << 63), d)
    out = []
    for (d, b), (doc, _) in zip(docs, rows):
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if least[b[s : s + window]] < d:
                gone[s : s + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def _byte_rows(spark, rows):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[c] for c in cols) for r in suffix.dedup(table(spark, rows)).collect()), key=repr)


def test_repeated_bytes_equal_brute_force(spark):
    rng = random.Random(8)
    rows = _passages(rng, "b", 80) + hard_rows(rng) + [(2000, "ab" * 200), (2001, "ab" * 150), (2002, "é" * 40), (1999, "é" * 60)]
    assert _byte_rows(spark, rows) == _byte_truth(rows, 50)


@pytest.mark.parametrize("chunk", [1, 400, 5000])
def test_anchors_that_fill_several_chunks_are_put_together(spark, monkeypatch, chunk):
    """Every anchor may go on in the next chunk or partition: its windows meet by their strings."""
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    rng = random.Random(9)
    common = prose(rng, 14)
    rows = _passages(rng, "b", 40) + [(5000 + i, f"{prose(rng, 3)} {common} {prose(rng, 3)}") for i in range(40)]
    assert _byte_rows(spark, rows) == _byte_truth(rows, 50)
    assert suffix.dedup(table(spark, []).limit(0)).collect() == []


def test_the_automaton_decides_which_units_are_located(monkeypatch):
    """Without its hits nothing is located; a phrase that only shares a confirmed hash is not."""

    level = repeats.words_level(20)
    rng = random.Random(2)
    common = prose(rng, 40)
    texts = [f"{prose(rng, 30)} {common}", f"{common} {prose(rng, 30)}"]
    docs = pa.table({"shard": pa.array([0, 0], pa.int32()), "key": [1, 2], "tie": [0, 0], "text": texts})
    r, _, _ = level.runs(pa.array(texts))
    u, c = np.unique(r.anchor, return_counts=True)
    facts = pa.table({"key": pa.array([None], pa.int64()), "tie": pa.array([None], pa.int64()), "start": pa.array([None], pa.int64()),
                      "end": pa.array([None], pa.int64()), "anchors": pa.array([u[c > 1].tobytes()], pa.binary())})
    found = phrases._located(level, docs, facts)
    assert found.num_rows >= 4 and set(found.column("anchor").to_pylist()) == set(u[c > 1].view(np.int64).tolist())
    with monkeypatch.context() as m:
        m.setattr(phrases.PhraseAutomaton, "starts", lambda self, text: np.zeros(0, np.int64))
        assert phrases._located(level, docs, facts).num_rows == 0
    listed = phrases.phrase_list(level, docs, u[c > 1])
    assert len(listed) == len(u[c > 1]) and all(x in f" {common} " for x in listed)
    with monkeypatch.context() as m:
        m.setattr(phrases, "phrase_list", lambda *a: listed[1:])
        assert len(set(phrases._located(level, docs, facts).column("anchor").to_pylist())) == len(listed) - 1


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=120).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 40))
def test_bucket_pointers_rank_prefixes(data, depth):
    got = suffix.bucket_pointers(np.frombuffer(data, np.uint8), depth)
    keys = [data[i : i + depth] for i in range(len(data))]
    ranks = sorted(keys)
    assert got.tolist() == [ranks.index(k) + 1 for k in keys]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, k):
    h, offs = minhash.shingles(pa.array(texts, pa.string()), k)
    sizes = np.diff(offs).tolist()
    assert sizes == [len(_shingles(t, k)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = set(h[offs[i] : offs[i + 1]].tolist()) & set(h[offs[j] : offs[j + 1]].tolist())
            assert len(same) == len(_shingles(texts[i], k) & _shingles(texts[j], k))


def test_bytes_are_searched_and_refined_in_little_memory():
    """Two tasks and a JVM share an executor: what one chunk and one batch take is bounded."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from logweave.llm import suffix
    from logweave.llm.repeats import bytes_level

    def peak(run) -> float:
        tracemalloc.start()
        try:
            run()
            return tracemalloc.get_traced_memory()[1] / 2**20
        finally:
            tracemalloc.stop()

    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 1 << 20, np.uint8).tobytes()
    bodies = [text[at % 40_000 : at % 40_000 + 64] for at in range(0, suffix.CHUNK_BYTES, 64)]
    ids = np.arange(len(bodies), dtype=np.int64)
    assert peak(lambda: suffix.earlier_windows(bodies, ids, 50)) < 220
    level = bytes_level()
    column = pa.array([text[: level.batch].decode()])
    assert peak(lambda: level.runs(column)) < 40
