import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from logweave.llm import align
from tests.llm.helpers import hard_rows, table

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
HARD = [
    "", " ", "  two  spaces  ", "a\n b\r\n\n c \n \n d\t e ", "<|endoftext|> <s> </s> <unk>", "mark \u2581 inside", "\u2581",
    "用户 登录 émigré naïve ﬁ ½ 👩‍👩‍👧 \x00 \x1c x", "it 's don't  's", "x" * 3000, "\u3000wide \u00a0 hard", "\ud7ff\u2028 line",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(tokenizers, ids_a, ids_b):
    a, b = tokenizers
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in shown}
    for i, c in enumerate(c for c in range(256) if c not in shown):
        letters[chr(256 + i)] = c
    out_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    out_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
    return out_a, out_b


def brute(tokenizers, texts):
    """Links and groups by walking the two cuts byte by byte, counts over all texts."""
    every, rows = Counter(), []
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids_a = tokenizers[0].encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = tokenizers[1].encode(text) if text else []
        bytes_a, bytes_b = token_bytes(tokenizers, ids_a, ids_b)
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rows.append(([], [], "", []))
            continue
        owner_a = [i for i, t in enumerate(bytes_a) for _ in t]
        owner_b = [i for i, t in enumerate(bytes_b) for _ in t]
        links = sorted(set(zip(owner_a, owner_b)))
        cuts_a, cuts_b = set(np.cumsum([len(t) for t in bytes_a]).tolist()), set(np.cumsum([len(t) for t in bytes_b]).tolist())
        written, at = [], 0
        for cut in sorted(cuts_a & cuts_b):
            in_a = sorted({owner_a[k] for k in range(at, cut)})
            in_b = sorted({owner_b[k] for k in range(at, cut)})
            written.append(",".join(str(ids_a[i]) for i in in_a) + "|" + ",".join(str(ids_b[i]) for i in in_b))
            at = cut
        ids = [(ids_a[i], ids_b[j]) for i, j in links]
        every.update(ids)
        rows.append((ids_a, ids_b, ";".join(written), ids))
    best = {}
    for (_, b), n in every.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (len(a), len(b), s.count(";") + 1 if s else 0, len(ids), sum(every[p] == best[p[1]] for p in ids), sum(every[p] for p in ids),
         hashlib.sha256(s.encode()).hexdigest() if s else "")
        for a, b, s, ids in rows
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(spark, tokenizers, rows):
    got = align.report(table(spark, rows), A, B).select(COLUMNS).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute(tokenizers, [r[1] for r in rows]))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return want


def test_report_equals_brute_force(spark, tokenizers):
    rng = random.Random(1)
    rows = hard_rows(rng) + [(100 + i, t) for i, t in enumerate(HARD)]
    rows += [(200 + i, " ".join(rng.choice(HARD + ["prose", "unbelievably", "Größe,", "tokenisation."]) for _ in range(12))) for i in range(30)]
    want = check(spark, tokenizers, rows)
    assert any(r[1] == 0 for r in want) and any(0 < r[5] < r[4] for r in want)


def test_whole_texts_and_parts_agree(tokenizers):
    """Random mixes of white space, marks and letters: parts give the ids of the whole text."""
    rng, pair = random.Random(7), align.Pair(A, B, memory=50)
    for _ in range(300):
        text = "".join(rng.choice([" ", " ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "a", "Be", "'s", "9", ".", "ß", "登"]) for _ in range(rng.randrange(1, 30)))
        parts = pair.align([text])[0]
        groups = [g.split("|") for p in parts for g in p[5].decode().split(";")]
        assert [int(i) for g in groups for i in g[0].split(",")] == tokenizers[0].encode(" " + text, add_special_tokens=False).ids
        assert [int(i) for g in groups for i in g[1].split(",")] == tokenizers[1].encode(text)


def test_both_libraries_of_a_vocabulary_agree(tokenizers):
    rng, pair = random.Random(9), align.Pair(A, B)
    assert pair.quick is not None and pair.cut is align._CUT_LINES
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "the", "Ünder", "9", "²", "'s", "--", "%", " ", "\n", "xq", "ÿ", "ing"]) for _ in range(rng.randrange(1, 40)))
        assert pair.quick.encode_ordinary(text) == tokenizers[0].encode(text, add_special_tokens=False).ids
    assert align._by_ranks(public.path("word_bpe_49k.json"), align._byte_letters()) is None


def test_pointer_jumping_labels_the_common_cuts():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.append(np.flatnonzero(rng.random(n - 1) < 0.4) + 1, n)
        b = np.append(np.flatnonzero(rng.random(n - 1) < 0.5) + 1, n)
        cuts = np.intersect1d(a, b)
        got_a, got_b = align.components(a, b)
        assert got_a.tolist() == np.searchsorted(cuts, a).tolist() and got_b.tolist() == np.searchsorted(cuts, b).tolist()
        i, j = align.overlaps(a, b)
        assert len(i) == len(a) + len(b) - len(cuts)


def test_a_chain_of_staggered_tokens_is_one_group():
    n = 1 << 14
    a = np.append(np.arange(1, 2 * n, 2), 2 * n)
    b = np.arange(2, 2 * n + 1, 2)
    got_a, got_b = align.components(a, b)
    assert not got_a.any() and not got_b.any()


def test_groups_of_tokens(spark, tokenizers):
    rows = [(1, "unbelievably Größe"), (2, None), (3, "mark \u2581")]
    got = {r["doc_id"]: r for r in align.align(table(spark, rows), A, B).collect()}
    assert got[1]["a_ids"] == tokenizers[0].encode(" " + rows[0][1], add_special_tokens=False).ids
    assert got[1]["b_ids"] == tokenizers[1].encode(rows[0][1])
    assert got[1]["a_group"][0] == 0 and got[1]["a_group"][-1] == got[1]["b_group"][-1]
    assert got[2]["a_ids"] == got[3]["b_ids"] == []


def test_no_documents(spark):
    assert align.report(table(spark, []), A, B).count() == 0
