import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logweave.llm import tokenbin, warc

from .helpers import hard_rows, prose, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


# ── token files ────────────────────────────────────────────────────────────
@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def _ids(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", "'s", "don't", "1", "42", ",", "...", " ", "  ", "\n", "\t", "\x85", "\x1c", " ", "é", "用户", "😀", "<|endoftext|>", "|", "#x"]), max_size=12).map("".join))
def test_encoding_in_parts_equals_the_tokenizer(tok, text):
    enc = tokenbin.encoder(PATH)
    assert enc.encode(text) == _ids(tok, text).tobytes()


def test_encoder_forgets_and_still_agrees(tok):
    enc, rng = tokenbin.ChunkEncoder(PATH, limit=20), random.Random(1)
    for _ in range(30):
        text = prose(rng, 30).replace(" w1", ",\nw1")
        assert enc.encode(text) == _ids(tok, text).tobytes()


def test_other_tokenizers_are_used_whole(tok):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some Words,  and more\nlines"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenbin.ChunkEncoder(path).encode(text), "<u4").tolist() == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**62), 2**62)), st.integers(0, 400)), max_size=6), st.integers(0, 2**32 - 1))
def test_file_round_trip(docs, seed):
    counts = [n for _, n in docs]
    ids = np.random.default_rng(seed).integers(0, 2**32, sum(counts), dtype=np.uint32)
    data = tokenbin.pack(ids, [d for d, _ in docs], counts)
    keys, got = tokenbin.read_docs(data)
    assert keys == [d for d, _ in docs] and got.tolist() == counts
    blocks = -(-len(ids) // tokenbin.BLOCK_IDS)
    back = [tokenbin.read_block(data, b) for b in range(blocks)]
    assert (np.concatenate(back) if back else ids[:0]).tolist() == ids.tolist()


def test_blocks_are_read_alone():
    ids = np.arange(200_000, dtype=np.uint32) % 50_000
    data = tokenbin.pack(ids, [1], [len(ids)])
    assert (tokenbin.read_block(data, 2) == ids[131_072:196_608]).all() and len(tokenbin.read_block(data, 3)) == 200_000 - 196_608
    assert len(data) < ids.nbytes / 4
    with pytest.raises(ValueError):
        tokenbin.read_docs(b"x" * 100)


def test_token_files(spark, tok, monkeypatch):
    monkeypatch.setattr(tokenbin, "FILE_IDS", 500)
    rows = hard_rows(random.Random(2))
    got = tokenbin.token_files(table(spark, rows), PATH).collect()
    assert len(got) == len(rows)
    want = sorted(((d is not None, d or 0), zlib.crc32(np.append(_ids(tok, t), [2]).astype("<u4").tobytes()), len(_ids(tok, t)) + 1) for d, t in rows)
    mine = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["ids_crc32"], r["n_tokens"]) for r in got)
    assert mine == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert tokenbin.token_files(table(spark, []).limit(0), PATH).collect() == []


# ── archives ───────────────────────────────────────────────────────────────
def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y", "z") for r in rows], "page_id long, url string, html string, payload string, data binary, bundle string")


def test_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 400)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1500)
    big, rng = "<p>" + "é" * 100, random.Random(3)
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else prose(rng, rng.randrange(0, 60))) for i in range(5, 60)]
    rows += [(1, None, big), (1, "http://h/1", big), (2, "a\r\nb", "short"), (3, "u", "short"), (4, "u", None), (None, "u", big), (None, None, None), (70, "u", "WARC/1.1\r\n\r\n" * 20)]
    pages = _pages(spark, rows)
    bundles = warc.write_bundles(pages)
    got = sorted((tuple(r) for r in warc.read_bundles(bundles).collect()), key=repr)
    least = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            least[h] = min(least.get(h, p), p)
    want = []
    for p, _, h in rows:
        body, first = (h or "").encode(), least.get(h)
        again = first is not None and p != first
        want.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    # any record by its place, decompressing its frame alone
    data = {r["bundle"]: r["data"] for r in bundles.collect()}
    places = warc.record_map(bundles).collect()
    assert len(places) == len(rows) and len(data) > 1
    for r in places:
        head, payload = warc.read_at(data[r["bundle"]], r["frame"], r["offset"], r["length"])
        assert head["WARC-Record-ID"] == r["record"]
        if head["WARC-Type"] == "response":
            assert hashlib.sha256(payload).hexdigest() == head["WARC-Payload-Digest"].removeprefix("sha256:")
    assert warc.archive(pages.limit(0)).collect() == []


def test_bundle_is_a_plain_zstd_stream():
    import io

    import zstandard

    w = warc.BundleWriter()
    for i in range(5):
        w.add(warc.record_id(i), b"record %d" % i)
        w._frame()
    data, _ = w.close()
    frames = warc.seek_table(data)
    assert [warc.read_frame(data, f) for f in frames] == [b"record %d" % i for i in range(5)]
    end = frames[-1][0] + frames[-1][1]
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data[:end]), read_across_frames=True) as r:
        assert r.read() == b"".join(b"record %d" % i for i in range(5))
