"""Rank-file BPE against the library: boundaries, ids, decoding, edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import queries, rank_bpe
from wayfold.llm.rank_bpe import RankBpe, decoded, encoded, round_trip, scan, starts


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path(queries.RANK_BPE)


@pytest.fixture(scope="module")
def own(path):
    return RankBpe(path)


@pytest.fixture(scope="module")
def library(own):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})


def texts():
    rng = random.Random(11)
    parts = ["'", "'s", "'re", "'ve", "'ll", "'LL", "'d", "'t", "'m", *"srelv aZé漢1٣½!-😀́\r\n\t 　\x00", "  ", "word", "don't", "<|endoftext|>"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)]
    wild = ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(5)) + rng.choice(parts) for _ in range(3000)]
    return [*some, *wild, "", None, " ", "\n", "'", " " * 3000, "a" * 50_000, "'" * 700, "ab" * 300, "é" * 400, "1" * 1000, "x​y", "end \n\n", "'r", "'l", "a'", " 's"]


def test_equals_library_and_decodes(own, library):
    given = texts()
    got = list(own.encode(pa.array(given, pa.string())))
    assert [x.tolist() for x in got] == [library.encode_ordinary(t or "") for t in given]
    assert [b"".join(p.tobytes() for p in own.decode(x, own.offsets(x))) for x in got] == [(t or "").encode() for t in given]


def test_a_scan_in_parts_equals_one_step_at_a_time():
    rng = np.random.default_rng(1)
    symbol = rng.integers(0, 9, 1000).astype(np.uint8)
    state, plain = 0, []
    for s in symbol:
        plain.append(state)
        state = int(rank_bpe.AFTER[int(s) * 8 + state])
    assert [scan(symbol, 0)[0].tolist(), scan(symbol, 0)[1]] == [plain, state]
    left, middle = scan(symbol[:333], 0)
    right, end = scan(symbol[333:], middle)
    assert [*left, *right] == plain and end == state


def test_segments_and_neighbouring_texts_do_not_matter(own, monkeypatch):
    given = [t or "" for t in texts()]
    data = "".join(given).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in given)])
    begin, first = starts(np.frombuffer(data, np.uint8), offsets, own.classes)
    monkeypatch.setattr(rank_bpe, "SEGMENT", 1000)
    again, _ = starts(np.frombuffer(data, np.uint8), offsets, own.classes)
    assert begin.tolist() == again.tolist()
    for k in range(0, len(given), 37):
        alone, _ = starts(np.frombuffer(given[k].encode(), np.uint8), np.array([0, len(given[k].encode())]), own.classes)
        assert (begin[first[k] : first[k + 1]] - offsets[k]).tolist() == alone.tolist()


def test_short_and_long_merging_agree(own):
    rng = random.Random(2)
    for _ in range(500):
        word = "".join(rng.choice("abcdeé漢 ") for _ in range(rng.randrange(2, 60))).encode()
        assert own._merged_short(word) == own._merged_long(word)


def test_the_memo_is_bounded(own, monkeypatch):
    monkeypatch.setattr(rank_bpe, "MEMO_ENTRIES", 10)
    own.memo.clear()
    list(own.encode(pa.array([" ".join(f"word{i}" for i in range(300)), "y" * 1000])))
    assert len(own.memo) <= 10 and all(len(w) <= rank_bpe.SHORT for w in own.memo)


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_query(spark, sf_dir, docs, table, library, path, which):
    frame = docs if which == "fixture" else table("documents")
    got = (round_trip(frame, path) if which == "fixture" else queries.op13_byte_bpe(spark, sf_dir)).collect()
    want = []
    for r in frame.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_token_lists_keep_offsets_and_decode(spark, docs, library, path):
    tokens = encoded(docs, path)
    rows = {(r.doc_id, tuple(r.tokens)): r.offsets for r in tokens.collect()}
    for d, t in [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]:
        ids = library.encode_ordinary(t)
        ends = np.cumsum([0, *(len(library.decode_single_token_bytes(i)) for i in ids)])
        assert rows[d, tuple(ids)] == ends[:-1].tolist()
    back = sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.data)) for r in decoded(tokens, path).collect())
    assert back == sorted((r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())


def test_empty(empty, path):
    assert round_trip(empty, path).collect() == [] and encoded(empty, path).collect() == []
