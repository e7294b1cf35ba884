"""Token files, packing and token counts against the libraries."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from wayfold.llm import queries
from wayfold.llm.bpe_count import token_counts
from wayfold.llm.packing import pack
from wayfold.llm.token_files import read_tokens, token_output, write_tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))


def ids_of(library, text, end):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_generations_of_the_memo_keep_the_ids(library, monkeypatch):
    from wayfold.llm import bpe_encode

    monkeypatch.setattr(bpe_encode, "MEMO_LIMIT", 3)
    own = bpe_encode.ByteBpe(queries.tokenizer_path(queries.BYTE_BPE))
    texts = ["one two one three four one two five", "nine one nine", "x" * 200 + " one", "caf\u00e9 \u2026 \u00b2", "\u65e5\u672c one", "a <|endoftext|> b", "tab\x0b\xa0", ""]
    for text in texts * 2:
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(own.memo) <= 3 and len(own.memo.before) <= 3
    assert all(len(k) <= bpe_encode.LONGEST for k in [*own.memo, *own.memo.before])


def key(x):
    return (x is not None, x or 0)


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_token_files_hold_the_librarys_ids(docs, table, library, which):
    frame = docs if which == "fixture" else table("documents")
    rows = sorted(((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=lambda r: (key(r[0]), (r[1] is not None, r[1] or "")))
    at, want = 0, []
    for d, t in rows:
        x = ids_of(library, t, 0)
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    found = token_output(frame, queries.tokenizer_path(queries.BYTE_BPE), end_id=0).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want


def test_token_files_are_dictionary_coded_with_page_indexes(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = write_tokens(docs, queries.tokenizer_path(queries.BYTE_BPE), 0)
    files = [pq.ParquetFile(f) for f in glob.glob(path.removeprefix("file:") + "/*.parquet")]
    columns = [f.metadata.row_group(0).column(i) for f in files if f.metadata.num_row_groups for i in range(f.metadata.num_columns)]
    assert columns and all(c.has_offset_index for c in columns)
    assert any("RLE_DICTIONARY" in c.encodings for c in columns if c.path_in_schema.startswith("tokens"))
    plan = read_tokens(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_packing_covers_every_id_once(docs, table, library, which):
    frame = docs if which == "fixture" else table("documents")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    found = pack(frame, queries.tokenizer_path(queries.BYTE_BPE), end_id=1, length=2048).collect()
    total = sum(len(ids_of(library, t, 1)) for _, t in rows)
    assert sum(r.length for r in found) == total
    by_seq: dict = {}
    for r in found:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_seq) == list(range(-(-total // 2048)))
    for k, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or k == max(by_seq)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(ids_of(library, t, 1))
    by_doc: dict = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, pieces in by_doc.items():
        if len(ids[d]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids[d][0]))
                assert p.ids_crc32 == zlib.crc32(ids[d][0][at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids[d][0])
    assert by_doc.keys() == ids.keys()


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_token_counts_equal_the_librarys(docs, table, which):
    import sentencepiece

    path = queries.tokenizer_path(queries.PIECE_BPE)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    frame = docs if which == "fixture" else table("documents")
    rows = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
    want = [(d, len(t.encode()), n := len(sp.encode(t)), n > 4096) for d, t in rows]
    order = lambda r: (key(r[0]), r[1:])
    assert sorted(map(tuple, token_counts(frame, path, 4096).collect()), key=order) == sorted(want, key=order)


def test_empty_tables(empty):
    assert token_output(empty, queries.tokenizer_path(queries.BYTE_BPE)).count() == 0
    assert pack(empty, queries.tokenizer_path(queries.BYTE_BPE)).count() == 0
    assert token_counts(empty, queries.tokenizer_path(queries.PIECE_BPE)).count() == 0
