"""Long repeats across documents by recompression, and their removal.

A window is `size` consecutive words of one document. A word goes if a window over it has a word sequence
that also starts in a document of smaller doc_id; windows are judged on the input.

1. Recompression. Words are symbols. Runs of one word become one symbol named after the word; then rounds
   join neighbours: each round's hash of a name makes it a left or a right one, and a left symbol takes a
   right neighbour. A name is a 64-bit hash of what it stands for, so it is the same in every task and every
   document with no dictionary to share. Whether two symbols join depends on them alone: inside two equal
   word sequences a round can differ by one symbol at each end. After four rounds that is at most 1 + 1 + 2
   + 4 + 8 = 16 words an end (a run symbol never joins, so behind a run nothing differs), and of 50 equal
   words at least 18 are cut into the same symbols of at most 16 words.
2. Reveal. From each stretch of 18 words that starts at a symbol, its longest symbol (ties by name) is
   posted, and every run of 8 or more. So two equal windows post a symbol in common. Buckets of names find the
   symbols of two or more documents and mark the windows around them.
3. Verify. The marked windows' own 64-bit hashes meet by bucket; all but those of the smallest doc_id are
   repeats.
4. Remove. Repeats go back to their documents, and the words they cover go.

Names need no dictionary, so the rounds run where the words are, and what is global is the naming: the shuffles join
equal names, not rounds. A symbol or window of a third of all documents does not gather in one task: what a chunk of
text (symbols) or a group of documents (windows) shows by itself to repeat is settled there, and only its
smallest document's entry goes to the bucket. Texts are grouped by a hash of their doc_id into groups of about 6 MB, as
many as the table needs.

Nulls and edges: a null or wordless text has no words and the hash of the empty string; a null doc_id
neither loses words nor takes them; repeated rows and equal doc_ids do not take from each other (a smaller
doc_id is needed); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import small_batches, text_chunks, written
from wayfold.llm.words import mix, window_hashes, word_bounds, word_hashes

ROUNDS, LONG_RUN = 4, 8
_A, _B, _RUN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def parse(w: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (hashes) and their documents -> names, starts and lengths of the symbols after the rounds."""
    if not len(w):
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])]))
    length = np.diff(np.append(first, len(w)))
    run = length > 1
    name = np.where(run, mix(w[first] ^ _RUN), w[first])
    start = first
    for j in range(rounds):
        left = (mix(name + np.uint64(j + 1) * _A) & np.uint64(1)).astype(bool)
        joins = left[:-1] & ~left[1:] & ~run[:-1] & ~run[1:] & (doc[start[1:]] == doc[start[:-1]])
        head = np.append(joins, False)
        tail = np.insert(joins, 0, False)
        at = np.flatnonzero(head)
        name = name.copy()
        name[at] = mix(name[at] * _A + mix(name[at + 1]) * _B)
        length = length.copy()
        length[at] += length[at + 1]
        keep = ~tail
        name, start, length, run = name[keep], start[keep], length[keep], run[keep]
    return name, start, length


def selected(name: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Indices of symbols that are the best of some stretch of span words that starts at a symbol."""
    n = len(name)
    if not n:
        return np.zeros(0, np.int64)
    score = (np.minimum(length, 31).astype(np.uint64) << np.uint64(58)) | (name >> np.uint64(6))
    # the last symbol that ends within the stretch and within the document
    last = np.searchsorted(start + length, start + span, side="right") - 1
    own = doc[start]
    final = np.searchsorted(own, own, side="right") - 1
    here = np.arange(n)
    last = np.maximum(np.minimum(last, final), here)
    best, levels = here, [here]
    while (1 << len(levels)) <= span:
        h = 1 << (len(levels) - 1)
        best = levels[-1].copy()
        a, b = best[:-h], levels[-1][h:]
        best[:-h] = np.where(score[b] > score[a], b, a) if h < n else a
        levels.append(best)
    k = np.maximum(np.log2(last - here + 1).astype(np.int64), 0)
    table = np.stack(levels)
    a, b = table[k, here], table[k, last - (1 << k) + 1]
    picked = np.where(score[b] > score[a], b, a)
    return np.unique(np.concatenate([picked, np.flatnonzero(length >= 2 * 16)]))


def _zip(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.diff(x, prepend=x[:1] * 0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel())


def _by(bucket: np.ndarray, arrays: list[np.ndarray], raw: int, names: list[str]) -> pa.RecordBatch:
    """One row per bucket: the first raw arrays as they are (hashes), the others delta-coded."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    at = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own)) if len(own) else np.zeros(1, np.int64)
    spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
    columns = [pa.array(own[at[:-1]].astype(np.int32))]
    for i, x in enumerate(arrays):
        x = x[order]
        code = (lambda y: y.tobytes()) if i < raw else _zip
        columns.append(pa.array([code(x[a:b]) for a, b in spans], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _row_key(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each document's word sequence (63 bits)."""
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * mix(np.arange(1, len(w) + 1, dtype=np.uint64) * _A - np.repeat(first[:-1], np.diff(first)).astype(np.uint64) * _A), out=total[1:])
    return (mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _words_of(column: pa.Array):
    for lo, hi, data, offsets in text_chunks(column):
        starts, ends, first = word_bounds(data, offsets)
        yield lo, hi, word_hashes(data, starts, ends, lower=False), first, data, starts, ends


def reveal(docs: DataFrame, size: int, buckets: int, groups: int) -> DataFrame:
    """Marked stretches of window starts: group, doc (doc_ids), lo, hi (inclusive), packed."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo_row, hi_row, w, first, _, _, _ in _words_of(batch.column(1)):
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                name, start, length = parse(w, doc)
                pick = selected(name, start, length, doc, size - 32)
                more = np.flatnonzero((length >= LONG_RUN) & (w[start] == w[np.minimum(start + 1, max(len(w) - 1, 0))])) if len(w) else pick
                pick = np.union1d(pick, more).astype(np.int64)
                s, m, d = start[pick], length[pick], doc[start[pick]] if len(w) else pick
                at = s - first[d]
                lo = np.maximum(np.where(m >= LONG_RUN, at - size + 1, at + m - size), 0)
                hi = np.minimum(np.where(m >= LONG_RUN, at + m - 1, at), n[d] - size)
                use = hi >= lo
                if use.any():
                    own = ids.slice(lo_row, hi_row - lo_row).to_numpy()[d]
                    key, own, lo, hi = name[pick][use], own[use], lo[use], hi[use]
                    low, high = _ends(key, own)
                    # what this chunk alone shows to be shared is marked here; one document a symbol goes to its bucket
                    told = low < high
                    names = ["bucket", "name", "doc", "lo", "hi"]
                    sent = ~told | (own == low)
                    yield _by((key >> np.uint64(40)).astype(np.int64)[sent] % buckets, [key[sent], own[sent], lo[sent], hi[sent]], 1, names)
                    if told.any():
                        yield _by(-1 - _group(own[told], groups), [key[told] * np.uint64(0), own[told], lo[told], hi[told]], 1, names)

    def shared(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return _settled(table, ["doc", "lo", "hi"])
        name = np.frombuffer(b"".join(table["name"].to_pylist()), np.uint64)
        doc, lo, hi = (np.concatenate([_unzip(x) for x in table[c].to_pylist()]) for c in ("doc", "lo", "hi"))
        order = np.argsort(name, kind="stable")
        name, doc, lo, hi = name[order], doc[order], lo[order], hi[order]
        at = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        many = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
        use = np.repeat(many, np.diff(np.append(at, len(name))))
        doc, lo, hi = doc[use], lo[use], hi[use]
        order = np.argsort(doc, kind="stable")
        doc, lo, hi = doc[order], lo[order], hi[order]
        if not len(doc):
            return pa.table({"grp": pa.array([], pa.int32()), "doc": pa.array([], pa.binary()), "lo": pa.array([], pa.binary()), "hi": pa.array([], pa.binary())})
        return pa.Table.from_batches([_by(_group(doc, groups), [doc, lo, hi], 0, ["grp", "doc", "lo", "hi"])])

    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(posted, "bucket int, name binary, doc binary, lo binary, hi binary")
    return rows.groupBy("bucket").applyInArrow(shared, "grp int, doc binary, lo binary, hi binary")


def _settled(table: pa.Table, columns: list[str]) -> pa.Table:
    """Rows that need no bucket: -1 less the bucket is the group of their documents."""
    return table.select(columns).add_column(0, "grp", pc.subtract(pa.scalar(-1, pa.int32()), table["bucket"]))


def _ends(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest document of each row's key. Rows keep their order, in which neighbours are alike and
    code short."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    n = np.diff(np.append(at, len(key)))
    low, high = np.empty_like(doc), np.empty_like(doc)
    low[order], high[order] = np.repeat(np.minimum.reduceat(doc[order], at), n), np.repeat(np.maximum.reduceat(doc[order], at), n)
    return low, high


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) >> np.uint64(33)).astype(np.int64) % groups


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """docs with grp, the numpy group of doc_id; null ids, which nothing looks for, by text length and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.where(batch.column(0).is_valid().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy(), pc.binary_length(batch.column(1)).fill_null(0).to_numpy() * 1000 + np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_group(ids, groups).astype(np.int32))], names=["doc_id", "text", "grp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, grp int")


def verify(docs: DataFrame, marks: DataFrame, size: int, buckets: int, groups: int) -> DataFrame:
    """Window starts that repeat a smaller document's: grp, doc, key (of the row), start, packed."""

    def windows(own: pa.Table, marked: pa.Table) -> pa.Table:
        names = ["bucket", "hash", "doc", "key", "start"]
        out = []
        if marked.num_rows and own.num_rows:
            doc, lo, hi = (np.concatenate([_unzip(x) for x in marked[c].to_pylist()]) for c in ("doc", "lo", "hi"))
            order = np.argsort(doc, kind="stable")
            doc, lo, hi = doc[order], lo[order], hi[order]
            ids = own["doc_id"].combine_chunks()
            wanted = np.isin(ids.fill_null(-1).to_numpy(), doc) & ids.is_valid().to_numpy(zero_copy_only=False)
            own = own.filter(pa.array(wanted))
            all_ids = own["doc_id"].to_numpy()
            held = [[], [], [], []]
            for lo_row, hi_row, w, first, _, _, _ in _words_of(own["text"]) if own.num_rows else ():
                ids, n = all_ids[lo_row:hi_row], np.diff(first)
                a, b = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
                d = np.repeat(np.arange(len(ids)), b - a)
                m = np.arange(len(d)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[d]
                x, y = np.minimum(lo[m], n[d]) + first[d], np.minimum(hi[m] + 1, np.maximum(n[d] - size + 1, 0)) + first[d]
                x = np.minimum(x, y)
                cover = np.zeros(len(w) + 1, np.int32)
                np.add.at(cover, x, 1)
                np.add.at(cover, y, -1)
                s = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                if not len(s):
                    continue
                which = np.searchsorted(first, s, side="right") - 1
                held[0].append(window_hashes(w, size)[s])
                held[1].append(ids[which])
                held[2].append(_row_key(w, first)[which])
                held[3].append(s - first[which])
            if held[0]:
                h, *rest = (np.concatenate(x) for x in held)
                low, _ = _ends(h, rest[0])
                # a smaller document of this group settles a window here; those of the smallest go to their bucket
                told = rest[0] > low
                out.append(_by((h >> np.uint64(40)).astype(np.int64)[~told] % buckets, [x[~told] for x in (h, *rest)], 1, names))
                if told.any():
                    out.append(_by(-1 - _group(rest[0][told], groups), [h[told] * np.uint64(0), *(x[told] for x in rest)], 1, names))
        empty = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in names[1:])])
        return pa.Table.from_batches(out, schema=empty)

    def repeats(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return _settled(table, ["doc", "key", "start"])
        h = np.frombuffer(b"".join(table["hash"].to_pylist()), np.uint64)
        doc, key, start = (np.concatenate([_unzip(x) for x in table[c].to_pylist()]) for c in ("doc", "key", "start"))
        order = np.argsort(h, kind="stable")
        h, doc, key, start = h[order], doc[order], key[order], start[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        use = doc > np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(h))))
        doc, key, start = doc[use], key[use], start[use]
        if not len(doc):
            return pa.table({"grp": pa.array([], pa.int32()), "doc": pa.array([], pa.binary()), "key": pa.array([], pa.binary()), "start": pa.array([], pa.binary())})
        order = np.lexsort((start, key, doc))
        doc, key, start = doc[order], key[order], start[order]
        return pa.Table.from_batches([_by(_group(doc, groups), [doc, key, start], 0, ["grp", "doc", "key", "start"])])

    rows = grouped(docs, groups).groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(windows, "bucket int, hash binary, doc binary, key binary, start binary")
    return rows.groupBy("bucket").applyInArrow(repeats, "grp int, doc binary, key binary, start binary")


def removed(docs: DataFrame, found: DataFrame, size: int, groups: int, with_text: bool) -> DataFrame:
    def run(own: pa.Table, repeats: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else [])])
        if not own.num_rows:
            return schema.empty_table()
        starts: dict[tuple[int, int], np.ndarray] = {}
        if repeats.num_rows:
            doc, key, start = (np.concatenate([_unzip(x) for x in repeats[c].to_pylist()]) for c in ("doc", "key", "start"))
            order = np.lexsort((start, key, doc))
            doc, key, start = doc[order], key[order], start[order]
            at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
            starts = {(d, k): s for d, k, s in zip(doc[at].tolist(), key[at].tolist(), np.split(start, at[1:]))}
        docs_with = {d for d, _ in starts}
        ids, texts = own["doc_id"].to_pylist(), own["text"].to_pylist()
        n_words, n_gone, kept = [], [], []
        for i, text in zip(ids, texts):
            raw = (text or "").encode()
            words = raw.split()  # bytes split at exactly 09-0D and space
            gone = 0
            if i is not None and i in docs_with:
                for _, _, w, first, _, _, _ in _words_of(pa.array([text], pa.string())):
                    s = starts.get((i, int(_row_key(w, first)[0])))
                    if s is not None:
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + size, -1)
                        lost = np.cumsum(cover[:-1]) > 0
                        gone = int(lost.sum())
                        words = [x for x, y in zip(words, lost.tolist()) if not y]
            n_words.append(len(words) + gone)
            n_gone.append(gone)
            kept.append(b" ".join(words))
        columns = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        return pa.Table.from_arrays(columns + ([pa.array([x.decode() for x in kept], pa.string())] if with_text else []), schema=schema)

    extra = ", kept string" if with_text else ""
    return grouped(docs, groups).groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string{extra}")


def remove_repeats(docs: DataFrame, size: int = 50, with_text: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, one row per row; with_text adds kept."""
    if size < 50:
        raise ValueError("four rounds are shown to meet in windows of 50 words or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    size_of = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(64, int(size_of / (6 << 20)))  # about 6 MB of text a group
    marks = written(reveal(docs, size, pieces, pieces), "marks")
    found = written(verify(docs, marks, size, pieces, pieces), "repeats")
    return removed(docs, found, size, pieces, with_text)
