"""Byte-level BPE encoding and decoding by a file of merge ranks, split without regular expressions.

Pre-tokens are the matches of  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ , one after
another. They cover every character, so only their starts are wanted. A text becomes an array of code points, that an
array of symbols (its class, and what of the next one or two characters matters: white space before more white space or
the end, the letters of a contraction), and each symbol is a function from the state before a character to the state after it.
Such functions compose associatively: the functions of all blocks of BLOCK characters are composed side by side, block results by
doubling, and with the state before each block known, the states inside all blocks follow side by side again. A start
is a table entry of (state, symbol).

Classes of code points are read once a worker from the tokenizer library itself (one pass over all code points a class), whose Unicode
version is newer than Python's. Each pre-token's ids come from a bounded memo or from merging its lowest-ranked pair first,
leftmost among equals (found in a list, or for long ones by a heap over a
linked list). Ids keep their byte offsets in the text, at which decoding puts their bytes.

Nulls and edges: a null text is empty and has no ids; a null doc_id and repeated rows pass; special strings are ordinary
text; an empty table gives an empty one; other columns are ignored. No shuffle; a task holds some MB of texts, or one
longer text at some thirty times its size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import held, small_batches, text_chunks

BLOCK = 64
#: Characters scanned at once and ids decoded at once.
SEGMENT, SLICE = 1 << 21, 1 << 16
#: Pre-tokens kept by a worker (the memo begins anew when it is full) and the longest ones, in bytes: at most some 100 MB.
MEMO_ENTRIES, SHORT = 400_000, 64

# symbols: letter, letter that ends a contraction, letter that begins the two of one, number, other, apostrophe,
# last white space before a word (a space, another), any other white space
LETTER, ENDING, DOUBLE, NUMBER, OTHER, QUOTE, SPACE, BREAK, BLANK = range(9)
# states: behind a finished token, in letters, in numbers, in others, behind an apostrophe that began a token, behind a
# space that belongs to the next token, in white space, inside a contraction of two letters
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, SPACED, IN_BLANKS, HALF = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """State after, and whether a token starts, by symbol * 8 + state; symbols from 9 on are a text's first character."""
    after, start = np.zeros((18, 8), np.uint8), np.zeros((18, 8), bool)
    for symbol in range(9):
        for state in range(8):
            if symbol in (LETTER, ENDING, DOUBLE):
                to, same = IN_LETTERS, (IN_LETTERS, SPACED)
                if state == HALF or state == QUOTED and symbol == ENDING:
                    to, same = DONE, (HALF, QUOTED)
                elif state == QUOTED and symbol == DOUBLE:
                    to, same = HALF, (QUOTED,)
            elif symbol == NUMBER:
                to, same = IN_NUMBERS, (IN_NUMBERS, SPACED)
            elif symbol in (OTHER, QUOTE):
                to, same = IN_OTHERS, (IN_OTHERS, QUOTED, SPACED)
                if symbol == QUOTE and state not in same:
                    to = QUOTED
            elif symbol == BLANK:
                to, same = IN_BLANKS, (IN_BLANKS,)
            else:
                to, same = SPACED if symbol == SPACE else DONE, ()
            after[symbol, state], start[symbol, state] = to, state not in same
    after[9:], start[9:] = after[:9, DONE][:, None], True
    return after.ravel(), start.ravel()


AFTER, START = _machine()


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 bytes and where each begins."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at]
    point = lead.astype(np.uint32)
    for extra, low, high in ((1, 0xC0, 0xDF), (2, 0xE0, 0xEF), (3, 0xF0, 0xF7)):
        some = np.flatnonzero((lead >= low) & (lead <= high))
        value = point[some] & (high - low)
        for k in range(1, extra + 1):
            value = value << 6 | raw[at[some] + k] & 0x3F
        point[some] = value
    return point, at


def symbols(point: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of the characters of several texts, of which first has the first characters' places and the end."""
    out = classes[point]
    n = len(out)
    blank = out == BLANK
    word_next = np.zeros(n, bool)
    word_next[:-1] = ~blank[1:]
    ends = first[1:][first[1:] > first[:-1]] - 1
    word_next[ends] = False
    last = np.flatnonzero(blank & word_next)
    out[last] = np.where(point[last] == 32, SPACE, BREAK)
    quote = np.flatnonzero(point == 39)
    if len(quote):
        end = first[np.searchsorted(first, quote, side="right")]
        padded = np.concatenate([point, np.zeros(2, point.dtype)])
        one = np.where(quote + 1 < end, padded[quote + 1], 0)
        two = np.where(quote + 2 < end, padded[np.minimum(quote + 2, n)], 0)
        out[quote[np.isin(one, [ord(c) for c in "stmd"])] + 1] = ENDING
        double = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quote[double] + 1] = DOUBLE
    out[first[:-1][first[:-1] < n]] += 9
    return out


def scan(symbol: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each symbol, and behind all, from the state before the first."""
    n = len(symbol)
    blocks = -(-n // BLOCK)
    rows = np.full(blocks * BLOCK, 0, np.int32)
    rows[:n] = symbol
    rows = np.ascontiguousarray(rows.reshape(blocks, BLOCK).T) * 8
    function = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in rows:
        function = AFTER[row[:, None] + function]
    step = 1
    while step < blocks:  # function i becomes that of all blocks up to i
        function[step:] = np.take_along_axis(function[step:], function[:-step], axis=1)
        step *= 2
    at = np.concatenate([[state], function[:-1, state]]).astype(np.uint8)
    before = np.empty((BLOCK, blocks), np.uint8)
    for row, out in zip(rows, before):
        out[:] = at
        at = AFTER[row + at]
    before = before.T.ravel()
    return before[:n], int(AFTER[int(symbol[-1]) * 8 + int(before[n - 1])])


def starts(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of texts (UTF-8 bytes, offsets) begin, and how many begin before each text and the end."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    point, at = code_points(raw)
    symbol = symbols(point, np.searchsorted(at, offsets), classes)
    found, state = [], DONE
    for lo in range(0, len(symbol), SEGMENT):
        part = symbol[lo : lo + SEGMENT]
        before, state = scan(part, state)
        found.append(np.flatnonzero(START[part.astype(np.int32) * 8 + before]) + lo)
    begin = at[np.concatenate(found)]
    return begin, np.searchsorted(begin, offsets)


class RankBpe:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.classes = self._classes()
        self.memo: dict[bytes, bytes] = {}
        words = [b""] * (max(self.rank.values()) + 1)
        for word, i in self.rank.items():
            words[i] = word
        self.length = np.array([len(w) for w in words], np.int64)
        self.at, self.bytes = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(words), np.uint8)

    @staticmethod
    def _classes() -> np.ndarray:
        import tiktoken

        out = np.full(0x110000, OTHER, np.uint8)
        every = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], "<u4").tobytes().decode("utf-32-le")
        single = {bytes([i]): i for i in range(256)}
        for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
            matched = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
            out[np.frombuffer(bytes(matched).decode().encode("utf-32-le"), "<u4")] = kind
        out[ord("'")] = QUOTE
        return out

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if word in self.rank:
            return [self.rank[word]]
        return self._merged_short(word) if len(word) <= SHORT else self._merged_long(word)

    def _merged_short(self, word: bytes) -> list[int]:
        """The lowest pair is looked for in a list of the pairs' ranks."""
        rank, none = self.rank, len(self.length)
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [rank.get(a + b, none) for a, b in pairwise(parts)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return [rank[x] for x in parts]

    def _merged_long(self, word: bytes) -> list[int]:
        """The lowest pair comes from a heap, and the symbols are a linked list."""
        rank, n = self.rank, len(word)
        after, before = [*range(1, n + 1), -1], list(range(-1, n))  # of the symbol that begins at a place
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if j < 0 or j >= n or after[j] != end:
                continue
            after[i], after[j], before[end] = end, -1, i
            if end < n and (r := rank.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := rank.get(word[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : after[i]]])
            i = after[i]
        return out

    def _new(self, word: bytes) -> bytes:
        ids = array("I", self.merged(word)).tobytes()
        if len(word) <= SHORT:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column."""
        get, new = self.memo.get, self._new
        for _, _, raw, offsets in text_chunks(column):
            begin, first = starts(raw, offsets, self.classes)
            data, bounds = raw.tobytes(), np.append(begin, len(raw))
            for lo, hi in pairwise(first.tolist()):
                parts = []
                for k in range(lo, hi, SLICE):
                    cut = bounds[k : min(k + SLICE, hi) + 1].tolist()
                    parts.append(b"".join([get(w) or new(w) for w in [data[a:b] for a, b in pairwise(cut)]]))
                yield np.frombuffer(b"".join(parts), "<u4")

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where the bytes of each id begin in the text, and the text's length."""
        return np.concatenate([[0], np.cumsum(self.length[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The text's bytes, some ids at a time: each id's bytes at its offset."""
        for k in range(0, len(ids), SLICE):
            part, place = ids[k : k + SLICE], offsets[k : k + SLICE + 1] - offsets[k]
            yield self.bytes[np.repeat(self.at[part] - place[:-1], np.diff(place)) + np.arange(place[-1])]


def codec(path: str) -> RankBpe:
    """One codec a worker and file."""
    return held(f"ranks {path}", lambda: RankBpe(path))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32)))


def encoded(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, tokens, offsets: the ids of each text, and where the bytes of each begin in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            ids = list(own.encode(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids), _lists([own.offsets(x)[:-1] for x in ids])], names=["doc_id", "tokens", "offsets"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, tokens array<int>, offsets array<int>")


def decoded(tokens: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the bytes of its tokens (doc_id, tokens); a null list counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            data = [b"".join(p.tobytes() for p in own.decode(x, own.offsets(x))) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    small_batches(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("long"), "tokens").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text's ids, and what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for ids in own.encode(batch.column(1)):
                text = hashlib.sha256()
                for part in own.decode(ids, own.offsets(ids)):
                    text.update(part.tobytes())
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_digest.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
