"""Token counts by heap-and-linked-list BPE merging, without identifiers.

The vocabulary and its merge ranks come from a sentencepiece BPE model; the counting is done here. A word's
characters form a linked list; a heap holds the adjacent pairs that are pieces, by rank and position; the
best is popped, checked against the list, merged, and its new neighbours pushed. The count is the
number of initial symbols less the merges, where a symbol without a piece counts its UTF-8 bytes (byte
fallback). Pieces hold the word mark only at their front (checked at load), so words are
merged apart and a bounded memo keeps their counts.

Nulls: a null text is empty; empty texts have 0 tokens. Any other column, a null doc_id and repeated rows pass.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import held, small_batches

MARK = "▁"
#: Word counts kept per worker process and their longest, in characters: some 60 MB.
MEMO_LIMIT, LONGEST = 500_000, 64


class BpeCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.normalizer = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.normalizer
        special = [i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)]
        skip = set(special)
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if i not in skip}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece holds the word mark behind other characters")
        self.byte_fallback = any(sp.is_byte(i) for i in special)
        self.identity = sp.normalize("  aﬁ \n\t b ") == f"{MARK}{MARK}{MARK}aﬁ{MARK}\n\t{MARK}b{MARK}"
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.memo: dict[str, int] = {}

    def merges(self, word: str) -> int:
        """Tokens of one normalised word."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank
        heap = [(r, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else -1
            if j < 0 or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(piece + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, piece + symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, symbols[h] + piece))
        return sum(1 if s in rank or not self.byte_fallback else len(s.encode()) for s in symbols if s is not None)

    def _new(self, word: str) -> int:
        n = self.merges(word)
        if len(word) <= LONGEST and len(self.memo) < MEMO_LIMIT:
            self.memo[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        # with an identity normaliser, white space is marked and one mark is put in front
        text = MARK + text.replace(" ", MARK) if self.identity else self.normalizer.normalize(text)
        get, new = self.memo.get, self._new
        return sum([get(w) or new(w) for w in self.split(text)])


def counter(path: str) -> BpeCounter:
    return held(f"pieces {path}", lambda: BpeCounter(path))


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text). Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            n = [count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
