"""Exact ids of a byte-level BPE tokenizer file, pre-token by pre-token with a bounded memo.

The library's own `model.tokenize` gives the ids of each pre-token the first time it is seen; repeated
pre-tokens cost one dictionary lookup. Texts with characters outside common Latin text and punctuation and
texts that hold an added token's string go through the library whole.
"""

from __future__ import annotations

import re

import numpy as np

from wayfold.llm.common import held

#: Pre-tokens kept per generation and worker process and their longest, in characters. Two generations are held: at some 170
#: bytes each, rarely up to 700, some 70 MB.
MEMO_LIMIT, LONGEST = 200_000, 64
#: All letters up to U+024F.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of the 256 bytes used by byte-level BPE: printable Latin-1 stands for itself,
    the other bytes follow from U+0100."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """Values by key, made on the first use. At MEMO_LIMIT keys a new generation begins; what is used again moves into it from
    the one before, and older keys are forgotten."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= MEMO_LIMIT:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        # the byte-level pre-tokenizer's classes, spelled out for the characters that whole() lets through
        self.find = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+").findall
        self.alphabet = byte_alphabet()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.foreign = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ‐-…€]").search
        self.common = bytes(b for b in range(256) if not self.foreign(chr(b)))
        self.memo = Memo(self._new)

    def _new(self, token: str) -> bytes:
        mapped = token.encode().decode("latin1").translate(self.alphabet)
        return b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(mapped)])

    def whole(self, text: str) -> bool:
        """Whether a text has to go through the library whole. Latin-1 texts are looked through as bytes."""
        try:
            foreign = bool(text.encode("latin1").translate(None, self.common))
        except UnicodeEncodeError:
            foreign = self.foreign(text) is not None
        return foreign or any(t in text for t in self.added)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if self.whole(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, self.find(text)))


def encoder(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    return held(f"bytes {path}", lambda: ByteBpe(path))
