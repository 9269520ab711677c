"""Token ids of whole texts by the tokenizers library, one pre-token at a time.

BPE never merges across pre-tokens, so the ids of a text are the ids of its pre-tokens, each asked once of the library's
model and kept in a bounded cache: when the young generation is full it becomes the old one, from which frequent pre-tokens
come back. Texts with a special token's string and texts with any character outside ASCII and the Latin-1
letters, on which the library's own pattern and normaliser need not agree with `re`, are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SAFE = re.compile(rf"[\t\n\r\x20-\x7e{LETTERS[6:]}]*")
#: Patterns of the two public vocabularies' pre-tokenisers, for safe texts; fixed values.
BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
#: Entries of each of the two generations of a worker's cache: some 100 MB each.
CACHED, LONGEST = 600_000, 64
_KEPT: dict[str, Callable[[str], bytes]] = {}


def byte_letters() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids(dict):
    """Little-endian unsigned 32-bit ids of a pre-token."""

    def __init__(self, model):
        self.model, self.letters, self.old = model, byte_letters(), {}
        self.blank = self.letters[32]

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            plain = word.replace(" ", self.blank) if word.isascii() and (word.isprintable()) else word.encode().decode("latin-1").translate(self.letters)
            ids = self.pack([t.id for t in self.model.tokenize(plain)])
        if len(word) <= LONGEST:
            if len(self) >= CACHED:
                self.old = self.copy()
                self.clear()
            self[word] = ids
        return ids

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from text to the bytes of its ids; one for each file and worker."""
    if path not in _KEPT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        words = "lowercase" in str(whole.normalizer).lower()
        pattern, ids = (WORD_LEVEL if words else BYTE_LEVEL).findall, Ids(whole.model)

        def encode(text: str) -> bytes:
            if not SAFE.fullmatch(text) or any(t in text for t in special):
                return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            return b"".join(map(ids.__getitem__, pattern(text.lower() if words else text)))

        _KEPT[path] = encode
    return _KEPT[path]
