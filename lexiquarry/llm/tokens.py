"""Public byte-level BPE vocabularies, read from a path that is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: How the vocabulary's byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The id that the vocabulary leaves free; it ends a document.
END_ID = 50256
_PIECE = 200_000


class Vocabulary:
    """Encodes and decodes whole texts; ids take 16 bits where they fit."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(ranks.values()) + 2
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; a null text has none."""
        if not text or text != text:
            return np.empty(0, self.dtype)
        if len(text) <= _PIECE:
            return np.array(self._encoding.encode_ordinary(text), self.dtype)
        out, at = [], 0
        while at < len(text):  # pieces end before a blank that follows a word: no token spans that place
            end = at + _PIECE
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and end + 1 < len(text) and not text[end + 1].isspace()):
                end += 1
            out.append(np.array(self._encoding.encode_ordinary(text[at:end]), self.dtype))
            at = end
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        return self._encoding.decode_bytes([int(x) for x in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str = DEFAULT_PATH) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)
