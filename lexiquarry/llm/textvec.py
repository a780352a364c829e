"""Vectorised tokenising and hashing of whole texts with numpy.

Texts are handled as one UTF-8 buffer per block of a few MB, so that the cost
of a word is a handful of array operations and never a Python loop.  A word's
hash depends on its bytes alone: the same word has the same 64-bit hash in
every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 21
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_STEP = 1 << 11

#: Bytes that end a word, by mode. NUL separates texts, so it always does.
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_NONWORD = np.ones(256, bool)
_NONWORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = False
BREAKS = {"space": _SPACE, "word": _NONWORD}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for buffers of up to n bytes."""
    have = _TABLES.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        _TABLES[0] = have = (_powers(_BASE, size), _powers(_INV, size))
    return have


def _segments(data: bytes, breaks: np.ndarray) -> Iterator[bytes]:
    """Pieces of at most about BLOCK bytes that end where a word ends."""
    at = 0
    while len(data) - at > BLOCK:
        end = at + BLOCK
        window = breaks[np.frombuffer(data, np.uint8, BLOCK, at)]
        last = int(BLOCK - 1 - np.argmax(window[::-1])) if window.any() else -1
        if last < 0:  # one word longer than a block: up to its end
            rest = breaks[np.frombuffer(data, np.uint8, len(data) - end, end)]
            last = end - at + int(np.argmax(rest)) if rest.any() else len(data) - at - 1
        yield data[at : at + last + 1]
        at += last + 1
    yield data[at:]


def spans(buf: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a buffer."""
    inside = ~BREAKS[mode][buf]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of bytes, by prefix sums of a polynomial."""
    up, down = _tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, _U)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def _hash_one(data: bytes, mode: str) -> np.ndarray:
    out = []
    for piece in _segments(data, BREAKS[mode]):
        buf = np.frombuffer(piece, np.uint8)
        out.append(hash_spans(buf, *spans(buf, mode)))
    return np.concatenate(out) if out else np.empty(0, _U)


def word_hashes(texts, mode: str = "space", lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of (index of the first text, word hashes, offsets of the texts).

    offsets has one entry more than the block has texts.  A null text has no
    words.  Texts of more than a block are hashed piece by piece.
    """
    pending: list[bytes] = []
    first = size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(b"\0".join(pending) + b"\0", np.uint8)
        ends_of = np.cumsum([len(x) + 1 for x in pending])
        starts, ends = spans(buf, mode)
        return hash_spans(buf, starts, ends), np.concatenate([[0], np.searchsorted(starts, ends_of)])

    for i, text in enumerate(texts):
        data = b"" if text is None or text != text else (text.lower() if lower else text).encode("utf-8", "surrogatepass")
        if pending and size + len(data) > BLOCK:
            yield (first, *flush())
            pending, size, first = [], 0, i
        if len(data) > BLOCK:
            words = _hash_one(data, mode)
            yield i, words, np.array([0, len(words)])
            first = i + 1
            continue
        pending.append(data)
        size += len(data) + 1
    if pending:
        yield (first, *flush())


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 are dropped."""
    if len(words) < n:
        return np.empty(0, _U)
    m = len(words) - n + 1
    out = np.zeros(m, _U)
    for j in range(n):
        out *= _BASE
        out += words[j : j + m]
    return mix(out)


def ngram_sets(texts, n: int, mode: str = "word", lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text.

    A text of fewer than n words, but at least one, has one gram: all of its
    words.  A text without words has none.
    """
    for _, words, offsets in word_hashes(texts, mode, lower):
        grams = ngrams(words, n)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield ngrams(words[a:b], int(b - a))
            else:
                yield np.empty(0, _U)
