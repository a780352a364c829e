"""Operator 9: token ids in binary shards, document boundaries in Elias-Fano form.

A shard is one row: the ids of its documents in one array, and their
boundaries as a monotone sequence of n + 1 offsets in about 2 + log2(u / n)
bits each.  ``select`` finds a boundary from 32-bit samples and a few bytes
of the unary part; no table of 64-bit offsets exists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens
from .common import arrow_schema, column, require

SAMPLE = 128
SHARD_TOKENS = 1 << 22
SCHEMA = "shard_id bigint, doc_ids array<bigint>, n_tokens bigint, id_bytes int, ids binary, low_bits int, low binary, high binary, samples binary"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class EliasFano:
    """A monotone sequence; ``self[i]`` is its i-th value."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("the sequence must be monotone and not negative")
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel() if bits else np.empty(0, np.uint8)
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        return cls(n, bits, pack(low), pack(unary), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Place of the i-th one of the unary part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        if not left:
            return start
        high = np.frombuffer(self.high, np.uint8)
        at, left = start // 8, left + 1
        head = int(high[at]) & (0xFF << (start % 8)) & 0xFF
        counts = _ONES[high[at : at + 4 * SAMPLE + 64]].astype(np.int64)
        counts[0] = _ONES[head]
        while True:
            total = np.cumsum(counts)
            k = int(np.searchsorted(total, left))
            if k < len(total):
                break
            left -= int(total[-1])
            at += len(counts)
            head = -1
            counts = _ONES[high[at : at + 1024]].astype(np.int64)
        byte = head if k == 0 and head >= 0 else int(high[at + k])
        left -= int(total[k - 1]) if k else 0
        for bit in range(8):
            left -= byte >> bit & 1
            if not left:
                return (at + k) * 8 + bit
        raise AssertionError("damaged unary part")

    def __getitem__(self, i: int) -> int:
        place = self.select(i)
        if not self.low_bits:
            return place - i
        first = i * self.low_bits
        a, b = first // 8, (first + self.low_bits + 7) // 8
        word = int.from_bytes(self.low[a:b], "little") >> first % 8
        return (place - i) << self.low_bits | word & ((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        """All values."""
        unary = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        high = np.flatnonzero(unary)[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        return high << self.low_bits | low.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))


def of_shard(row) -> EliasFano:
    """The boundaries of a row of token_shards: those of document i are [i] and [i + 1]."""
    return EliasFano(len(row["doc_ids"]) + 1, row["low_bits"], bytes(row["low"]), bytes(row["high"]), bytes(row["samples"]))


def document_ids(row, i: int) -> np.ndarray:
    """Ids of the i-th document of a shard, by two selects."""
    bounds = of_shard(row)
    return np.frombuffer(row["ids"], f"<u{row['id_bytes']}")[bounds[i] : bounds[i + 1]]


def token_shards(docs: DataFrame, tokenizer: str = tokens.DEFAULT_PATH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Concatenate the ids of whole texts into shards of at least shard_tokens, in one pass without a shuffle.

    A shard ends with the document that reaches shard_tokens, or with its
    task's input; a document is never divided, so one longer than that is a
    shard of its own.  A null or empty text is a document of no ids; a null
    doc_id stays null; repeated rows are repeated documents; an empty table
    gives no shards; other columns aren't read.  Any process can read a row
    on its own.
    """
    require(docs, ["doc_id", "text"])

    schema = arrow_schema(SCHEMA)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens.vocabulary(tokenizer)
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            bounds = EliasFano.encode(np.cumsum([0, *map(len, ids)]))
            values = [shard, names, size, vocabulary.dtype.itemsize, np.concatenate(ids).tobytes(), bounds.low_bits, bounds.low, bounds.high, bounds.samples]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(vocabulary.encode(text.as_py()))
                names.append(name)
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield flush()
                    shard, ids, names, size = shard + 1, [], [], 0
        if names:
            yield flush()

    return docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), column(docs, "text")).mapInArrow(encode, SCHEMA)


def decode_shards(shards: DataFrame, tokenizer: str = tokens.DEFAULT_PATH) -> DataFrame:
    """The documents of shards again: doc_id, text, n_tokens. Texts come back byte for byte; null ones as empty."""

    schema = arrow_schema("doc_id bigint, text string, n_tokens bigint")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens.vocabulary(tokenizer)
        for batch in batches:
            for row in batch.to_pylist():
                bounds = of_shard(row).decode()
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                texts = [vocabulary.decode(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": row["doc_ids"], "text": texts, "n_tokens": np.diff(bounds)}, schema=schema)

    return shards.mapInArrow(decode, "doc_id bigint, text string, n_tokens bigint")
