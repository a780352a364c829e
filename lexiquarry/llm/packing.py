"""Operator 3: concatenate and cut.

Documents become one stream of token ids, each followed by the end id, and
the stream is cut into windows of a fixed length.  Two passes: the first
encodes every text once and writes the ids with their place within their
partition; prefix sums over the partitions' totals turn these into global
offsets; the second cuts.  A window that lies within one task's rows is cut
there; only boundary records, at most two a task, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Tables, arrow_schema, column, require

WINDOW = 2048
ENCODED = "part int, start bigint, doc_id bigint, n_tokens bigint, id_bytes int, ids binary"
PACKED = "window_id bigint, n_tokens int, id_bytes int, ids binary, doc_ids array<bigint>, starts array<int>"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, ends: str | None = None) -> DataFrame:
    """First pass: ids of every document and their place within the partition."""
    schema = arrow_schema(ENCODED)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens.vocabulary(tokenizer)
        end = np.array([end_id], vocabulary.dtype)

        def ids_of(text: str | None) -> np.ndarray:
            if ends is None:
                return np.concatenate([vocabulary.encode(text), end])
            if text is not None and text.endswith(ends):
                return np.concatenate([vocabulary.encode(text[: -len(ends)]), end])
            return vocabulary.encode(text)

        context = TaskContext.get()
        part, place = context.partitionId() if context else 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = [ids_of(t.as_py()) for t in piece.column(1)]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(starts), piece.column(0), pa.array(sizes), pa.array(np.full(n, vocabulary.dtype.itemsize, np.int32)), pa.array([x.tobytes() for x in ids], pa.binary())],
                    schema=schema,
                )

    return docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), column(docs, "text")).mapInArrow(encode, ENCODED)


def offsets(table: DataFrame, size: str, *within: str) -> DataFrame:
    """Where each partition's rows begin: a prefix sum over one total a partition.

    Only the totals, a row a partition, are brought together, apart for each
    value of ``within``.
    """
    totals = table.groupBy(*within, "part").agg(F.sum(size).alias("total"))
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*within, "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = tokens.DEFAULT_PATH, end_id: int = tokens.END_ID, drop_last: bool = False, ends: str | None = None) -> DataFrame:
    """Windows of exactly ``window`` ids over all documents, in the order in which the table is read.

    One row a window: window_id counts from 0; ids holds n_tokens ids of
    id_bytes bytes each, least significant first; doc_ids and starts say
    which documents lie in it and where in it each begins (0 for one that
    began in an earlier window).  The last window holds what remains, unless
    drop_last.  With ``ends`` rows may be pieces of documents: the end id
    follows only a text that ends with this string, in its place.

    A null or empty text is a document of the end id alone; a null doc_id
    stays null; repeated rows are repeated documents; an empty table gives
    no windows; a text longer than a window fills as many as it needs; other
    columns aren't read, whatever their names.
    """
    require(docs, ["doc_id", "text"])
    if window < 1:
        raise ValueError("window must be positive")
    spark = docs.sparkSession
    tables = Tables(spark, "pack")
    table = tables.write(encoded(docs, tokenizer, end_id, ends), "ids")
    placed = (
        table.join(F.broadcast(offsets(table, "n_tokens")), "part")  # a row of 12 bytes for each partition of the input
        .select((F.col("base") + F.col("start")).alias("start"), "doc_id", "id_bytes", "ids")
    )
    schema = arrow_schema("whole boolean, first bigint, " + PACKED)

    def row(whole: bool, start: int, width: int, ids: bytes, names: list, places: list) -> list:
        return [whole, start, start // window, len(ids) // width, width, ids, names, places]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that end within a run of adjoining rows; what is left on either side of it are boundary records."""
        begin = end = 0
        width = 2
        ids: list[bytes] = []
        names: list[int | None] = []
        places: list[int] = []

        def take() -> list:
            return row(begin % window == 0 and end - begin == window, begin, width, b"".join(ids), names, places)

        for batch in batches:
            out: list[list] = []
            for start, name, width_of, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if start != end and ids:
                    out.append(take())
                    ids, names, places = [], [], []
                if not ids:
                    begin = end = start
                width, at, size = width_of, 0, len(data) // width_of
                while at < size:
                    n = min(size - at, window - end % window)
                    names.append(name)
                    places.append(end - begin)
                    ids.append(data[at * width : (at + n) * width])
                    at += n
                    end += n
                    if end % window == 0:
                        out.append(take())
                        ids, names, places, begin = [], [], [], end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(take(), schema)], schema=schema)

    pieces = tables.write(placed.mapInArrow(cut, "whole boolean, first bigint, " + PACKED), "windows")
    tables.drop(table)
    joined = (
        pieces.filter(~F.col("whole"))
        .withColumn("starts", F.transform("starts", lambda s: (s + F.col("first") % window).cast("int")))
        .groupBy("window_id")
        .agg(F.array_sort(F.collect_list(F.struct("first", "id_bytes", "ids", "doc_ids", "starts"))).alias("p"))
        .select(
            "window_id",
            F.expr("cast(aggregate(p, 0L, (n, x) -> n + length(x.ids) div x.id_bytes) as int)").alias("n_tokens"),
            F.expr("p[0].id_bytes").alias("id_bytes"),
            F.expr("aggregate(p, cast('' as binary), (b, x) -> concat(b, x.ids))").alias("ids"),
            F.expr("flatten(p.doc_ids)").alias("doc_ids"),
            F.expr("flatten(p.starts)").alias("starts"),
        )
    )
    out = pieces.filter("whole").select(*joined.columns).unionByName(joined)
    return out.filter(F.col("n_tokens") == window) if drop_last else out
