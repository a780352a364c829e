"""Vector tables: cleaning, blocks, distributed sums and exact distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema, column, require

_CHUNKS = 16
#: Queries that go to every task at once; more make more passes over the vectors.
QUERIES = 16_384
#: Queries that a task compares with a batch of vectors at a time.
ABREAST = 1024


def clean(table: DataFrame, tables: Tables, id_name: str = "vec_id", vector_name: str = "embedding") -> tuple[DataFrame, int]:
    """The usable vectors, one for each id: id, v; and their dimension.

    Left out are rows with a null id or vector, with a null, NaN or infinite
    component, and those of another length than most rows have (of lengths
    equally frequent, the largest counts).  Of several vectors under an id the greatest
    in lexicographic order stays.
    """
    require(table, [id_name, vector_name])
    v = column(table, vector_name).cast("array<float>")
    usable = table.select(column(table, id_name).cast("bigint").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('infinity'))")
    top = usable.filter("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return tables.write(usable.filter((F.size("v") == d) & (F.size("v") > 0)).groupBy("id").agg(F.max("v").alias("v")), "vectors"), d


def matrix(values: pa.Array, d: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, d)


def summed(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], size: int) -> np.ndarray:
    """Sum over all tasks of an array of fixed size that each fills; added up in pieces, in the order of the tasks."""
    ddl = "chunk int, task bigint, data binary"
    schema = arrow_schema(ddl)
    bounds = [size * k // _CHUNKS for k in range(_CHUNKS + 1)]

    def rows(total: np.ndarray, task: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([task] * _CHUNKS, pa.int64()), pa.array([total[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            add(total, batch)
        yield rows(total, TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                part = np.frombuffer(data)
                totals[k] = totals[k] + part if k in totals else part
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([0] * len(totals), pa.int64()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], schema=schema)

    out = np.zeros(size)
    for k, _, data in df.mapInArrow(partial, ddl).repartition("chunk").sortWithinPartitions("chunk", "task").mapInArrow(merge, ddl).collect():  # of fixed size
        out[bounds[k] : bounds[k + 1]] = np.frombuffer(bytes(data))
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row."""
    norms = (centres.astype(np.float64) ** 2).sum(1).astype(np.float32)
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (norms - 2 * x[at : at + 4096] @ centres.T).argmin(1)
    return out


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of rows that belong together, summed in double precision from the first component on."""
    diff = q.astype(np.float64) - x
    diff *= diff
    return np.add.accumulate(diff, axis=1)[:, -1] if diff.shape[1] else np.zeros(len(q))


def measured(pairs: DataFrame, vectors: DataFrame, d: int) -> DataFrame:
    """Exact squared distances of (q, x) pairs of ids: q, x, d2, and the columns that come with them."""
    others = [c for c in pairs.columns if c not in ("q", "x")]
    both = pairs.join(vectors.select(F.col("id").alias("x"), F.col("v").alias("xv")), "x").join(vectors.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q").select("q", "x", *others, "qv", "xv")
    out = both.select("q", "x", *others).schema.add("d2", "double")
    schema = arrow_schema(out.simpleString())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            d2 = squared(matrix(batch.column(n - 2), d), matrix(batch.column(n - 1), d))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(d2)], schema=schema)

    return both.mapInArrow(measure, out)


def ranked(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query: vec_id, rank (from 1), neighbor_id, distance."""
    of = Window.partitionBy("q").orderBy(F.round("d2", 9), "x")
    return (
        distances.withColumn("rank", F.row_number().over(of))
        .filter(F.col("rank") <= k)
        .select(F.col("q").alias("vec_id"), "rank", F.col("x").alias("neighbor_id"), F.round(F.sqrt("d2"), 6).alias("distance"))
    )


def rounds(vectors: DataFrame, d: int, every: int, most: int = QUERIES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of the queries, those whose id is divisible by ``every``, about ``most`` at a time."""
    queries = vectors.filter(F.col("id") % every == 0)
    count = -(-queries.count() // most)
    for k in range(count):
        rows = queries.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(count)) == k).orderBy("id").toArrow()
        if rows.num_rows:
            yield rows.column("id").to_numpy(), matrix(rows.column("v").combine_chunks(), d)


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
