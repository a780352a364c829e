"""Operator 6: exact nearest neighbours by vector-approximation files.

Every vector is approximated by the cell of a grid that it lies in, one byte
a dimension, with the distance to the cell's centre.  A query's distance to
the centre, less and plus that, bounds its distance to the vector.  A number
of queries go to every task, and the tasks scan their approximations; what
remains of each query are the vectors whose lower bound is at most the k-th
smallest upper bound.  Exact vectors are then read in the order of the lower
bounds, a few a round, until a query's k-th distance is below the next lower
bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema
from .vectors import ABREAST, QUERIES, clean, matrix, measured, ranked, rounds, together

K = 10
LEVELS = 256
#: Vectors that are read for each open query in a round, beyond k.
STEP = 8
#: What float32 products may be off by, relative to the squared norms.
SLACK = 4e-6


def _coded(vectors: DataFrame, d: int, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """The approximations: id, code (a byte a dimension), error (distance to the cell's centre)."""
    ddl = "id bigint, code binary, error float"
    schema = arrow_schema(ddl)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), d)
            codes = np.clip(np.floor((v - low) / width), 0, LEVELS - 1).astype(np.uint8)
            errors = np.sqrt(((v - (low + (codes + 0.5) * width)) ** 2).sum(1)).astype(np.float32) * np.float32(1 + 1e-6)
            places = pa.py_buffer(np.arange(0, len(v) * d + 1, d, dtype=np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(v), [None, places, pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(errors)], schema=schema)

    return vectors.select("id", "v").mapInArrow(code, ddl)


def _scan(coded: DataFrame, d: int, k: int, low: np.ndarray, width: np.ndarray, queries) -> DataFrame:
    """Candidates of the queries: q, x, lb, ub. Each task keeps those that its own k-th smallest upper bound allows."""
    ddl = "q bigint, x bigint, lb double, ub double"
    schema = arrow_schema(ddl)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        norms = (q.astype(np.float64) ** 2).sum(1).astype(np.float32)
        uppers = np.full((len(q), k), np.inf, np.float32)
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def within() -> tuple[np.ndarray, ...]:
            i, x, lb, ub = (np.concatenate(c) for c in zip(*found))
            ok = lb <= uppers.max(axis=1)[i]
            return i[ok], x[ok], lb[ok], ub[ok]

        for batch in batches:
            if not batch.num_rows:
                continue
            names, errors = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, d)
            c = (low + (codes + 0.5) * width).astype(np.float32)
            squares = (c.astype(np.float64) ** 2).sum(1).astype(np.float32)
            for at in range(0, len(q), ABREAST):
                some = slice(at, at + ABREAST)
                sums = norms[some, None] + squares
                d2 = sums - 2 * (q[some] @ c.T)
                sums *= SLACK
                near = np.sqrt(np.maximum(d2 - sums, 0))
                near -= errors
                near[near <= 0] = 0
                near[ids[some, None] == names] = np.inf
                limit = uppers[some].max(axis=1)
                i, j = np.nonzero(near <= limit[:, None])
                if not len(i):
                    continue
                lb = near[i, j]
                ub = np.where(np.isinf(lb), np.inf, np.sqrt(np.maximum(d2[i, j] + sums[i, j], 0)) + errors[j]).astype(np.float32)
                starts = np.searchsorted(i, np.arange(len(limit) + 1))
                order = np.lexsort((ub, i))
                place = np.arange(len(i)) - starts[i[order]]
                best = np.full((len(limit), k), np.inf, np.float32)
                top = place < k
                best[i[order][top], place[top]] = ub[order][top]
                uppers[some] = np.partition(np.concatenate([uppers[some], best], axis=1), k - 1, axis=1)[:, :k]
                keep = (lb <= uppers[some].max(axis=1)[i]) & np.isfinite(lb)
                found.append((i[keep] + at, names[j[keep]], lb[keep], ub[keep]))
                held += int(keep.sum())
                if held > 32 * k * len(q):
                    found = [within()]
                    held = len(found[0][0])
        if found:
            i, x, lb, ub = within()
            for at in range(0, len(i), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[s]]), pa.array(x[s]), pa.array(lb[s].astype(np.float64)), pa.array(ub[s].astype(np.float64))], schema=schema)

    return coded.mapInArrow(scan, ddl)


def search(table: DataFrame, k: int = K, id_name: str = "vec_id", vector_name: str = "embedding", every: int = 1, queries: int = QUERIES, step: int = STEP) -> DataFrame:
    """The k nearest other vectors of every query, exactly: vec_id, rank, neighbor_id, distance (Euclidean, 6 digits).

    Queries are the vectors whose id is divisible by ``every``, and all
    vectors are searched.  The queries are taken ``queries`` at a time, each
    time in a pass over the approximations, which no shuffle moves.
    Ties, squared distances equal to 9 digits, go to the smaller id.  Which
    rows are usable is told by vectors.clean: nulls, NaN and odd lengths are
    left out as queries and as neighbours, and repeated ids count once.
    Equal vectors under different ids are neighbours at distance 0.  Where
    there are fewer than k others, all are returned; one vector or an empty
    table gives no rows; other columns aren't read.
    """
    spark = table.sparkSession
    tables = Tables(spark, "va")
    vectors, d = clean(table, tables, id_name, vector_name)
    n = vectors.count()
    none = spark.createDataFrame([], "vec_id bigint, rank int, neighbor_id bigint, distance double")
    if not n:
        return none
    ends = vectors.agg(*[f(F.col("v")[i]) for i in range(d) for f in (F.min, F.max)]).first()
    low = np.array(ends[0::2], np.float64)
    width = np.maximum((np.array(ends[1::2], np.float64) - low) / LEVELS, 1e-12)
    coded = tables.write(_coded(vectors, d, low, width), "coded")
    parts = []
    for ids, v in rounds(vectors, d, every, queries):
        sent = spark.sparkContext.broadcast((ids, v))  # of bounded size
        parts.append(tables.write(_scan(coded, d, k, low, width, sent), "found"))
        sent.unpersist()
    if not parts:
        return none
    found = together(parts)
    kth_upper = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("ub", "x"))).filter(F.col("r") == k).select(F.col("q").alias("q_l"), F.col("ub").alias("limit"))
    within = found.join(kth_upper, F.col("q") == F.col("q_l"), "left").filter(F.col("limit").isNull() | (F.col("lb") <= F.col("limit"))).select("q", "x", "lb")
    of = Window.partitionBy("q").orderBy("lb", "x")
    candidates = tables.write(within.withColumn("place", F.row_number().over(of)), "candidates")
    tables.drop(coded, *parts)
    known = None
    open_ = candidates
    at, reach = 0, k + step
    while True:
        read = open_.filter((F.col("place") > at) & (F.col("place") <= reach)).select("q", "x")
        exact = measured(read, vectors, d)
        now = tables.write(exact if known is None else known.unionByName(exact), "exact")
        if known is not None:
            tables.drop(known)
        known = now
        kth = known.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d2"))).filter(F.col("r") == k).select(F.col("q").alias("done"), F.sqrt("d2").alias("kth"))
        rest = candidates.filter(F.col("place") > reach)
        # Rounded keys tie: a lower bound must exceed the k-th distance by more than that.
        left = rest.join(kth, F.col("q") == F.col("done"), "left").filter(F.col("kth").isNull() | (F.col("lb") <= F.col("kth") + 1e-6)).select("q", "x", "lb", "place")
        open_ = tables.write(left, "open")
        if open_.isEmpty():
            break
        at, reach = reach, reach + 4 * step
        step *= 2
    return ranked(known, k)


def sql(k: int = K, every: int = 1) -> str:
    """search over embeddings in DuckDB's SQL, for vectors of 64 components without nulls."""
    return f"""
WITH v AS (SELECT vec_id, max(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 GROUP BY vec_id),
pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id,
         list_sum(list_transform(range(1, 65), lambda i: (CAST(a.e[i] AS DOUBLE) - CAST(b.e[i] AS DOUBLE)) * (CAST(a.e[i] AS DOUBLE) - CAST(b.e[i] AS DOUBLE)))) AS d2
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), neighbor_id) AS rank FROM pairs)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(sqrt(d2), 6) AS distance FROM placed WHERE rank <= {k}
"""
