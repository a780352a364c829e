"""Operator 2: approximate nearest neighbours by an inverted file with product quantisation.

Coarse centroids and the codebooks of the residuals are fitted by Lloyd's
iterations on a sample of FIT vectors, or FIT_CELL for each cell where these
are more: those with the smallest hashed ids.  Every vector is filed under
its nearest centroid as one byte for every two dimensions.  A query probes
its nearest cells: with a table of its products with all codewords, the
distance to a filed vector is a sum of table entries, a constant of the
vector and a constant of query and cell.  The best by these distances are
reranked on exact vectors.

How many cells are probed is measured: the exact neighbours of a few vectors
are searched among all, and as many cells are probed as hold TARGET of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema
from .vectors import ABREAST, QUERIES, clean, matrix, measured, nearest, ranked, rounds, summed, together

K = 10
#: Cells of the inverted file: this times the square root of the number of vectors.
CELLS = 0.25
FIT, FIT_CELL = 65_536, 64
#: Cells are probed until they hold this share of the exact neighbours of TRIED vectors, those with the smallest hashed ids.
TARGET, TRIED = 0.97, 256
RERANK = 32
CODEWORDS = 256
ITERATIONS = 5
BLOCK = 1024
#: Blocks of a cell that one task files.
HOT = 64


def _first(vectors: DataFrame, n: int, d: int) -> np.ndarray:
    """n vectors to begin with, those with the smallest hashed ids."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(n).select("v").collect()  # n is fixed or a share of the cells
    return np.array([r[0] for r in rows], np.float32).reshape(-1, d)


def coarse(vectors: DataFrame, cells: int, d: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Centroids of the vectors."""
    centres = _first(vectors, cells, d)
    k = len(centres)
    for _ in range(iterations):

        def add(total: np.ndarray, batch: pa.RecordBatch, centres=centres) -> None:
            x = matrix(batch.column(0), d)
            of = nearest(x, centres)
            sums = total.reshape(k, d + 1)
            np.add.at(sums[:, :d], of, x)
            sums[:, d] += np.bincount(of, minlength=k)

        total = summed(vectors.select("v"), add, k * (d + 1)).reshape(k, d + 1)
        full = total[:, d] > 0
        centres = centres.copy()
        centres[full] = (total[full, :d] / total[full, d:]).astype(np.float32)
    return centres


def _parts(d: int) -> list[slice]:
    return [slice(a, min(a + 2, d)) for a in range(0, d, 2)]


def codebooks(vectors: DataFrame, centres: np.ndarray, d: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Codewords of the residuals of the vectors: parts x codewords x 2 (0 behind an odd dimension)."""
    start = _first(vectors, CODEWORDS, d)
    start = start - centres[nearest(start, centres)]
    parts = _parts(d)
    words = np.zeros((len(parts), len(start), 2), np.float32)
    for m, s in enumerate(parts):
        words[m, :, : s.stop - s.start] = start[:, s]
    k = len(start)
    for _ in range(iterations):

        def add(total: np.ndarray, batch: pa.RecordBatch, words=words) -> None:
            x = matrix(batch.column(0), d)
            r = x - centres[nearest(x, centres)]
            sums = total.reshape(len(parts), k, 3)
            for m, s in enumerate(parts):
                w = s.stop - s.start
                of = nearest(r[:, s], words[m, :, :w])
                for c in range(w):
                    sums[m, :, c] += np.bincount(of, r[:, s.start + c], k)
                sums[m, :, 2] += np.bincount(of, minlength=k)

        total = summed(vectors.select("v"), add, len(parts) * k * 3).reshape(len(parts), k, 3)
        full = total[:, :, 2] > 0
        words = words.copy()
        words[full] = (total[:, :, :2][full] / total[:, :, 2][full][:, None]).astype(np.float32)
    return words


def encode(r: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Codes of residuals, one byte a part."""
    return np.stack([nearest(r[:, s], words[m, :, : s.stop - s.start]) for m, s in enumerate(_parts(r.shape[1]))], axis=1).astype(np.uint8)


def _filed(vectors: DataFrame, model, d: int, block: int, tables: Tables) -> DataFrame:
    """The inverted file in blocks of at most ``block`` vectors of a cell: cell, block, ids, codes, constants."""
    assigned = "cell int, id bigint, v array<float>"
    first = arrow_schema(assigned)
    ddl = "cell int, block int, ids binary, codes binary, constants binary"
    schema = arrow_schema(ddl)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(nearest(matrix(batch.column(1), d), centres).astype(np.int32)), batch.column(0), batch.column(1).cast(first.field(2).type)], schema=first)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, words = model.value
        cell, number = None, 0
        ids, held = np.empty(0, np.int64), np.empty((0, d), np.float32)

        def flush(n: int) -> pa.RecordBatch:
            c = centres[cell]
            codes = encode(held[:n] - c, words)
            r = np.concatenate([words[m, codes[:, m], : s.stop - s.start] for m, s in enumerate(_parts(d))], axis=1)
            constants = ((r * r).sum(1) + 2 * r @ c).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([number], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[:n], codes, constants))], schema=schema)

        for batch in batches:
            of, names, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), d)
            cuts = np.flatnonzero(np.diff(of)) + 1
            for b, i, x in zip(np.split(of, cuts), np.split(names, cuts), np.split(v, cuts)):
                if not len(b):
                    continue
                if cell is not None and cell != b[0]:
                    if len(ids):
                        yield flush(len(ids))
                    ids, held, number = ids[:0], held[:0], 0
                cell = int(b[0])
                ids, held = np.concatenate([ids, i]), np.concatenate([held, x])
                while len(ids) >= block:
                    yield flush(block)
                    ids, held, number = ids[block:], held[block:], number + 1
        if cell is not None and len(ids):
            yield flush(len(ids))

    placed = tables.write(vectors.mapInArrow(assign, assigned), "assigned")
    # A cell may hold a third of all vectors: such ones are divided among tasks.
    large = placed.groupBy("cell").agg(F.ceil(F.count("*") / (HOT * block)).alias("parts")).filter("parts > 1")  # at most a row a cell
    salted = placed.join(F.broadcast(large), "cell", "left").select("cell", "id", "v", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("salt"))
    return salted.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "id").select("cell", "id", "v").mapInArrow(file, ddl)


def _probed(filed: DataFrame, model, d: int, probes: int, rerank: int, queries) -> DataFrame:
    """For each query the best ``rerank`` of each task by table distances: q, x, near."""
    ddl = "q bigint, x bigint, near float"
    schema = arrow_schema(ddl)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        centres, words = model.value
        norms = (centres**2).sum(1)
        parts = _parts(d)
        n = min(probes, len(centres))
        mine = np.zeros((len(q), len(centres)), bool)
        for at in range(0, len(q), ABREAST):
            s = slice(at, at + ABREAST)
            np.put_along_axis(mine[s], np.argpartition(norms - 2 * q[s] @ centres.T, n - 1, axis=1)[:, :n], True, axis=1)
        best = np.full((len(q), rerank), np.inf, np.float32)
        names_of = np.zeros((len(q), rerank), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                cell = batch.column(0)[r].as_py()
                names = np.frombuffer(batch.column(1)[r].as_buffer(), np.int64)
                codes = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint8).reshape(len(names), len(parts))
                constants = np.frombuffer(batch.column(3)[r].as_buffer(), np.float32)
                who = np.flatnonzero(mine[:, cell])
                for some in np.array_split(who, -(-len(who) // 256)) if len(who) else ():
                    v = q[some]
                    dist = ((v * v).sum(1) + norms[cell] - 2 * v @ centres[cell])[:, None] + constants
                    for m, s in enumerate(parts):
                        dist += np.take(-2 * v[:, s] @ words[m, :, : s.stop - s.start].T, codes[:, m], axis=1)
                    dist[ids[some][:, None] == names] = np.inf
                    better = np.flatnonzero((dist < best[some].max(1)[:, None]).any(1))
                    if not len(better):
                        continue
                    rows = some[better]
                    both = np.concatenate([best[rows], dist[better]], axis=1)
                    top = np.argpartition(both, rerank - 1, axis=1)[:, :rerank]
                    known = np.concatenate([names_of[rows], np.broadcast_to(names, (len(rows), len(names)))], axis=1)
                    best[rows], names_of[rows] = np.take_along_axis(both, top, axis=1), np.take_along_axis(known, top, axis=1)
        got = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, got.sum(1))), pa.array(names_of[got]), pa.array(best[got])], schema=schema)

    return filed.select("cell", "ids", "codes", "constants").mapInArrow(probe, ddl)


def needed_probes(vectors: DataFrame, centres: np.ndarray, d: int, k: int, tried: int = TRIED, target: float = TARGET) -> int:
    """The number of nearest cells that hold ``target`` of the exact k nearest neighbours of ``tried`` vectors."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(tried).select("id", "v").collect()  # of bounded size
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32).reshape(-1, d)))
    ddl = "q int, d2 float, cell int"
    schema = arrow_schema(ddl)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best, cells = np.full((len(q), k), np.inf, np.float32), np.zeros((len(q), k), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            names, x = batch.column(0).to_numpy(), matrix(batch.column(1), d)
            dist = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T
            dist[ids[:, None] == names] = np.inf
            of = np.broadcast_to(nearest(x, centres).astype(np.int32), dist.shape)
            both, where = np.concatenate([best, dist], axis=1), np.concatenate([cells, of], axis=1)
            top = np.argpartition(both, k - 1, axis=1)[:, :k]
            best, cells = np.take_along_axis(both, top, axis=1), np.take_along_axis(where, top, axis=1)
        got = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), got.sum(1))), pa.array(best[got]), pa.array(cells[got])], schema=schema)

    of = Window.partitionBy("q").orderBy("d2", "cell")
    near = vectors.select("id", "v").mapInArrow(compare, ddl).withColumn("r", F.row_number().over(of)).filter(F.col("r") <= k).select("q", "cell").collect()  # tried * k rows
    if not near:
        return 1
    q = sent.value[1]
    order = np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    places = np.sort([place[r["q"], r["cell"]] for r in near])
    return int(places[min(len(places) - 1, math.ceil(target * len(places)) - 1)]) + 1


def _centred(vectors: DataFrame, d: int) -> DataFrame:
    """The vectors less their mean: products of far vectors would lose the digits that tell them apart."""
    mean = np.array(vectors.agg(*[F.avg(F.col("v")[i]) for i in range(d)]).first(), np.float64)
    ddl = "id bigint, v array<float>"
    schema = arrow_schema(ddl)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = (matrix(batch.column(1), d) - mean).astype(np.float32)
            offsets = pa.array(np.arange(0, len(v) * d + 1, d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel())).cast(schema.field(1).type)], schema=schema)

    return vectors.mapInArrow(move, ddl)


def search(
    table: DataFrame,
    k: int = K,
    id_name: str = "vec_id",
    vector_name: str = "embedding",
    every: int = 1,
    cells: float = CELLS,
    probes: int | None = None,
    rerank: int = RERANK,
    block: int = BLOCK,
    fit: int = FIT,
    queries: int = QUERIES,
) -> DataFrame:
    """About the k nearest other vectors of every query: vec_id, rank, neighbor_id, distance (exact, Euclidean, 6 digits).

    Queries are the usable vectors (see vectors.clean for nulls, NaN, odd
    lengths and repeated ids) whose id is divisible by ``every``; all usable
    vectors are filed and searched.  Without ``probes``, the cells that a
    query probes, their number is measured (see needed_probes).  Distances
    are exact, only which vectors are compared is approximate; ties go to
    the smaller id.  Where there are fewer than k others, no more are
    returned; one vector or an empty table gives no rows; other columns
    aren't read.
    """
    spark = table.sparkSession
    tables = Tables(spark, "ivf")
    vectors, d = clean(table, tables, id_name, vector_name)
    n = vectors.count()
    none = spark.createDataFrame([], "vec_id bigint, rank int, neighbor_id bigint, distance double")
    if not n:
        return none
    centred = tables.write(_centred(vectors, d), "centred")
    wanted = max(1, round(cells * math.sqrt(n)))
    size = max(fit, FIT_CELL * wanted, CODEWORDS)
    sample = centred if n <= size else tables.write(centred.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(size), "sample")
    centres = coarse(sample, wanted, d)
    model = spark.sparkContext.broadcast((centres, codebooks(sample, centres, d)))  # cells and codewords
    filed = tables.write(_filed(centred, model, d, block, tables), "filed")
    if probes is None:
        probes = needed_probes(centred, centres, d, k)
    parts = []
    for ids, v in rounds(centred, d, every, queries):
        sent = spark.sparkContext.broadcast((ids, v))  # of bounded size
        parts.append(tables.write(_probed(filed, model, d, probes, max(rerank, k), sent), "found"))
        sent.unpersist()
    if not parts:
        return none
    of = Window.partitionBy("q").orderBy("near", "x")
    pairs = tables.write(together(parts).withColumn("r", F.row_number().over(of)).filter(F.col("r") <= max(rerank, k)).select("q", "x"), "pairs")
    tables.drop(filed, centred, *parts)
    return ranked(measured(pairs, vectors, d), k)
