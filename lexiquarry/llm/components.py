"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema

_EDGES = "a bigint, b bigint"
_HELD = 1 << 20


def _forest(edges: DataFrame) -> DataFrame:
    """Each task replaces the edges that it reads by stars around the smallest node of each of its own components."""
    schema = arrow_schema(_EDGES)

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, find(x)) for x in list(root)]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) > _HELD:
                yield stars()
                root.clear()
        yield stars()

    return edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).mapInArrow(contract, _EDGES)


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """The nodes of edges (a, b) with the smallest node that each is connected to: node, root.

    Rounds go on until nothing changes; their number grows with the logarithm
    of the largest component, and each is written, as every round reads the
    one before.
    """
    state = tables.write(_forest(edges).filter("a <> b").distinct(), "stars")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(state)
    while True:
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        of = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(of))).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(of))
        after = small.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("v").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        after = tables.write(after, "stars")
        now = mark(after)
        tables.drop(state)
        state = after
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
