"""Operators 2 and 6 against brute force."""

import duckdb
import numpy as np
import pytest

from lexiquarry.llm import ivf_pq, va_file
from lexiquarry.llm.common import Tables

DDL = "vec_id bigint, embedding array<float>, label int, q bigint, block int"


def table(spark, x, extra=()):
    rows = [(i, [float(c) for c in v], 0, 1, 2) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, DDL).repartition(3)


def brute(x, k):
    x = x.astype(np.float64)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    out = {}
    for i, row in enumerate(np.round(d2, 9)):
        order = np.lexsort((np.arange(len(x)), row))[: min(k, len(x) - 1)]
        out[i] = [(int(j), round(float(np.sqrt(d2[i, j])), 6)) for j in order]
    return out


def vectors(n, d, kind, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "grid":
        x = np.round(x)
    if kind == "far":
        x = x * 1e-3 + 100
    return x


def got_of(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r.vec_id, []).append((r.neighbor_id, r.distance))
        assert len(out[r.vec_id]) == r.rank
    return out


@pytest.mark.parametrize("kind, n, d, k, step", [("unit", 400, 64, 10, 8), ("grid", 300, 3, 5, 1), ("far", 200, 7, 4, 2), ("unit", 5, 4, 10, 8)])
def test_va_file_is_exact(spark, kind, n, d, k, step):
    x = vectors(n, d, kind)
    extra = [(None, [0.0] * d, 0, 0, 0), (9000, None, 0, 0, 0), (9001, [0.0] * (d + 1), 0, 0, 0), (9002, [float("nan")] * d, 0, 0, 0), (9003, [None] * d, 0, 0, 0), (0, [float(c) for c in x[0]], 0, 0, 0)]
    assert got_of(va_file.search(table(spark, x, extra), k, queries=150, step=step)) == brute(x, k)


def test_va_file_sql(spark):
    x = vectors(80, 64, "unit", 3)
    con = duckdb.connect()
    embeddings = table(spark, x).toPandas()
    con.register("embeddings", embeddings)
    want = brute(x, 10)
    some = con.sql(va_file.sql(every=50)).fetchall()
    assert {r[0] for r in some} == {0, 50} and set(some) <= set(con.sql(va_file.sql()).fetchall())
    rows = con.sql(va_file.sql()).fetchall()
    assert sorted(rows) == sorted((i, r + 1, j, dist) for i, near in want.items() for r, (j, dist) in enumerate(near))


@pytest.mark.parametrize("search", [va_file.search, ivf_pq.search])
def test_queries_are_a_stated_set(spark, search):
    x = vectors(230, 6, "unit", 5)
    want = brute(x, 10)
    got = got_of(search(table(spark, x), every=50))
    assert got == {i: want[i] for i in range(0, 230, 50)}
    assert search(table(spark, x[1:3], [(51, [1.0] * 6, 0, 0, 0)]).filter("vec_id > 0"), every=50).count() == 0


def test_ivf_pq_probes_few_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 3 + rng.normal(size=(3000, 16)) * 0.1).astype(np.float32)
    flat = vectors(3000, 16, "unit", 4)
    probes = []
    for v in (x, flat):
        frame = table(spark, v).selectExpr("vec_id AS id", "embedding AS v")
        centres = ivf_pq.coarse(frame, 60, 16)
        probes.append(ivf_pq.needed_probes(frame, centres, 16, 10))
    assert probes[0] < 12 < probes[1]
    got, want = got_of(ivf_pq.search(table(spark, x), every=7, cells=1.0, fit=500)), brute(x, 10)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 10 for i in got]) >= 0.9 and len(got) == 429


@pytest.mark.parametrize("kind, n, d", [("unit", 2000, 64), ("grid", 500, 5), ("far", 600, 8)])
def test_ivf_pq_recall(spark, kind, n, d):
    x = vectors(n, d, kind, 1)
    got, want = got_of(ivf_pq.search(table(spark, x))), brute(x, 10)
    assert got.keys() == want.keys()
    found = np.mean([sum(dist <= near[-1][1] + 1e-6 for _, dist in got[i]) / 10 for i, near in want.items()])
    assert found >= 0.93
    for i in range(0, n, 97):
        for j, dist in got[i]:
            assert dist == pytest.approx(np.linalg.norm(x[i].astype(float) - x[j]), abs=1e-5) and i != j


def test_a_cell_with_a_third_of_all_vectors(spark):
    x = vectors(900, 8, "unit", 6)
    x[::3] = x[0]
    got = got_of(ivf_pq.search(table(spark, x), every=9, block=4, probes=10**6, fit=100))
    assert len(got) == 100 and all(dist == 0 for i in got for _, dist in got[i] if i % 3 == 0)
    filed = {}
    model = spark.sparkContext.broadcast((x[:5], ivf_pq.codebooks(table(spark, x).selectExpr("vec_id AS id", "embedding AS v"), x[:5], 8)))
    for r in ivf_pq._filed(table(spark, x).selectExpr("vec_id AS id", "embedding AS v"), model, 8, 4, Tables(spark, "t")).collect():
        filed.setdefault(r.cell, []).extend(np.frombuffer(r.ids, np.int64).tolist())
    assert sorted(sum(filed.values(), [])) == list(range(900)) and max(map(len, filed.values())) >= 300


@pytest.mark.parametrize("search", [va_file.search, ivf_pq.search])
def test_small_tables(spark, search):
    x = vectors(3, 4, "unit")
    assert got_of(search(table(spark, x))) == brute(x, 10)
    same = np.ones((20, 4), np.float32)
    got = got_of(search(table(spark, same)))
    assert all(len(v) == 10 and all(dist == 0 for _, dist in v) for v in got.values()) and len(got) == 20
    assert search(table(spark, x[:1])).count() == 0
    assert search(table(spark, x).limit(0)).count() == 0
    assert search(table(spark, x[:0], [(1, None, 0, 0, 0), (2, [], 0, 0, 0)])).count() == 0
