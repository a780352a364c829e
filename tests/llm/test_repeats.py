"""Operator 4 against its SQL and against brute force."""

import random

import duckdb
import pytest

from lexiquarry.llm import suffix_repeats

DDL = "doc_id bigint, text string, key string, pos int, rank int"


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = lambda k: [rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40)) for _ in range(k)]
    passages = [words(rng.choice([9, 10, 11, 12, 30, 70])) for _ in range(6)]
    out = []
    for i in range(n):
        text = words(rng.randrange(0, 30))
        for _ in range(rng.randrange(3)):
            text += rng.choice(passages)[: rng.randrange(5, 80)] + words(rng.randrange(4))
        out.append((i, rng.choice([" ", "  ", "\n"]).join(text)))
    long = " ".join(words(4000))
    out += [(n, long), (n + 1, "x " + long), (n + 2, "q r s t " * 60), (n + 3, ""), (n + 4, None), (None, long), (n + 5, out[0][1]), (n + 5, long[:3000]), (n + 5, long[:3000]), (n + 6, "q " * 100), (n + 7, "q " * 11)]
    return out


def brute(rows, t):
    seen = {}
    texts = sorted({(d, x) for d, x in rows if d is not None and x is not None})
    for d, x in texts:
        w = x.split()
        for i in range(len(w) - t + 1):
            seen.setdefault(tuple(w[i : i + t]), set()).add(d)
    out = set()
    for d, x in texts:
        w = x.split()
        hits = [i for i in range(len(w) - t + 1) if len(seen[tuple(w[i : i + t])]) > 1]
        spans = []
        for i in hits:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + t
            else:
                spans.append([i, i + t])
        out |= {(d, a, b, b - a) for a, b in spans}
    return sorted(out)


@pytest.mark.parametrize("threshold, seed_words, set_minima", [(10, 16, 10**6), (10, 2, 10**6), (11, 3, 0), (50, 16, 10**6), (2, 16, 10**6)])
def test_against_brute_force(spark, threshold, seed_words, set_minima):
    rows = corpus(threshold)
    docs = spark.createDataFrame([(d, x, "k", 1, 2) for d, x in rows], DDL).repartition(4)
    got = sorted(tuple(r) for r in suffix_repeats.repeats(docs, threshold, seed_words, set_minima).collect())
    assert got == brute(rows, threshold) and got


def test_sql(spark):
    rows = corpus(7)
    con = duckdb.connect()
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").toPandas().astype({"doc_id": "Int64"})
    con.register("documents", documents)
    assert sorted(con.sql(suffix_repeats.sql(10)).fetchall()) == brute(rows, 10)


def test_empty(spark):
    assert suffix_repeats.repeats(spark.createDataFrame([], DDL)).count() == 0
    assert suffix_repeats.repeats(spark.createDataFrame([(1, "a b c", "", 0, 0)], DDL)).count() == 0
