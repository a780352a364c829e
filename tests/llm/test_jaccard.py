"""Operator 7 against brute force and its SQL; connected components."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexiquarry.llm import jaccard_join
from lexiquarry.llm.common import Tables
from lexiquarry.llm.components import components
from lexiquarry.llm.textvec import ngram_sets

DDL = "doc_id bigint, text string, lang string, key string, root int, gone_id int"


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Über", "señor"] + ["".join(rng.choice("abcdeilnorst") for _ in range(5)) for _ in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = list(out[rng.randrange(len(out))][1].split(" "))
            for _ in range(rng.randrange(0, 1 + len(words) // 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))]
        out.append((i, " ".join(words)))
    out += [(n, out[5][1]), (n + 1, out[5][1].upper() + "!"), (n + 2, ""), (n + 3, None), (None, out[5][1]), (n + 4, " .. "), (n + 5, "One"), (n + 6, "one."), (n + 7, "one two"), (7, out[7][1]), (7, out[8][1]), (n + 8, "long words here " * 3000), (n + 9, "long words here " * 2000 + "x")]
    return out


def sets(text, n):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(rows, n, t):
    out = {}
    named = [(d, sets(x, n)) for d, x in rows if d is not None]
    for i, (a, x) in enumerate(named):
        for b, y in named[:i]:
            if a != b and x and y and len(x & y) / len(x | y) >= t:
                key = (min(a, b), max(a, b))
                out[key] = max(out.get(key, 0), len(x & y) / len(x | y))
    return out


def table(spark, rows):
    return spark.createDataFrame([(d, x, "en", "k", 1, 2) for d, x in rows], DDL).repartition(4)


@pytest.mark.parametrize("n, t, orders, bits, block, sent", [(3, 0.5, 2, None, 1500, 10**6), (3, 0.5, 3, 6, 4, 0), (1, 0.8, 1, 10, 3, 10), (2, 0.3, 2, 12, 1500, 10**6)])
def test_pairs(spark, n, t, orders, bits, block, sent):
    rows = corpus(n)
    got = jaccard_join.join(table(spark, rows), n, t, orders=orders, bits=bits, block_texts=block, sent_rows=sent).collect()
    want = brute(rows, n, t)
    assert {(r.doc_a, r.doc_b): pytest.approx(r.jaccard) for r in got} == want and len(got) == len(want) > 20


def brute_classes(rows, n, t):
    """For each distinct (doc_id, text): class and number of links."""
    nodes = list(dict.fromkeys((d, x) for d, x in rows if d is not None))
    of = [sets(x, n) for _, x in nodes]
    parent, links = list(range(len(nodes))), [0] * len(nodes)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if of[i] and of[j] and len(of[i] & of[j]) / len(of[i] | of[j]) >= t:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(nodes):
        first[find(i)] = min(d, first.get(find(i), d))
    return sorted((d, first[find(i)], links[i]) for i, (d, _) in enumerate(nodes))


@pytest.mark.parametrize("orders, bits, block, sent", [(2, None, 1500, 10**6), (3, 6, 4, 0), (1, 10, 3, 10)])
def test_classes(spark, orders, bits, block, sent):
    rows = corpus(11)
    rows += rows[:9] + [(rows[3][0], None), (1000, rows[4][1])] * 2
    got = jaccard_join.classes(table(spark, rows), orders=orders, bits=bits, block_texts=block, sent_rows=sent)
    assert got.columns == ["doc_id", "class_id", "n_links"]
    want = brute_classes(rows, 3, 0.5)
    assert sorted(tuple(r) for r in got.collect()) == want and sum(r[2] for r in want) > 50
    assert jaccard_join.classes(table(spark, rows).limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Every pair is a link, and candidates are made about once an order."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(12):
            words[rng.randrange(400)] = f"x{rng.random()}"
        rows.append((d, " ".join(words)))
    rows += [(200 + d, rows[0][1]) for d in range(50)]
    got = jaccard_join.classes(table(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute_classes(rows, 3, 0.5)
    texts = jaccard_join._texts(table(spark, rows[:150]))
    sets = jaccard_join._shared_sets(texts, 3, 0.5, 60_000, None)
    postings = jaccard_join._postings(sets, 0.5, 0)
    assert jaccard_join._met(postings, 0.5).count() == 150 * 149 // 2
    once = postings.coalesce(1).sortWithinPartitions("gram", "key")
    made = once.mapInArrow(jaccard_join._meeting(0.5), "a bigint, b bigint").count()
    assert made < 1.2 * 150 * 149 // 2


def test_sets_hold_what_texts_share(spark):
    """Against counting, whatever the chunks and ranges."""
    rng = random.Random(6)
    rows = [(d, " ".join(f"w{rng.randrange(7)}" for _ in range(rng.randrange(1, 120)))) for d in range(80)] + [(90, "quite alone it is"), (91, "")]
    texts = jaccard_join._texts(table(spark, rows)).filter("text <> ''")
    of = {r.key: next(iter(ngram_sets([r.text], 3))) for r in texts.collect()}
    df = Counter(g for x in of.values() for g in x.tolist())
    for chunk in (1_000_000, 300):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(jaccard_join, "CHUNK", chunk)
            patch.setattr(jaccard_join, "PACK", 1)
            got = {r.key: r for r in jaccard_join._shared_sets(texts, 3, 0.5, 4000, 64).collect()}
        for key, grams in of.items():
            shared = sorted(g for g in grams.tolist() if df[g] > 1)
            if len(grams) - len(shared) >= jaccard_join.prefix_length(len(grams), 0.5):
                assert key not in got
            else:
                assert np.frombuffer(got[key].cells, np.uint64).tolist() == shared and got[key].size == len(grams)
                assert list(got[key].bands) == [int(8 * np.log2(df[g])) for g in shared]
        assert len(got) > 20


def test_a_very_long_text(spark):
    """Texts beyond the two MiB that are hashed in a piece."""
    words = [f"word{i}" for i in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:300_000])), (3, " ".join(words[300_000:]))]
    got = jaccard_join.classes(table(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_sql(spark):
    rows = corpus(11)
    con = duckdb.connect()
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").toPandas().astype({"doc_id": "Int64"})
    con.register("documents", documents)
    assert sorted(con.sql(jaccard_join.sql()).fetchall()) == brute_classes(rows, 3, 0.5)


def test_one_of_each_group_stays(spark):
    rows = corpus(4)
    docs = table(spark, rows)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in brute(rows, 3, 0.5):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    for d, x in rows:  # texts under the same id connect nothing by themselves
        find(d)
    want = sorted((d is None, d) for d, x in rows if find(d) == d)
    for sent in (10**6, 0):
        out = jaccard_join.distinct_documents(docs, sent_rows=sent)
        assert out.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == want
    assert jaccard_join.distinct_documents(docs.limit(0)).count() == 0
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(80)] + [(5000, 4000), (5000, 4001), (5000, 4001), (-7, -9)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    got = {r.node: r.root for r in components(frame, Tables(spark, "t")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    loops = {a for a, b in edges if a == b}
    assert got == {x: r for x, r in root.items() if x in got} and set(root) - set(got) <= loops
    assert components(frame.limit(0), Tables(spark, "t")).count() == 0
