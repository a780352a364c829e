"""Operator 5: held-out accuracy and corner cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lexiquarry.llm import quality

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, scored string, p_clean string"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus(n, seed=3):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "was"]
    out = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeioustnrl") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(30, 200))]
        kind = i % 4 if i % 4 < 3 else 0
        if kind == 1:
            words = [w.upper() + "!!" for w in words] if i % 8 < 4 else [w for w in words[:20] for _ in range(6)]
        if kind == 2:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["grobnik", "vilefoul", "sludgeface"])
        out.append((i, " ".join(words), kind))
    return out


def frames(spark, rows, extra=()):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t, _ in rows] + list(extra), DDL).repartition(3)
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2), "clash") for i, _, k in rows], LABELS)
    return docs, labels


def test_held_out_accuracy(spark):
    rows = corpus(1200)
    docs, _ = frames(spark, rows)
    _, labels = frames(spark, [r for r in rows if r[0] % 3])
    out = {r.doc_id: r for r in quality.classify(docs, labels, names=("a", "b", "c")).collect()}
    held = [(k, out[i]) for i, _, k in rows if i % 3 == 0]
    right = np.mean([int(np.argmax([r.a, r.b, r.c])) == k for k, r in held])
    assert right > 0.95
    assert out[0].scored == "x" and out[0].p_clean == "y"
    kept = {r.doc_id for r in quality.keep(docs, labels).collect()}
    assert np.mean([r.doc_id in kept for k, r in held if k == 0]) > 0.97
    assert np.mean([r.doc_id in kept for k, r in held if k]) < 0.07
    assert quality.keep(docs, labels).columns == docs.columns


def test_corner_cases(spark):
    rows = corpus(200)
    extra = [(None, None, None, None, None, None, None), (900, "", "en", "s", 0, "", ""), (901, "the of and " * 200_000, "en", "s", 0, "", ""), (902, rows[0][1], "en", "s", 0, "", ""), (902, rows[0][1], "en", "s", 0, "", "")]
    docs, labels = frames(spark, rows, extra)
    nulls = spark.createDataFrame([(None, 1, 0, ""), (5, None, 0, ""), (5, 1, None, ""), (10**9, 0, 1, "")], LABELS)
    out = quality.classify(docs, labels.unionByName(nulls), names=("a", "b", "c"), epochs=2).collect()
    assert len(out) == 205
    by = {r.doc_id: r for r in out}
    assert by[None].a is None and by[900].a is None and by[901].a is not None
    assert by[902].a == by[0].a
    assert quality.keep(docs, labels.limit(0)).count() == 205
    assert quality.keep(docs.limit(0), labels).count() == 0
    assert {None, 900} <= {r.doc_id for r in quality.keep(docs, labels, epochs=2).collect()}


def test_sample_is_bounded_and_settled(spark):
    docs, labels = frames(spark, corpus(300))
    a, b = (x.orderBy("id").toPandas() for x in (quality.sample(docs, labels, 20), quality.sample(docs.repartition(5), labels.repartition(2), 20)))
    assert a.equals(b) and a["class"].value_counts().tolist() == [20, 20, 20]


def plain_sgd(docs, classes, size, dim, epochs, rate, seed):
    """The same descent in plain numbers, feature by feature. docs: features and weights; returns scores and bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (size, dim)).astype(np.float32).astype(float).tolist()
    layer = rng.normal(0, 0.5, (dim, 3)).astype(np.float32).astype(float).tolist()
    bias, seen = [0.0] * 3, Counter(i for d in docs for i in d)
    docs = [{i: w for i, w in d.items() if seen[i] >= quality.MIN_SEEN} for d in docs]
    gv, gl, gb = [1e-8] * size, [[1e-2] * 3 for _ in range(dim)], [1e-2] * 3
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for d in rng.permutation(len(docs)):
            if not docs[d]:
                continue
            hidden = [sum(w * vectors[i][k] for i, w in docs[d].items()) for k in range(dim)]
            z = [sum(hidden[k] * layer[k][c] for k in range(dim)) + bias[c] for c in range(3)]
            e = [math.exp(x - max(z)) for x in z]
            delta = [x / sum(e) - (c == classes[d]) for c, x in enumerate(e)]
            back = [sum(layer[k][c] * delta[c] for c in range(3)) for k in range(dim)]
            for i, w in docs[d].items():
                gv[i] += w * w * sum(x * x for x in back)
                for k in range(dim):
                    vectors[i][k] -= step * w / math.sqrt(gv[i]) * back[k]
            for k in range(dim):
                for c in range(3):
                    g = hidden[k] * delta[c]
                    gl[k][c] += g * g
                    layer[k][c] -= 0.1 * step * g / math.sqrt(gl[k][c])
            for c in range(3):
                gb[c] += delta[c] ** 2
                bias[c] -= 0.1 * step * delta[c] / math.sqrt(gb[c])
    scores = [[sum(v[k] * layer[k][c] for k in range(dim)) if seen[i] >= quality.MIN_SEEN else 0.0 for c in range(3)] for i, v in enumerate(vectors)]
    return np.array(scores), np.array(bias)


def test_brute_force_descent_and_scores(spark):
    rows = corpus(60, seed=8)
    texts, kinds = [t for _, t, _ in rows], np.array([k for _, _, k in rows])
    model = quality.train(texts, kinds, bits=10, dim=3, epochs=2)
    docs = [dict(zip(i.tolist(), w.astype(float).tolist())) for i, w in quality._counts(texts, 10)]
    scores, bias = plain_sgd(docs, kinds, 3 << 10, 3, 2, quality.RATE, 7)
    assert np.allclose(model.scores, scores, atol=2e-3) and np.allclose(model.bias, bias, atol=2e-3) and np.abs(scores).max() > 0.1

    # Fitted in tasks, it is the same model but for the order of the texts; scored, each document has what plain sums give.
    frame, labels = frames(spark, rows)
    fitted = quality.fit(frame, labels, bits=10, dim=3, epochs=2)
    order = [r.id for r in quality.sample(frame, labels).selectExpr("id", "xxhash64(id) AS h").orderBy("h", "id").collect()]
    again = quality.train([texts[i] for i in order], kinds[order], bits=10, dim=3, epochs=2)
    assert np.array_equal(fitted.scores, again.scores) and np.array_equal(fitted.bias, again.bias)
    for r in quality.classify(frame, labels, bits=10, dim=3, epochs=2, names=("a", "b", "c")).collect():
        z = fitted.bias.astype(float)
        for i, w in docs[r.doc_id].items():
            z = z + w * fitted.scores[i].astype(float)
        e = np.exp(z - z.max())
        assert (r.a, r.b, r.c) == pytest.approx(tuple(e / e.sum()), abs=1e-4)
