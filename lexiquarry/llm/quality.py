"""Operator 5: a supervised classifier over subword embeddings.

A document is the sum of three averages of learned, hashed vectors: over its
words, over its pairs of neighbouring words and over its character n-grams
(of bytes).  A linear layer with softmax gives the classes.  Vectors and layer
are learned by stochastic gradient descent in numpy, with a step for each
coordinate that shrinks as its gradients add up.

Scoring is linear in the vectors, so that vectors and layer are multiplied
once; what goes to the tasks is one table of fixed size, and a document costs
a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, column, free_name, require
from .textvec import mix, word_hashes

CLASSES = ("clean", "low", "toxic")
#: The classifier is fitted on at most so many labelled documents of each class, those with the smallest hashed ids.
PER_CLASS = 2000
BITS = 18
DIM = 8
EPOCHS = 6
RATE = 1.0
CHARS = (3, 4)
MIN_SEEN = 4
#: Features without a vector that every average counts besides a text's own, so that one word of a short text doesn't decide.
PRIOR = (16, 16, 64)
THRESHOLD = 0.4
#: Texts, or their features, that a task of the fit takes at once.
RECORDS = 256
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BLOCK = 1 << 20
_REPEAT = np.uint64(0x5EED)


@dataclass(frozen=True)
class Model:
    """Class scores of every bucket, a table for each kind of feature, and the biases."""

    scores: np.ndarray
    bias: np.ndarray
    bits: int


def _chars(data: bytes, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the byte n-grams of a text, piece by piece."""
    longest = max(CHARS)
    for at in range(0, max(len(data), 1), _BLOCK):
        b = np.frombuffer(data[at : at + _BLOCK + longest - 1], np.uint8).astype(np.uint32)
        last = at + _BLOCK >= len(data)
        for n in CHARS:
            m = min(len(b) - n + 1, len(b) if last else _BLOCK)
            if m <= 0:
                continue
            code = np.full(m, n, np.uint32)
            for j in range(n):
                code = code * np.uint32(0x01000193) ^ b[j : j + m]
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield code >> np.uint32(32 - bits)


def features(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Buckets of the words, the word pairs and the character n-grams of each text.

    A pair of equal words falls into one bucket of its own, whatever the word.
    """
    shift = np.uint64(64 - bits)
    for first, words, offsets in word_hashes(texts, "word", lower=True):
        pairs = np.where(words[1:] == words[:-1], _REPEAT, mix(words[:-1] * np.uint64(3) + words[1:])) if len(words) else words
        one, two = (mix(words) >> shift).astype(np.uint32), (mix(pairs) >> shift).astype(np.uint32)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            data = (texts[first + i] or "").encode("utf-8", "surrogatepass")
            yield one[a:b], two[a : max(a, b - 1)], list(_chars(data, bits))


def _counts(texts: list[str | None], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and the weight of each: its share among those of its kind."""
    out = []
    for one, two, chars in features(texts, bits):
        ids, weights = [], []
        for kind, x in enumerate((one, two, np.concatenate(chars) if chars else np.empty(0, np.uint32))):
            u, n = np.unique(x, return_counts=True)
            ids.append(u.astype(np.int32) + np.int32(kind << bits))
            weights.append(n / (len(x) + PRIOR[kind]))
        out.append((np.concatenate(ids), np.concatenate(weights).astype(np.float32)))
    return out


def train(texts: list[str | None], classes: np.ndarray, bits: int = BITS, **options) -> Model:
    """Fit vectors and output layer on texts."""
    return _learn(_counts(texts, bits), classes, bits, **options)


def _learn(docs: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """As train, on the features of the texts. Features of fewer than MIN_SEEN texts have no vector."""
    rng = np.random.default_rng(seed)
    size = 3 << bits
    seen = np.zeros(size, np.int32)
    for i, _ in docs:
        seen[i] += 1  # a text's features are distinct
    seen = seen >= MIN_SEEN
    for d, (i, w) in enumerate(docs):  # in place: they are held once
        docs[d] = i[seen[i]], w[seen[i]]
    k = len(CLASSES)
    vectors = np.empty((size, dim), np.float32)
    for at in range(0, size, 1 << 16):
        vectors[at : at + (1 << 16)] = rng.normal(0, 0.1, (min(1 << 16, size - at), dim))
    layer = rng.normal(0, 0.5, (dim, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    g_vectors, g_layer, g_bias = np.full((size, 1), 1e-8, np.float32), np.full((dim, k), 1e-2, np.float32), np.full(k, 1e-2, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for d in rng.permutation(len(docs)):
            ids, w = docs[d]
            if not len(ids):
                continue
            hidden = w @ vectors[ids]
            z = hidden @ layer + bias
            e = np.exp(z - z.max())
            delta = e / e.sum()
            delta[classes[d]] -= 1
            back = layer @ delta
            g_vectors[ids, 0] += w * w * float(back @ back)
            vectors[ids] -= (step * w / np.sqrt(g_vectors[ids, 0]))[:, None] * back
            grad = np.outer(hidden, delta)
            g_layer += grad * grad
            layer -= 0.1 * step * grad / np.sqrt(g_layer)
            g_bias += delta * delta
            bias -= 0.1 * step * delta / np.sqrt(g_bias)
    vectors[~seen] = 0
    return Model((vectors @ layer).astype(np.float32), bias, bits)


def probabilities(model: Model, texts: list[str | None]) -> np.ndarray:
    """Class probabilities of each text; NaN for a text without any feature."""
    out = np.empty((len(texts), len(CLASSES)))
    size = 1 << model.bits
    tables = [model.scores[k * size : (k + 1) * size] for k in range(3)]
    for i, (one, two, chars) in enumerate(features(texts, model.bits)):
        z = model.bias.astype(np.float64)
        n = sum(map(len, chars))
        if not n and not len(one):
            out[i] = np.nan
            continue
        for kind, ids in ((0, [one]), (1, [two]), (2, chars)):
            z = z + sum(tables[kind][x].sum(axis=0, dtype=np.float64) for x in ids) / (sum(map(len, ids)) + PRIOR[kind])
        e = np.exp(z - z.max())
        out[i] = e / e.sum()
    return out


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """At most per_class labelled documents of each class, by the hash of their ids: id, class, text.

    Labels with a null are left out, as are labelled ids without a document,
    before the bound is applied;
    of several labels or texts of an id, one is taken, always the same.
    """
    require(labels, ["doc_id", "quality", "toxic"])
    q, x = column(labels, "quality"), column(labels, "toxic")
    kind = F.when(x == 1, 2).when(q == 0, 1).otherwise(0)
    known = labels.filter(q.isNotNull() & x.isNotNull() & column(labels, "doc_id").isNotNull()).select(column(labels, "doc_id").cast("bigint").alias("id"), kind.alias("class"))
    known = known.join(docs.select(column(docs, "doc_id").cast("bigint").alias("id")), "id", "left_semi")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = None
    for k in range(len(CLASSES)):
        part = known.filter(F.col("class") == k).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(chosen.groupBy("id").agg(F.max("class").alias("class")))  # at most 3 * per_class rows
    texts = docs.select(column(docs, "doc_id").cast("bigint").alias("id"), column(docs, "text").alias("text")).join(chosen, "id")
    return texts.groupBy("id", "class").agg(F.max("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, **options) -> Model | None:
    """A model, or None where fewer than two classes have labelled documents.

    The tasks make the features of the sampled texts, of which there are at
    most 3 << bits each however long the text; one task learns from them,
    and only the model, of fixed size, comes to the driver.
    """
    found = "place bigint, id bigint, class int, features binary, weights binary"
    learned = "scores binary, bias binary"
    found_schema, learned_schema = arrow_schema(found), arrow_schema(learned)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                ids, weights = zip(*_counts(piece.column(3).to_pylist(), bits))
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (ids, weights))], schema=found_schema)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, classes = [], []
        for batch in batches:
            classes += batch.column(2).to_pylist()
            held += [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.float32)) for i, w in zip(batch.column(3), batch.column(4))]
        batch = None
        if len(set(classes)) > 1:
            model = _learn(held, np.array(classes), bits, **options)
            yield pa.RecordBatch.from_arrays([pa.array([model.scores.tobytes()], pa.binary()), pa.array([model.bias.tobytes()], pa.binary())], schema=learned_schema)

    rows = sample(docs, labels, per_class).select(F.xxhash64("id").alias("place"), "id", F.col("class").cast("int").alias("class"), "text").mapInArrow(count, found)
    conf = docs.sparkSession.conf
    before = conf.get(_RECORDS)
    conf.set(_RECORDS, str(RECORDS))
    try:
        model = rows.repartition(1).sortWithinPartitions("place", "id").mapInArrow(learn, learned).collect()  # at most a row
    finally:
        conf.set(_RECORDS, before)
    if not model:
        return None
    return Model(np.frombuffer(bytes(model[0]["scores"]), np.float32).reshape(3 << bits, len(CLASSES)), np.frombuffer(bytes(model[0]["bias"]), np.float32), bits)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, names: tuple[str, str, str] = ("p_clean", "p_low", "p_toxic"), **options) -> DataFrame:
    """The table with the probabilities of the three classes added.

    labels has doc_id, quality (0 or 1) and toxic (0 or 1): a toxic document
    is of class toxic, another of quality 0 of class low, the rest are clean.

    Null and empty texts have null probabilities; so has every row where
    fewer than two classes have labelled documents.  Texts are scored whole,
    whatever their length; repeated rows score alike; ids may be null and
    other columns are kept, but for any of the names given here.
    """
    require(docs, ["doc_id", "text"])
    model = fit(docs, labels, per_class, **options)
    held = free_name(docs, "scored")
    kind = "struct<a: double, b: double, c: double>"
    if model is None:
        out = docs.withColumn(held, F.lit(None).cast(kind))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

        @F.pandas_udf(kind)
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame(probabilities(shared.value, texts.tolist()), columns=["a", "b", "c"])

        out = docs.withColumn(held, score(column(docs, "text")))
    drop_nan = [F.when(~F.isnan(F.col(held)[x]), F.col(held)[x]).alias(n) for x, n in zip("abc", names)]
    return out.select(*[column(out, c) for c in docs.columns if c not in names], *drop_nan)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, score: str | None = None, **options) -> DataFrame:
    """The documents that aren't rejected: those whose p_clean is at least threshold, or null (see classify).

    The columns are those of the table, and p_clean under the name ``score``, if given.
    """
    mine = tuple(free_name(docs, x) for x in ("p_clean", "p_low", "p_toxic"))
    out = classify(docs, labels, names=mine, **options)
    kept = out.filter(F.coalesce(F.col(mine[0]) >= threshold, F.lit(True)))
    return kept.select(*[column(kept, c) for c in docs.columns], *([F.col(mine[0]).alias(score)] if score else []))
