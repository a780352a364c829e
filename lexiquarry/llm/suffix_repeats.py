"""Operator 4: passages that repeat across documents, by prefix doubling.

Every position of every text has a rank for its first h words; positions with
equal words have equal ranks.  Spark sorts the pairs (rank here, rank h words
on), and a pair's place in that order is the rank for twice as many words.
A position whose rank no other document has is settled and leaves; the rest
go on at a larger offset until the threshold is reached.

Two things keep this small.  The ranks for the first words are hashes, which
need no sort.  And a position enters only if its window of ``threshold``
words may repeat: the smallest hash of a few neighbouring words in a window
is the same for equal windows, and occurs once every twenty words or so, so
one light aggregation over these minima excludes all windows whose minimum
no other document has.  The result is exact for either: equal windows are
never excluded, and windows are compared in full by their ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema, column, require, text_key
from .textvec import ngrams, word_hashes

THRESHOLD = 50
SEED_WORDS = 16
#: Up to so many shared minima go to every task as one sorted array; beyond, a join takes their place.
SET_MINIMA = 8_000_000


def _seed(threshold: int, seed_words: int) -> int:
    return max(1, min(seed_words, threshold // 2))


def steps(threshold: int, seed: int) -> list[int]:
    """Offsets of the doubling rounds: after each, ranks hold for so many words more."""
    out, length = [], seed
    while length < threshold:
        out.append(min(length, threshold - length))
        length += out[-1]
    return out


def _minima(grams: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the width hashes from each place on."""
    out, have = grams, 1
    while have < width:  # windows double as well
        more = min(have, width - have)
        out = np.minimum(out[:-more], out[more:])
        have += more
    return out


def _windows(texts, threshold: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text of at least threshold words: its index, the hashes of its seed grams, the minimum of every window."""
    for first, words, offsets in word_hashes(texts, "space"):
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            if b - a >= threshold:
                grams = ngrams(words[a:b], seed)
                yield first + i, grams, _minima(grams, threshold - seed + 1)


def _named(docs: DataFrame) -> DataFrame:
    text = column(docs, "text")
    return docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), text_key(text).alias("key"), text.alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


def shared_minima(named: DataFrame, threshold: int, seed: int) -> DataFrame:
    """Window minima that two documents or more have."""
    ddl = "minimum bigint, doc_id bigint"
    schema = arrow_schema(ddl)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values, names = [], []
            for i, _, minima in _windows((t.as_py() for t in batch.column(1)), threshold, seed):
                values.append(np.unique(minima))
                names.append(np.full(len(values[-1]), ids[i]))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(names))], schema=schema)

    found = named.select("doc_id", "text").mapInArrow(collect, ddl)
    return found.groupBy("minimum").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("minimum")


def repeats(docs: DataFrame, threshold: int = THRESHOLD, seed_words: int = SEED_WORDS, set_minima: int = SET_MINIMA) -> DataFrame:
    """Spans of words that lie in a run of ``threshold`` words which another document has too.

    One row for each maximal span: doc_id, first_word (from 0), end_word
    (behind the last) and n_words.  A word is what stands between blanks;
    words are compared by 64-bit hashes.  Overlapping and adjoining runs make one span.

    Repeats within one document alone don't count, and rows with the same
    doc_id are one document; of several texts under an id each has its own
    spans, equal texts the same.  A null doc_id can't be named and a null
    text has no words: such rows take no part.  Texts shorter than the
    threshold have no spans; long texts are handled whole; an empty table
    gives none; other columns aren't read.
    """
    require(docs, ["doc_id", "text"])
    if threshold < 2:
        raise ValueError("threshold must be at least 2")
    spark = docs.sparkSession
    seed = _seed(threshold, seed_words)
    offsets = steps(threshold, seed)
    needed = {0}
    for step in offsets[:0:-1]:  # where ranks of the first round are asked for, from a window's start
        needed |= {n + step for n in needed}
    ahead = np.array(sorted(needed))
    tables = Tables(spark, "repeats")
    named = _named(docs)
    shared = tables.write(shared_minima(named, threshold, seed), "minima")
    known = None
    if shared.count() <= set_minima:
        known = spark.sparkContext.broadcast(np.sort(shared.toArrow()["minimum"].to_numpy().view(np.uint64)))  # of checked size
        source = named.select("doc_id", "key", "text")
    else:
        source = _with_minima(named, shared, threshold, seed)

    ddl = "doc_id bigint, key bigint, pos bigint, a bigint, b bigint"
    schema = arrow_schema(ddl)
    first = offsets[0]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidate positions of each text with the hashes of their first words and of those behind."""
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, grams, minima in _windows((t.as_py() for t in batch.column(2)), threshold, seed):
                mine = known.value if known is not None else np.sort(np.array(batch.column(3)[i].as_py(), np.int64).view(np.uint64))
                at = np.minimum(np.searchsorted(mine, minima), len(mine) - 1)
                starts = np.flatnonzero(mine[at] == minima) if len(mine) else at[:0]
                if not len(starts):
                    continue
                marked = np.zeros(len(minima) + threshold, bool)
                for n in ahead:
                    marked[starts + n] = True
                pos = np.flatnonzero(marked[: len(grams) - first])
                n = len(pos)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ids[i])), pa.array(np.full(n, keys[i])), pa.array(pos), pa.array(grams[pos].view(np.int64)), pa.array(grams[pos + first].view(np.int64))], schema=schema)

    ranked = tables.write(_rerank(source.mapInArrow(pair, ddl)), "rank")
    for step in offsets[1:]:
        behind = Window.partitionBy("doc_id", "key").orderBy("pos").rangeBetween(step, step)
        pairs = ranked.withColumn("b", F.first("rank").over(behind)).filter("b IS NOT NULL").withColumnRenamed("rank", "a")
        longer = tables.write(_rerank(pairs), "rank")
        tables.drop(ranked)
        ranked = longer
    of = Window.partitionBy("doc_id", "key").orderBy("pos")
    begins = F.coalesce(F.col("pos") > F.lag("pos").over(of) + threshold, F.lit(True))
    spans = ranked.select("doc_id", "key", "pos", begins.cast("int").alias("begins")).withColumn("span", F.sum("begins").over(of))
    return (
        spans.groupBy("doc_id", "key", "span")
        .agg(F.min("pos").alias("first_word"), (F.max("pos") + threshold).alias("end_word"))
        .select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"))
        .distinct()
    )


def _rerank(pairs: DataFrame) -> DataFrame:
    """Sort the pairs (a, b); the place of the first of equal ones is their rank. Those of one document alone leave."""
    equal = Window.partitionBy("a", "b")
    return (
        pairs.repartition("a", "b")
        .sortWithinPartitions("a", "b")
        .withColumn("place", F.monotonically_increasing_id())
        .select("doc_id", "key", "pos", F.min("place").over(equal).alias("rank"), F.min("doc_id").over(equal).alias("low"), F.max("doc_id").over(equal).alias("high"))
        .filter("low <> high")
        .select("doc_id", "key", "pos", "rank")
    )


def _with_minima(named: DataFrame, shared: DataFrame, threshold: int, seed: int) -> DataFrame:
    """The texts that have shared minima, each with its own: for when these are too many to send to every task."""
    ddl = "key bigint, minimum bigint"
    schema = arrow_schema(ddl)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, _, minima in _windows((t.as_py() for t in batch.column(1)), threshold, seed):
                u = np.unique(minima).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), keys[i])), pa.array(u)], schema=schema)

    mine = named.select("key", "text").mapInArrow(collect, ddl).join(shared, "minimum", "left_semi").groupBy("key").agg(F.collect_set("minimum").alias("minima"))
    return named.join(mine, "key").select("doc_id", "key", "text", "minima")


def sql(threshold: int = THRESHOLD) -> str:
    """repeats over documents in DuckDB's SQL."""
    return rf"""
WITH w AS (SELECT DISTINCT doc_id, text, list_filter(string_split_regex(text, '[\x00\t\n\x0b\f\r ]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, text, pos, array_to_string(w[pos + 1 : pos + {threshold}], ' ') AS gram
      FROM (SELECT doc_id, text, w, unnest(range(0, len(w) - {threshold} + 1)) AS pos FROM w WHERE len(w) >= {threshold})),
shared AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, text, pos FROM g SEMI JOIN shared USING (gram)),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, text ORDER BY pos) + {threshold} THEN 0 ELSE 1 END AS begins FROM hits),
spans AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, text ORDER BY pos) AS span FROM marked)
SELECT DISTINCT doc_id, first_word, end_word, end_word - first_word AS n_words
FROM (SELECT doc_id, text, span, min(pos) AS first_word, max(pos) + {threshold} AS end_word FROM spans GROUP BY ALL)
"""
