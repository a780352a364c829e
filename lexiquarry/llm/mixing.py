"""Operator 10: mix sources to target weights.

Each source's tokens are packed into blocks of a fixed length.  Every output
shard draws, from a generator seeded by its number, how many of its slots
each source gets (one multinomial draw).  The slots of a source are numbered
through all shards; slot j takes the block at place j mod n of a
pseudorandom permutation of the source's n blocks, keyed by source and by
epoch j div n.  Slots and blocks then meet in one join on (source, block):
a task puts together the blocks that lie within its rows, and what is left
of others at its ends is merged in the shuffle that the join takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema, column, require
from .packing import offsets
from .textvec import spans

BLOCK = 512
SLOTS = 256
ALPHA = 0.7
SEED = 20240601
#: Shards that one task draws for.
DRAWN = 4096
#: Ends a document in mixed_documents.
END = "\n"
_LIMIT = 1 << 21
_HELD = 32 << 20
_BLANKS = "\0\t\n\v\f\r "


def token_starts(data: bytes) -> np.ndarray:
    """Where the tokens of a text begin: a token is a word and the blanks before it.

    Blanks behind the last word belong to it; a text of blanks alone is one
    token.  The tokens of a text put together are the text.
    """
    if not data:
        return np.empty(0, np.int64)
    _, ends = spans(np.frombuffer(data, np.uint8), "space")
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in a pseudorandom permutation of 0 .. n - 1.

    Four Feistel rounds over the smallest even number of bits that hold n,
    walked until the value falls below n; all arguments are arrays.
    """
    index, n, key = (np.asarray(x, np.uint64) for x in (index, n, key))
    if not len(index):
        return index.astype(np.int64)
    width = np.ceil(np.log2(np.maximum(n.astype(np.float64), 2))).astype(np.uint64)
    half = (width + np.uint64(2)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x, half, mask, key):
        left, right = x >> half, x & mask
        for r in range(4):
            z = (right + key + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
        return left << half | right

    out = once(index, half, mask, key)
    while (bad := np.flatnonzero(out >= n)).size:
        out[bad] = once(out[bad], half[bad], mask[bad], key[bad])
    return out.astype(np.int64)


def _key(seed: int, source: str | None, epoch: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, source, epoch)).encode(), digest_size=8).digest(), "little") >> 1


PIECES = "source string, part int, start bigint, n_tokens bigint, doc_id bigint, lang string, text string"


def _measured(docs: DataFrame) -> DataFrame:
    """Every document with its number of tokens and its place among those of its source in its partition."""
    schema = arrow_schema(PIECES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        place: dict[str | None, int] = {}
        for batch in batches:
            sizes, starts = [], []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(3)):
                sizes.append(len(token_starts((text.as_py() or "").encode("utf-8"))))
                starts.append(place.get(source, 0))
                place[source] = starts[-1] + sizes[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), batch.column(1), batch.column(2), batch.column(3)],
                schema=schema,
            )

    lang = column(docs, "lang") if "lang" in docs.columns else F.lit(None)
    return docs.select(
        column(docs, "source").cast("string").alias("source"), column(docs, "doc_id").cast("bigint").alias("doc_id"), lang.cast("string").alias("lang"), column(docs, "text").alias("text")
    ).mapInArrow(measure, PIECES)


PARTS = "k int, block bigint, source string, first bigint, n_tokens int, doc_ids array<bigint>, starts array<int>, langs array<string>, texts array<string>"


def _parts(placed: DataFrame, block: int, apart: bool) -> DataFrame:
    """Blocks, or what a task has of one, a row each: see PARTS.

    Unless apart, there is one text for all documents, and no lang.  With
    apart a document's last piece ends with END instead of its blanks.
    """
    schema = arrow_schema(PARTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # by source: its name, where its open part begins and ends, doc_ids, starts, langs, texts
        size = 0
        out: list[tuple] = []
        sent = 0

        def close(k: int) -> None:
            nonlocal sent
            source, first, end, ids, starts, langs, texts = held.pop(k)
            out.append((k, first // block, source, first, end - first, ids, starts, langs if apart else [], texts if apart else ["".join(texts)]))
            sent += sum(map(len, texts))

        def flush() -> pa.RecordBatch:
            nonlocal out, sent
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, sent = [], 0
            return rows

        for batch in batches:
            for k, source, start, doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode("utf-8")
                places = token_starts(data)
                at = 0
                while at < len(places):
                    now = start + at
                    if k in held and held[k][2] != now:
                        close(k)
                    n = min(len(places) - at, block - now % block)
                    last = at + n == len(places)
                    piece = data[int(places[at]) : len(data) if last else int(places[at + n])].decode("utf-8")
                    if apart and last:
                        piece = piece.rstrip(_BLANKS) + END
                    _, first, _, ids, starts, langs, texts = held.get(k) or (source, now, now, [], [], [], [])
                    ids.append(doc_id)
                    starts.append(now % block)
                    langs.append(lang)
                    texts.append(piece)
                    held[k] = (source, first, now + n, ids, starts, langs, texts)
                    size += len(piece)
                    at += n
                    if (now + n) % block == 0:
                        close(k)
                    if size > _HELD:
                        for x in list(held):
                            close(x)
                        size = 0
                    if sent > _LIMIT:
                        yield flush()
        for x in list(held):
            close(x)
        if out:
            yield flush()

    return placed.select("k", "source", "start", "doc_id", "lang", "text").mapInArrow(cut, PARTS)


def target_weights(totals: dict[str | None, int], weights: dict[str | None, float] | None, alpha: float) -> dict[str | None, float]:
    """Shares that add up to 1: the given weights of the sources that have tokens, or tokens ** alpha."""
    raw = {s: float((weights.get(s, 0.0) if weights is not None else n**alpha)) for s, n in totals.items() if n}
    if any(w < 0 for w in raw.values()):
        raise ValueError("weights can't be negative")
    whole = sum(raw.values())
    return {s: w / whole for s, w in sorted(raw.items(), key=lambda x: (x[0] is None, x[0])) if w} if whole else {}


def _mixed(docs: DataFrame, apart: bool, weights=None, alpha: float = ALPHA, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, n_slots: int | None = None) -> DataFrame:
    """A row a slot: shard, slot, source, block, epoch, and the block's parts p in order (first, n_tokens, doc_ids, starts, langs, texts)."""
    require(docs, ["doc_id", "text", "source"])
    spark = docs.sparkSession
    tables = Tables(spark, "mix")
    table = tables.write(_measured(docs), "measured")
    totals = {r["source"]: r["n"] for r in table.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row a source
    shares = target_weights(totals, weights, alpha)
    blocks = {s: -(-totals[s] // block) for s in shares}
    names, p = list(shares), np.array(list(shares.values()))
    wanted = n_slots if n_slots is not None else sum(-(-n // block) for n in totals.values())
    shards = -(-wanted // slots) if names else 0

    def draw(shard: int) -> np.ndarray:
        return np.random.default_rng([seed, shard]).multinomial(min(slots, wanted - shard * slots), p)

    counts_schema = arrow_schema("shard bigint, k int, n int")

    def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if not ids:
                continue
            n = np.array([draw(i) for i in ids], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), len(names))), pa.array(np.tile(np.arange(len(names), dtype=np.int32), len(ids))), pa.array(n.ravel())], schema=counts_schema)

    # The draws of all shards, numbered through: prefix sums over runs of shards, then within a run.
    run = 1024
    counts = spark.range(0, shards, numPartitions=max(1, -(-shards // DRAWN))).mapInArrow(draws, "shard bigint, k int, n int").withColumn("run", F.expr(f"shard div {run}"))
    per_run = counts.groupBy("k", "run").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_run.select("k", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("k", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slot_base = Window.partitionBy("shard").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.join(bases, ["k", "run"]).select("shard", "k", "n", (F.col("base") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("from"))
    numbered = numbered.withColumn("slot", F.coalesce(F.sum("n").over(slot_base), F.lit(0)).cast("int")).filter("n > 0")

    ddl = "shard bigint, slot int, k int, block bigint, epoch bigint"
    slot_schema = arrow_schema(ddl)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = [blocks[s] for s in names]
        for batch in batches:
            shard, k, n, first, slot = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(5))
            if not len(n):
                continue
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            source, j = np.repeat(k, n), np.repeat(first, n) + within
            of = np.array(size, np.int64)[source]
            epoch = j // of
            pairs, which = np.unique(np.stack([source, epoch]), axis=1, return_inverse=True)
            keys = np.array([_key(seed, names[s], int(e)) for s, e in pairs.T], np.uint64)[which.ravel()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(shard, n)), pa.array((np.repeat(slot, n) + within).astype(np.int32)), pa.array(source.astype(np.int32)), pa.array(permute(j % of, of, keys)), pa.array(epoch)],
                schema=slot_schema,
            )

    chosen = numbered.select("shard", "k", "n", "from", "slot").mapInArrow(choose, ddl)
    numbers = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "source_n string, k int")
    bases_of = offsets(table, "n_tokens", "source").join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("source_n"))).select("k", F.col("source").alias("source_b"), F.col("part").alias("part_b"), "base")
    placed = (
        table.join(F.broadcast(bases_of), F.col("source").eqNullSafe(F.col("source_b")) & (F.col("part") == F.col("part_b")))  # a row for each source and partition of the input
        .select("k", "source", (F.col("base") + F.col("start")).alias("start"), "doc_id", "lang", "text")
    )
    whole = _parts(placed, block, apart).groupBy("k", "block").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("first", "n_tokens", "doc_ids", "starts", "langs", "texts"))).alias("p"))
    return chosen.hint("shuffle_hash").join(whole, ["k", "block"]).select("shard", "slot", "source", "block", "epoch", "p")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Blocks of tokens, drawn so that each source's share of the output comes to its target weight.

    Options: ``weights`` by source, or else each source weighs its tokens to
    the power ``alpha`` (1 keeps the natural shares, 0 makes all equal);
    ``block`` tokens a block; ``slots`` blocks a shard; ``n_slots`` blocks in
    all, by default as many as the input has; ``seed``.

    A token is a word with the blanks before it (see token_starts), so the
    text of a block is exact.  One row a slot: shard, slot, source, block,
    epoch, n_tokens, doc_ids, starts and text, the documents in their order
    and the tokens at which they begin, which is where their texts are to be
    parted.  The
    last block of a source may be shorter; no token of it is lost.

    A null source is a source of its own, weighed under the key None.  A
    null or empty text has no tokens and is in no block; a null doc_id stays
    null in doc_ids; repeated rows are repeated documents; a text longer
    than a block fills as many as it needs; an empty table, or one in which
    no weighed source has tokens, gives no rows; other columns aren't read.
    """
    return _mixed(docs, False, **options).select(
        "shard",
        "slot",
        "source",
        "block",
        "epoch",
        F.expr("cast(aggregate(p, 0L, (n, x) -> n + x.n_tokens) as int)").alias("n_tokens"),
        F.expr("flatten(p.doc_ids)").alias("doc_ids"),
        F.expr("flatten(p.starts)").alias("starts"),
        F.concat_ws("", F.expr("flatten(p.texts)")).alias("text"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as a table of documents, in its order: each row is what a block holds of one document.

    The columns are doc_id, text, lang, source and n_chars, the length of
    the row's text; others aren't read.  Shards follow one another whole,
    slots and documents within them in order.  A row with which a document
    ends has END in place of the blanks behind its last word; any other row
    ends with a word, and what follows stands in another block.  Null and
    empty texts have no row; for the rest see ``mix``.
    """
    rows = _mixed(docs, True, **options).repartition("shard").sortWithinPartitions("shard", "slot")
    pieces = rows.select("source", F.explode(F.expr("arrays_zip(flatten(p.doc_ids), flatten(p.langs), flatten(p.texts))")).alias("x"))
    return pieces.select(F.col("x.0").alias("doc_id"), F.col("x.2").alias("text"), F.col("x.1").alias("lang"), "source", F.length("x.2").cast("bigint").alias("n_chars"))
