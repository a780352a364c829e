"""Operator 7: documents with similar sets of word n-grams.

For a total order of the grams, two sets with Jaccard similarity t or more
share a gram among the first n - ceil(t n) + 1 of each.  This holds for every
order, so a pair must share a prefix gram under each of several: the first
by the number of texts that have the gram (rare ones first), ties broken by
a hash; the others likewise with other hashes.  The pairs that all orders
let through are verified on their whole sets.

Equal texts are one text until the end.  Which grams several texts have, and
how many, is counted over all texts in one exchange of packed cells; a gram
that no other text has takes its place in the prefix, but no posting of it is
made.  A pair that shares many prefix grams is taken at one of them, the most
frequent: a posting carries the LEADS most frequent ones of its text, which
tells nearly always.

What the verification finds isn't brought together pair by pair.  A task adds
up how many documents each of its texts is similar to, and gives a forest of
its similar texts: connected components and numbers of links follow from rows
that grow with the texts, however many pairs they make.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow_schema, column, require, text_key
from .components import components
from .textvec import mix, ngram_sets

N = 3
THRESHOLD = 0.5
ORDERS = 2
#: So many grams of a task's texts are packed together, and about so many of all texts are counted together; where this
#: leaves fewer than PACK grams of a chunk for a range, both grow, with the square root of all grams.
CHUNK, PACK = 1_000_000, 64
#: Texts that one task verifies among each other; larger components are divided into blocks, and every pair of blocks is a task.
BLOCK_TEXTS = 1500
#: Tables of up to so many rows of two numbers are sent to every task instead of shuffling the texts.
SENT_ROWS = 500_000
_LOW = np.uint64((1 << 20) - 1)
_HIGH = ~_LOW
#: Prefix grams that a posting carries to tell at which one of them a pair is taken.
LEADS = 4
_PAIRS = 1 << 19


def _texts(docs: DataFrame) -> DataFrame:
    text = column(docs, "text")
    return docs.select(text_key(text).alias("key"), text.alias("text"), column(docs, "doc_id").cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


def _named(docs: DataFrame, tables: Tables) -> DataFrame:
    """The distinct documents: key of the text, doc_id, number of equal rows, whether it has a word, its length."""
    texts = _texts(docs).select("key", "doc_id", F.length("text").alias("chars"), F.col("text").rlike(r"[0-9A-Za-z_]|[^\x00-\x7F]").alias("has_word"))
    return tables.write(texts.groupBy("key", "doc_id", "has_word", "chars").agg(F.count("*").alias("n")), "named")


def _distinct(docs: DataFrame, named: DataFrame, sent_rows: int, tables: Tables) -> DataFrame:
    """One row of each text that has a word: key, text. A text's copies go before anything is made of them."""
    first = named.filter("has_word").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    later = named.join(first, "key", "left").filter("first_id IS NULL OR doc_id <> first_id").select(F.col("key").alias("key_l"), F.col("doc_id").alias("id_l"))
    later = tables.write(later, "later")
    small = later.count() <= sent_rows
    texts = _texts(docs)
    texts = texts.join(F.broadcast(later) if small else later, (F.col("key") == F.col("key_l")) & (F.col("doc_id") == F.col("id_l")), "left_anti").select("key", "text")
    repeated = not named.filter("n > 1").isEmpty()
    if repeated:
        texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    return texts if small and not repeated else tables.write(texts, "texts")


CELLS = "range int, chunk bigint, data binary"
SETS = "key bigint, size int, cells binary, bands binary"


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, the lowest of all of them first: what is 0 in all of them takes no room."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _pack(cells: np.ndarray, owners: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending cells with their owners, and further arrays of bytes."""
    steps = np.diff(cells, prepend=cells[:1])
    width = 4 if not len(steps) or steps.max() < 1 << 32 else 8
    body = _planes(steps.astype(f"<u{width}")) + _planes(owners.astype("<u4")) + b"".join(x.tobytes() for x in more)
    return b"".join([len(cells).to_bytes(4, "little"), width.to_bytes(1, "little"), int(cells[0] if len(cells) else 0).to_bytes(8, "little"), pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)])


def _unpack(data: bytes, more: int = 0) -> list[np.ndarray]:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    body = np.frombuffer(pa.Codec("zstd").decompress(data[13:], n * (width + 4 + more), asbytes=True), np.uint8)

    def numbers(at: int, size: int) -> np.ndarray:
        return np.ascontiguousarray(body[at : at + n * size].reshape(size, n).T).view(f"<u{size}").ravel()

    cells = np.cumsum(numbers(0, width).astype(np.uint64), dtype=np.uint64) + np.uint64(int.from_bytes(data[5:13], "little"))
    return [cells, numbers(n * width, 4), *(body[n * (width + 4 + k) : n * (width + 5 + k)] for k in range(more))]


def _rows(rows: list[tuple], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _shared_sets(texts: DataFrame, n: int, t: float, grams: int, bits: int | None) -> DataFrame:
    """For each text that may be similar to another, what it shares with any: SETS.

    size counts all of its grams, cells are those of the grams in whose cell
    another text has one too, and bands say in how many texts (8 times the
    logarithm).  A gram's cell is the first bits of its hash, so many that
    few different grams share one.  A text most of whose grams are its own
    has no row, as no other can be similar to it.

    Chunks of texts send their cells, sorted and packed, to the ranges; each
    range sends back to the chunks the cells that it has seen more than once.
    """
    bits = bits or min(64, max(16, int(math.log2(max(grams, 1))) + 9))
    most = max(CHUNK, math.isqrt(PACK * grams))
    ranges = max(1, -(-grams // most))
    schema, sets_schema = arrow_schema(CELLS), arrow_schema(SETS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        keys: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, keys, held, size
            sizes = np.array([len(x) for x in held], np.int64)
            cells = np.concatenate(held) >> np.uint64(64 - bits)
            order = np.argsort(cells, kind="stable")
            cells, owners = cells[order], np.repeat(np.arange(len(held), dtype=np.uint32), sizes)[order]
            top, width = (cells >> np.uint64(bits - 32), 32) if bits > 32 else (cells, bits)
            cuts = np.searchsorted(top * np.uint64(ranges) >> np.uint64(width), np.arange(ranges + 1, dtype=np.uint64))
            names = np.array(keys, np.int64).tobytes() + sizes.tobytes()
            rows = [(-1 - chunk % ranges, chunk, names)]
            for k in np.flatnonzero(np.diff(cuts)):
                rows.append((int(k), chunk, _pack(cells[cuts[k] : cuts[k + 1]], owners[cuts[k] : cuts[k + 1]])))
                if len(rows) == 512:
                    yield _rows(rows, schema)
                    rows = []
            if rows:
                yield _rows(rows, schema)
            chunk, keys, held, size = chunk + 1, [], [], 0

        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), ngram_sets((x.as_py() for x in batch.column(1)), n)):
                if len(found):
                    keys.append(key)
                    held.append(found)
                    size += len(found)
                if size > most:
                    yield from flush()
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        held: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            cells = np.concatenate([x[1] for x in held])
            order = np.argsort(cells, kind="stable")
            ordered = cells[order]
            starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            counts = np.diff(np.append(starts, len(ordered)))
            band = np.zeros(len(cells), np.uint8)
            band[order] = np.repeat(np.minimum(np.floor(8 * np.log2(counts)), 255).astype(np.uint8), counts)
            at = 0
            for chunk, mine, owners in held:
                bands = band[at : at + len(mine)]
                at += len(mine)
                some = bands > 0
                if some.any():
                    yield _rows([(now, chunk, _pack(mine[some], owners[some], bands[some]))], schema)
            held.clear()

        for batch in batches:
            for k, chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_py()
                if k < 0:
                    yield _rows([(k, chunk, data)], schema)
                    continue
                if k != now:
                    if held:
                        yield from settle()
                    now = k
                held.append((chunk, *_unpack(data)))
        if held:
            yield from settle()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        held: list[list[np.ndarray]] = []

        def settle() -> Iterator[pa.RecordBatch]:
            half = len(names) // 2
            keys, sizes = np.frombuffer(names[:half], np.int64), np.frombuffer(names[half:], np.int64)
            cells, owners, bands = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(owners, kind="stable")
            cells, bands = cells[order], bands[order]
            bounds = np.searchsorted(owners[order], np.arange(len(keys) + 1, dtype=np.uint32))
            prefixes = sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 1
            rows = []
            for k in np.flatnonzero(sizes - np.diff(bounds) < prefixes):  # else grams of its own fill the prefix
                a, b = bounds[k], bounds[k + 1]
                rows.append((int(keys[k]), int(sizes[k]), cells[a:b].tobytes(), bands[a:b].tobytes()))
                if len(rows) == 512:
                    yield _rows(rows, sets_schema)
                    rows = []
            if rows:
                yield _rows(rows, sets_schema)

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                if k < 0:
                    if held:
                        yield from settle()
                    names, held = data.as_py(), []
                else:
                    held.append(_unpack(data.as_py(), 1))
        if held:
            yield from settle()

    met = texts.select("key", "text").mapInArrow(send, CELLS).repartition("range").sortWithinPartitions("range").mapInArrow(meet, CELLS)
    # A chunk's row of keys comes before those of its cells.
    return met.repartition("chunk").sortWithinPartitions("chunk", "range").mapInArrow(gather, SETS)


def prefix_length(n: int, t: float) -> int:
    return n - math.ceil(t * n - 1e-9) + 1


def _postings(sets: DataFrame, t: float, seed: int) -> DataFrame:
    """Prefix grams of each text under one order, but for those that no other text has.

    A row has the gram (its cell), the text's key, and LEADS of the grams
    that the text has rows for, each with its place in the order (44 and 20
    bits; a place of 2 ** 20 - 1 stands for more): the most frequent ones of
    those that stand early enough for a pair of sets of equal size.  The last
    column has the size of the set and the gram's own place.
    """
    ddl = "gram bigint, key bigint, " + "".join(f"lead{k} bigint, " for k in range(LEADS)) + "at bigint"
    schema = arrow_schema(ddl)
    salt = np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            held = 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out)], schema=schema)

            for key, size, cells, bands in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)):
                grams = mix(np.frombuffer(cells.as_buffer(), np.uint64))
                band = np.frombuffer(bands.as_buffer(), np.uint8).astype(np.uint64) << np.uint64(56)
                spread = mix(grams ^ salt) >> np.uint64(8)
                unknown = int(size) - len(grams)
                first = np.argsort(band | spread, kind="stable")[: prefix_length(int(size), t) - unknown]
                places = np.arange(unknown, unknown + len(first)).astype(np.uint64)
                if len(first) > 1:  # grams of one cell stand together; the first of them counts
                    fresh = np.concatenate([[True], grams[first[1:]] != grams[first[:-1]]])
                    first, places = first[fresh], places[fresh]
                k = len(first)
                late = places > np.uint64(max(0, int(0.8 * (1 - t) / (1 + t) * size)))
                top = np.lexsort((spread[first], ~band[first], late))[np.minimum(np.arange(LEADS), k - 1)]
                leads = (grams[first[top]] & _HIGH) | np.minimum(places[top], _LOW)
                out.append((grams[first], np.full(k, key), *(np.full(k, x) for x in leads), np.uint64(size) << np.uint64(32) | places))
                held += k
                if held > 200_000:
                    yield flush()
                    out, held = [], 0
            if out:
                yield flush()

    return sets.mapInArrow(emit, ddl)


def _meeting(t: float):
    """From postings in the order of their grams to pairs of texts, each made nearly always once."""
    schema = arrow_schema("a bigint, b bigint")

    def within(gram, key, *carried) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
        gram, key, *carried = (x[fresh] for x in (gram, key, *carried))
        *leads, at_ = (x.view(np.uint64) for x in carried)
        size, place = (at_ >> np.uint64(32)).astype(np.int64), (at_ & np.uint64(0xFFFFFFFF)).astype(np.int64)
        mine, names, places = gram.view(np.uint64) & _HIGH, [x & _HIGH for x in leads], [(x & _LOW).astype(np.int64) for x in leads]
        places = [np.where(x == int(_LOW), 1 << 62, x) for x in places]  # too far on to be told: such a lead settles nothing
        left = np.arange(len(gram))
        d = 1
        while True:
            left = left[left + d < len(gram)]
            left = left[gram[left] == gram[left + d]]
            if not len(left):
                return
            for at in range(0, len(left), _PAIRS):
                i = left[at : at + _PAIRS]
                j = i + d
                small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
                need = np.ceil(t / (1 + t) * (size[i] + size[j]) - 1e-9).astype(np.int64)
                ok = (small >= t * large - 1e-9) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= need)
                i, j, need = i[ok], j[ok], need[ok]
                # The pair is taken at the first of i's leads that j has as a lead too, if such a gram's places allow it; without one, here.
                free_i, free_j = size[i] - need, size[j] - need
                here = [(mine[i] == x[i]) for x in names]
                taken, open_ = np.zeros(len(i), bool), np.ones(len(i), bool)
                for x, px, mine_x in zip(names, places, here):
                    common = np.zeros(len(i), bool)
                    for y, py in zip(names, places):
                        common |= (x[i] == y[j]) & (py[j] <= free_j)
                    common &= open_ & (px[i] <= free_i)
                    taken |= common & mine_x
                    open_ &= ~common
                ok = taken | open_
                if ok.any():
                    a, b = key[i[ok]], key[j[ok]]
                    yield np.minimum(a, b), np.maximum(a, b)
            d += 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)], axis=1), axis=0) if found else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], schema=schema)

        def pieces() -> Iterator[tuple[np.ndarray, ...]]:
            nonlocal rest
            for batch in batches:
                now = tuple(c.to_numpy() for c in batch.columns)
                if rest is not None:
                    now = tuple(np.concatenate(x) for x in zip(rest, now))
                if not len(now[0]):
                    continue
                cut = int(np.searchsorted(now[0], now[0][-1]))  # the last gram may go on
                rest = tuple(x[cut:] for x in now)
                if cut:
                    yield tuple(x[:cut] for x in now)
            if rest is not None:
                yield rest

        for piece in pieces():
            for a, b in within(*piece):
                found.append((a, b))
                n += len(a)
                if n > _PAIRS:
                    yield flush()
                    found, n = [], 0
        yield flush()

    return meet


def _met(postings: DataFrame, t: float) -> DataFrame:
    """Pairs of texts that share a prefix gram and that their sizes and the gram's places allow: a < b."""
    return postings.repartition("gram").sortWithinPartitions("gram", "key").mapInArrow(_meeting(t), "a bigint, b bigint").distinct()


def _candidates(texts: DataFrame, n: int, t: float, orders: int, grams: int, bits: int | None, tables: Tables) -> DataFrame:
    """The pairs that all orders let through, written."""
    sets = tables.write(_shared_sets(texts, n, t, grams, bits), "sets")
    pairs = None
    for order in range(orders):
        found = tables.write(_met(_postings(sets, t, order), t), "met")
        if pairs is not None:
            both = tables.write(pairs.join(found, ["a", "b"], "left_semi"), "met")
            tables.drop(pairs, found)
            found = both
        pairs = found
    tables.drop(sets)
    return pairs


PAIRS = "a bigint, b bigint, jaccard double"
#: A link of the forest (a, b, null), or how many documents of other texts a text is similar to in one task (a, null, n).
LINKS = "a bigint, b bigint, n bigint"


def _verified(texts: DataFrame, pairs: DataFrame, n: int, t: float, tables: Tables, block_texts: int, sent_rows: int, weights: DataFrame | None = None, ddl: str = PAIRS) -> DataFrame:
    """What verification on the whole sets makes of the pairs: PAIRS or LINKS.

    Each connected component of pairs is cut into blocks of texts, and a task
    has the pairs between two blocks.  A text goes once to each task in which
    it has a pair.  For LINKS with weights (key, n: the documents of a text)
    all pairs are verified and counted; without, those that the task knows to
    be connected are skipped, which leaves the components as they are.
    """
    nodes = components(pairs, tables)
    sizes = nodes.groupBy("root").agg(F.ceil(F.count("*") / block_texts).cast("int").alias("blocks"))
    placed = nodes.join(sizes, "root").select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    if weights is not None:
        placed = placed.join(weights.select(F.col("key").alias("node"), F.col("n").alias("weight")), "node", "left")
    else:
        placed = placed.withColumn("weight", F.lit(1).cast("bigint"))
    placed = tables.write(placed, "placed")
    a = placed.select(F.col("node").alias("a"), "root", F.col("block").alias("block_a"))
    b = placed.select(F.col("node").alias("b"), F.col("block").alias("block_b"))
    work = pairs.join(a, "a").join(b, "b").select("root", F.least("block_a", "block_b").alias("i"), F.greatest("block_a", "block_b").alias("j"), "a", "b", F.lit(None).cast("bigint").alias("weight"), F.lit(None).cast("string").alias("text"))
    one = placed.filter("blocks = 1").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "weight")
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        needed = one
    else:
        work = tables.write(work, "work")
        ends = work.select("root", "i", "j", F.col("a").alias("node")).unionByName(work.select("root", "i", "j", F.col("b").alias("node"))).distinct()
        needed = one.unionByName(ends.join(large.select("node", "weight"), "node").select("root", "i", "j", "node", "weight"))
    needed = tables.write(needed, "needed")
    small = needed.count() <= sent_rows
    members = texts.join(F.broadcast(needed) if small else needed, F.col("key") == F.col("node")).select("root", "i", "j", F.col("key").alias("a"), F.lit(None).cast("bigint").alias("b"), "weight", "text")
    schema = arrow_schema(ddl)
    linked, counted = ddl == LINKS, weights is not None

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = None
        sets: dict[int, np.ndarray] = {}
        weight: dict[int, int] = {}
        up: dict[int, int] = {}
        degree: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        def settle() -> list[tuple]:
            rows = [(x, find(x), None) for x in list(up) if find(x) != x] + [(x, None, k) for x, k in degree.items()]
            up.clear()
            degree.clear()
            return rows

        for batch in batches:
            root, i, j, a, b, w = (batch.column(k).to_pylist() for k in range(6))
            fresh = [k for k in range(batch.num_rows) if b[k] is None]
            grams = dict(zip(fresh, ngram_sets((batch.column(6)[k].as_py() for k in fresh), n)))
            out = []
            for k in range(batch.num_rows):
                if task != (root[k], i[k], j[k]):
                    out += settle()
                    task, sets, weight = (root[k], i[k], j[k]), {}, {}
                if k in grams:
                    sets[a[k]], weight[a[k]] = grams[k], w[k]
                    continue
                if linked and not counted and find(a[k]) == find(b[k]):
                    continue
                x, y = sets[a[k]], sets[b[k]]
                if len(x) > len(y):
                    x, y = y, x
                if len(x) < t * len(y) - 1e-9:
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                union = len(x) + len(y) - both
                if both < t * union - 1e-9:
                    continue
                if not linked:
                    out.append((a[k], b[k], both / union))
                    continue
                p, q = find(a[k]), find(b[k])
                up[max(p, q)] = min(p, q)
                if counted:
                    degree[a[k]] = degree.get(a[k], 0) + weight[b[k]]
                    degree[b[k]] = degree.get(b[k], 0) + weight[a[k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if out := settle():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # Members come before the pairs of their task.
    return members.unionByName(work).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", F.col("b").asc_nulls_first(), "a").mapInArrow(verify, ddl)


def similar_texts(docs: DataFrame, n: int = N, t: float = THRESHOLD, orders: int = ORDERS, bits: int | None = None, block_texts: int = BLOCK_TEXTS, sent_rows: int = SENT_ROWS, tables: Tables | None = None) -> DataFrame:
    """Pairs of different texts, by their keys: a, b, jaccard."""
    return _similar(docs, n, t, orders, bits, block_texts, sent_rows, tables)[0]


def _similar(docs, n, t, orders, bits, block_texts, sent_rows, tables, ddl: str = PAIRS, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """What _verified gives for the documents, written, and their keys (see _named)."""
    if not 0 < t <= 1 or n < 1 or orders < 1:
        raise ValueError("0 < t <= 1, n >= 1 and orders >= 1")
    tables = tables or Tables(docs.sparkSession, "jaccard")
    named = _named(docs, tables)
    texts = _distinct(docs, named, sent_rows, tables)
    grams = (named.groupBy("key").agg(F.max("chars").alias("chars")).agg(F.sum("chars")).first()[0] or 0) // 6
    pairs = _candidates(texts, n, t, orders, grams, bits, tables)
    weights = named.groupBy("key").agg(F.count("*").alias("n")) if counted else None
    out = tables.write(_verified(texts, pairs, n, t, tables, block_texts, sent_rows, weights, ddl), "similar")
    tables.drop(pairs)
    return out, named


def join(docs: DataFrame, n: int = N, t: float = THRESHOLD, orders: int = ORDERS, bits: int | None = None, block_texts: int = BLOCK_TEXTS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """All pairs of documents with a Jaccard similarity of at least t: doc_a < doc_b, jaccard.

    A document's set is that of its n-grams of words, lower-cased; a word is
    a run of ASCII letters, digits and underscores and of characters beyond
    ASCII.  A text of fewer than n words has one gram, all of them; one
    without words (or null) has none and is similar to nothing.

    Rows with a null doc_id take no part, as a pair couldn't name them.
    Repeated rows are one document, and a document isn't paired with itself;
    of several texts under an id the most similar counts.  Grams are compared
    by 64-bit hashes.  Long texts have whole sets; an empty table gives no
    pairs; other columns aren't read.  Copies make as many pairs as there
    are: for what grows with the documents alone see ``classes``.
    """
    require(docs, ["doc_id", "text"])
    tables = Tables(docs.sparkSession, "jaccard")
    near, named = _similar(docs, n, t, orders, bits, block_texts, sent_rows, tables)
    ids = named.filter("has_word").select("key", "doc_id")
    a, b = ids.select(F.col("key").alias("a"), F.col("doc_id").alias("x")), ids.select(F.col("key").alias("b"), F.col("doc_id").alias("y"))
    apart = near.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    same = a.join(b, F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return apart.unionByName(same).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def _forest_of(links: DataFrame) -> DataFrame:
    return links.filter("b IS NOT NULL").select("a", "b")


def similar_roots(docs: DataFrame, tables: Tables, n: int = N, t: float = THRESHOLD, orders: int = ORDERS, bits: int | None = None, block_texts: int = BLOCK_TEXTS, sent_rows: int = SENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The texts that are connected by similar pairs, by key, with the smallest key of each group: node, root; and _named."""
    links, named = _similar(docs, n, t, orders, bits, block_texts, sent_rows, tables, LINKS)
    return components(_forest_of(links), tables), named


def classes(docs: DataFrame, n: int = N, t: float = THRESHOLD, orders: int = ORDERS, bits: int | None = None, block_texts: int = BLOCK_TEXTS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Every document with its class and its number of links: doc_id, class_id, n_links.

    Two documents are linked if their Jaccard similarity (see ``join``) is at
    least t; n_links counts the other documents that a document is linked to,
    copies included.  A class is what links connect, named by its smallest
    doc_id; a document without links is a class of its own.

    A document is a doc_id with a text: repeated rows are one, and an id with
    several texts has a row for each.  A text without words, or null, is
    similar to nothing.  Rows with a null doc_id can't be named and are left
    out.  Long texts have whole sets; an empty table gives no rows; other
    columns aren't read.
    """
    require(docs, ["doc_id", "text"])
    tables = Tables(docs.sparkSession, "jaccard")
    links, named = _similar(docs, n, t, orders, bits, block_texts, sent_rows, tables, LINKS, True)
    roots = components(_forest_of(links), tables).select(F.col("node").alias("key"), "root")
    others = links.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    of_key = named.filter("has_word").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).join(roots, "key", "left").join(others, "key", "left")
    of_key = of_key.withColumn("root", F.coalesce("root", "key"))
    of_root = of_key.groupBy("root").agg(F.min("first_id").alias("class_id"))
    of_key = of_key.join(of_root, "root").select("key", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    worded = named.filter("has_word").select("key", "doc_id").join(of_key, "key").select("doc_id", "class_id", "n_links")
    alone = named.filter("NOT has_word").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    nulls = docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), column(docs, "text").alias("text")).filter("text IS NULL AND doc_id IS NOT NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")).distinct()
    return worded.unionByName(alone).unionByName(nulls)


def groups(docs: DataFrame, tables: Tables | None = None, **options) -> DataFrame:
    """Documents that are connected by similar pairs: doc_id, first_id, the smallest of the group, for groups of two or more."""
    require(docs, ["doc_id", "text"])
    tables = tables or Tables(docs.sparkSession, "jaccard")
    roots, names = similar_roots(docs, tables, **options)
    named = names.filter("has_word").select("key", "doc_id").join(roots, F.col("key") == F.col("node"), "left").select("doc_id", F.coalesce("root", "key").alias("root"))
    texts = named.groupBy("root").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id <> last_id")
    return named.join(texts, "root").groupBy("doc_id").agg(F.min("first_id").alias("first_id"))


def distinct_documents(docs: DataFrame, sent_rows: int = SENT_ROWS * 4, **options) -> DataFrame:
    """The table with one document of each group, that with the smallest doc_id.

    Documents without words, and rows with a null doc_id, are in no group and
    stay.  Rows with the same doc_id stay or go together.  All columns are
    kept, whatever their names.
    """
    tables = Tables(docs.sparkSession, "jaccard")
    gone = tables.write(groups(docs, tables=tables, **options).filter("first_id < doc_id").select(F.col("doc_id").alias("gone_id")), "gone")
    small = gone.count() <= sent_rows
    return docs.join(F.broadcast(gone) if small else gone, column(docs, "doc_id") == column(gone, "gone_id"), "left_anti")


def closure_sql(texts: str, n: int = N, t: float = THRESHOLD) -> str:
    """Common table expressions in DuckDB's SQL over the distinct texts of a query: sizes(text), edges(x, y), reach(x, y)."""
    words = r"regexp_extract_all(lower(text), '[0-9A-Za-z_\x{80}-\x{10FFFF}]+')"
    return rf"""jw AS (SELECT text, {words} AS w FROM ({texts})),
jg AS (SELECT DISTINCT text, array_to_string(w[i : i + {n - 1}], ' ') AS gram
      FROM (SELECT text, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM jw WHERE len(w) > 0)),
sizes AS (SELECT text, count(*) AS n FROM jg GROUP BY ALL),
met AS (SELECT a.text AS x, b.text AS y, count(*) AS both_have FROM jg a JOIN jg b ON a.gram = b.gram AND a.text < b.text GROUP BY ALL),
near AS (SELECT x, y FROM met JOIN sizes p ON x = p.text JOIN sizes q ON y = q.text WHERE both_have >= {t} * (p.n + q.n - both_have) - 1e-9),
edges AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(x, y) AS (SELECT text, text FROM sizes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)"""


def sql(n: int = N, t: float = THRESHOLD) -> str:
    """classes over documents in DuckDB's SQL."""
    return rf"""
WITH RECURSIVE {closure_sql("SELECT DISTINCT text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL", n, t)},
docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL),
weights AS (SELECT text, count(*) AS n, min(doc_id) AS first_id FROM docs SEMI JOIN sizes USING (text) GROUP BY text),
others AS (SELECT x AS text, sum(n) AS n FROM edges JOIN weights ON y = text GROUP BY x),
classes AS (SELECT x AS text, min(first_id) AS class_id FROM reach JOIN weights ON y = text GROUP BY x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(w.n - 1, 0) + coalesce(o.n, 0) AS BIGINT) AS n_links
FROM docs d LEFT JOIN classes c USING (text) LEFT JOIN weights w USING (text) LEFT JOIN others o USING (text)
"""
