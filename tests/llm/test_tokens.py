"""Operators 3, 9 and 10: exact round trips and brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import elias_fano, mixing, packing, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, `Part` int"
TEXTS = ["The cat sat.", "", None, "naïve  café\n\nfin ", "word " * 3000, "The cat sat.", "  lead", " \n ", "x" * 5000]


def table(spark, texts=TEXTS, parts=3):
    rows = [(i if i != 4 else None, t, "en", None if i % 4 == 3 else f"s{i % 2}", 0, "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9, 1000, 10**9], list(range(0, 4000, 7)), [10**12]])
def test_elias_fano(values):
    code = elias_fano.EliasFano.encode(np.array(values, np.int64))
    assert [code[i] for i in range(len(values))] == values == code.decode().tolist()


def test_elias_fano_random():
    rng = np.random.default_rng(1)
    for top in (10, 10**4, 10**8):
        values = np.sort(rng.integers(0, top, 3000))
        code = elias_fano.EliasFano.encode(values)
        assert [code[i] for i in range(3000)] == values.tolist()
        bits = 8 * (len(code.low) + len(code.high))
        assert bits <= 3000 * (2 + max(0, np.log2(top / 3000))) + 64


def test_shards_round_trip(spark):
    docs = table(spark)
    shards = elias_fano.token_shards(docs, shard_tokens=500)
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in elias_fano.decode_shards(shards).collect())
    assert back == sorted((i if i != 4 else -1, t or "") for i, t in enumerate(TEXTS))
    row = max(shards.collect(), key=lambda r: len(r.doc_ids))
    for i, name in enumerate(row.doc_ids):
        assert tokens.vocabulary().decode(elias_fano.document_ids(row, i)) == (TEXTS[4 if name is None else name] or "")
    assert elias_fano.token_shards(docs.limit(0)).count() == 0


@pytest.mark.parametrize("window", [1, 7, 64, 100_000])
def test_packing(spark, window):
    docs = table(spark).cache()
    order = [r.doc_id for r in docs.collect()]
    stream, owner = [], []
    for name in order:
        ids = [*tokens.vocabulary().encode(TEXTS[4 if name is None else name]).tolist(), tokens.END_ID]
        stream += ids
        owner += [(name, k) for k in range(len(ids))]
    rows = sorted(packing.pack(docs, window).collect())
    assert [r.window_id for r in rows] == list(range(-(-len(stream) // window)))
    assert [x for r in rows for x in np.frombuffer(r.ids, f"<u{r.id_bytes}").tolist()] == stream
    for r in rows:
        mine = owner[r.window_id * window : (r.window_id + 1) * window]
        assert r.n_tokens == len(mine)
        assert list(zip(r.doc_ids, r.starts)) == [(n, i) for i, (n, k) in enumerate(mine) if i == 0 or k == 0]
    assert all(r.n_tokens == window for r in packing.pack(docs, window, drop_last=True).collect())
    assert packing.pack(docs.limit(0), window).count() == 0


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 77))
        assert sorted(got.tolist()) == list(range(n))
    a = mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1))
    b = mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2))
    assert (a == b).mean() < 0.02 and (a == np.arange(1000)).mean() < 0.02


def test_mixing_one_epoch_keeps_every_token(spark):
    docs = table(spark)
    rows = mixing.mix(docs, block=16, slots=4, weights={"s0": 1.0}, n_slots=10**3).collect()
    assert {r.source for r in rows} == {"s0"} and len(rows) == 1000
    texts = [t for i, t in enumerate(TEXTS) if i % 4 != 3 and i % 2 == 0]
    total = sum(len(mixing.token_starts((t or "").encode())) for t in texts)
    n = -(-total // 16)
    seen = {}
    for r in rows:
        seen.setdefault(r.epoch, {})[r.block] = r.text
    for e in range(1000 // n):
        assert sorted(seen[e]) == list(range(n))
    assert len("".join(seen[0].values())) == sum(len(t or "") for t in texts)
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(250) for k in range(4)]


def test_mixing_reaches_weights(spark):
    rows = [(i, f"w{i} " * (40 + i % 7), "en", f"s{min(i % 9, 3)}", 0, "", 0) for i in range(400)] + [(1000, "null source " * 200, None, None, 0, "", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    weights = {"s0": 5, "s1": 3, "s3": 1, None: 1, "gone": 9}
    out = mixing.mix(docs, weights=weights, block=32, slots=50, n_slots=4000)
    share = {r.source: r["count"] / 4000 for r in out.groupBy("source").count().collect()}
    assert all(abs(share[s] - w / 10) < 0.03 for s, w in weights.items() if s != "gone") and set(share) == {"s0", "s1", "s3", None}
    again = mixing.mix(docs.repartition(3), weights=weights, block=32, slots=50, n_slots=4000)
    assert out.select("shard", "slot", "source").exceptAll(again.select("shard", "slot", "source")).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, weights={}).count() == 0


def test_mixing_defaults_use_all_sources(spark):
    docs = table(spark)
    out = mixing.mix(docs, block=8, slots=8)
    assert out.agg(F.count("*")).first()[0] == sum(-(-sum(len(mixing.token_starts((t or "").encode())) for i, t in enumerate(TEXTS) if f(i)) // 8) for f in (lambda i: i % 4 == 3, lambda i: i % 2 == 0, lambda i: i % 4 == 1))


BLANK = r"[\0\t\n\v\f\r ]"
WORDS = re.compile(rf"{BLANK}*[^\0\t\n\v\f\r ]+(?:{BLANK}+$)?|{BLANK}+$")


def test_token_starts():
    for text in [t for t in TEXTS if t] + [" \t a\nb  c \n", "ß ü", "\0a\0"]:
        data = text.encode()
        bounds = [*mixing.token_starts(data).tolist(), len(data)]
        assert [data[a:b].decode() for a, b in zip(bounds, bounds[1:])] == [m[0] for m in WORDS.finditer(text)]


def place(x, n, key):
    """Feistel rounds, walked until below n, in plain integers."""
    width = max((max(n, 2) - 1).bit_length(), 1)
    half = (width + 2) // 2
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for r in range(4):
            z = (right + key + r) * 0x9E3779B97F4A7C15 % 2**64
            z = (z ^ (z >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
            left, right = right, left ^ ((z ^ (z >> 32)) & ((1 << half) - 1))
        x = left << half | right
        if x < n:
            return x


def brute_mix(rows, weights, block, slots, n_slots, seed):
    """(shard, slot, source, block, epoch, tokens with their documents) of rows (source, doc_id, text) in the table's order."""
    stream = {}
    for source, name, text in rows:
        stream.setdefault(source, []).extend((name, m[0]) for m in WORDS.finditer(text or ""))
    names = sorted((s for s in stream if stream[s] and weights.get(s)), key=lambda s: (s is None, s))
    p = np.array([weights[s] for s in names], float)
    p /= p.sum()
    drawn = dict.fromkeys(names, 0)
    for shard in range(-(-n_slots // slots)):
        counts = np.random.default_rng([seed, shard]).multinomial(min(slots, n_slots - shard * slots), p)
        slot = 0
        for s, n in zip(names, counts):
            size = -(-len(stream[s]) // block)
            for _ in range(n):
                epoch, j = divmod(drawn[s], size)
                key = int.from_bytes(hashlib.blake2b(repr((seed, s, epoch)).encode(), digest_size=8).digest(), "little") >> 1
                b = place(j, size, key)
                yield shard, slot, s, b, epoch, stream[s][b * block : (b + 1) * block]
                drawn[s] += 1
                slot += 1


@pytest.mark.parametrize("block, slots, n_slots", [(16, 5, 333), (3, 64, 2500), (1000, 4, 9)])
def test_mixing_brute_force(spark, block, slots, n_slots):
    docs = table(spark, [*TEXTS, *(f"more {'of ' * (i % 11)} text {i}" for i in range(60)), "a long text " * 90_000]).cache()
    rows = [(r.source, r.doc_id, r.text) for r in docs.collect()]
    weights = {"s0": 4.0, "s1": 2.0, None: 1.0}
    want = {}
    for shard, slot, source, number, epoch, mine in brute_mix(rows, weights, block, slots, n_slots, 5):
        begins = [k for k, (n, _) in enumerate(mine) if not k or mine[k - 1][0] != n]
        want[shard, slot] = (source, number, epoch, len(mine), [mine[k][0] for k in begins], begins, "".join(t for _, t in mine))
    got = mixing.mix(docs, weights=weights, block=block, slots=slots, n_slots=n_slots, seed=5)
    mine = {(r.shard, r.slot): (r.source, r.block, r.epoch, r.n_tokens, r.doc_ids, r.starts, r.text) for r in got.collect()}
    assert mine == want and len(mine) == n_slots


def test_mixed_documents_end_once(spark):
    """Each copy of a document in the mix has one end, and its pieces put together are its text."""
    docs = table(spark, [t for t in TEXTS if t and t.strip()], 2)
    out = mixing.mixed_documents(docs, block=16, slots=8, alpha=1.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = out.collect()
    assert all(r.n_chars == len(r.text) and (r.text[-1] == "\n") == r.text[-1].isspace() for r in rows)
    ids = packing.pack(out.coalesce(1), 10**6, ends=mixing.END).first()
    stream = np.frombuffer(ids.ids, "<u2").tolist()
    assert stream.count(tokens.END_ID) == sum(r.text.endswith("\n") for r in rows) < len(rows)
    pieces = [tokens.vocabulary().encode(r.text.removesuffix("\n")).tolist() + [tokens.END_ID] * r.text.endswith("\n") for r in rows]
    assert stream == sum(pieces, [])
    # Cut at a blank before a word, a text has the same ids as whole.
    whole = "naïve  café\n\nfin of  it all"
    for at in (5, 12, 16):
        assert tokens.vocabulary().encode(whole[:at]).tolist() + tokens.vocabulary().encode(whole[at:]).tolist() == tokens.vocabulary().encode(whole).tolist()


def test_texts_beyond_a_piece(spark):
    """Ids of texts of more than 200,000 characters are those of the whole text, and shards and windows hold them."""
    text = "The cat  sat, 12 times.\n" * 20_000
    want = tokens.vocabulary()._encoding.encode_ordinary(text)
    assert tokens.vocabulary().encode(text).tolist() == want and len(text) > 2 * tokens._PIECE
    unbroken = "x" * 450_000
    assert tokens.vocabulary().decode(tokens.vocabulary().encode(unbroken)) == unbroken
    docs = table(spark, [text, unbroken[:210_000]], 1)
    back = {r.doc_id: r.text for r in elias_fano.decode_shards(elias_fano.token_shards(docs)).collect()}
    assert back == {0: text, 1: unbroken[:210_000]}
    windows = sorted(packing.pack(docs.filter("doc_id = 0"), 4096).collect())
    assert [x for w in windows for x in np.frombuffer(w.ids, "<u2").tolist()] == [*want, tokens.END_ID]
