"""The three-document corpus and others: what each query finds."""

import itertools
import math
import random
import tracemalloc

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiquarry import queries
from lexiquarry.fields import Fields
from lexiquarry.functions import kernels
from lexiquarry.operators import analysis, search, snippets

DOCS = "doc_id bigint, blocks array<struct<text: string, number: double>>, tags array<struct<field: string, lower: int, upper: int>>"
T = lambda *xs: [(x, None) for x in xs]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, T("Сказ про радугу", "/", "Rainbow tales", "Как однажды Жак Звонарь", "Городской сломал фонарь", "Очень старый фонарь"), [("title", 0, 2), ("body", 3, 4)]),
        (2, T("старый добрый Фонарь Диогена"), [("title", 0, 0)]),
        (3, T("городской сумасшедший"), []),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    c = search.Corpus.of(docs)
    c.postings.cache()
    return c


def points(df):
    return {r.doc_id: [(e.lower, e.upper, sorted(p.offset for p in e.points)) for e in r.entries] for r in df.collect()}


ANY = lambda *w: search.Stats(3, dict.fromkeys(w, 0.5), {x: [(x, [], 0.5)] for x in w})


def test_shape(corpus):
    assert {r.doc_id: r.n_words for r in corpus.images.collect()} == {1: 16, 2: 4, 3: 2}
    assert [(f.name, f.id) for f in corpus.fields] == [("title", 0), ("body", 1)]
    for bad in ({}, {"&&": ["a"], "||": []}):
        for run in (search.mini, search.rich):
            with pytest.raises(ValueError):
                run(corpus, bad)
    assert search.rich(corpus, "Платон").count() == search.mini(corpus, "Платон").count() == 0


@pytest.mark.parametrize("query, want", [
    ("Городской", {1: [10], 3: [0]}), ("фонарь", {1: [12, 15], 2: [2]}), ("городской | фонарь", {1: [10, 12, 15], 2: [2], 3: [0]}),
    ("городской & фонарь", {1: [(10, 12)]}), ('"старый фонарь"', {1: [(14, 15)]}), ("фонарь ! городской", {2: [2]}), ("фонарь ! платон", {1: [12, 15], 2: [2]}),
    ("cover(body, фонарь)", {1: [12]}), ("cover(title + body, фонарь)", {1: [12], 2: [2]}), ("match(title, 'старый добрый фонарь диогена')", {2: [(0, 3)]}),
    ("match(body, фонарь)", {}), ("ctx(2, городской & фонарь)", {}), ("ctx(3, городской & фонарь)", {1: [(10, 12)]}), ("с*й", {1: [14], 2: [0], 3: [1]}),
])
def test_rich(corpus, query, want):
    got = {d: [e[:2] if e[0] != e[1] else e[0] for e in es] for d, es in points(search.rich(corpus, query)).items()}
    assert got == want


def test_fuzzy_with_given_statistics(corpus):
    stats = search.rank_terms(corpus, "городской фонарь", {"городской": 0.7, "фонарь": 0.05})
    assert points(search.rich(corpus, "городской фонарь", stats)) == {1: [(10, 12, [10, 12])], 3: [(0, 0, [0])]}
    assert {r.doc_id: len(r.factors) for r in search.mini(corpus, "городской фонарь", stats).collect()} == {1: 2, 3: 1}


@pytest.mark.parametrize("query, want", [("городской & фонарь", {1: 2}), ("городской | фонарь", {1: 2, 2: 1, 3: 1}), ('"старый фонарь"', {1: 2, 2: 2}), ("с*й", {1: 1, 2: 1, 3: 1}), ("(городской & платон) | фонарь", {1: 1, 2: 1}), ("(сломал & городской) | старый", {1: 3, 2: 1}), ("cover(body, добрый)", {2: 1})])
def test_mini(corpus, query, want):
    assert {r.doc_id: len(r.factors) for r in search.mini(corpus, query).collect()} == want


def test_mini_refuses_exclusion(corpus):
    with pytest.raises(ValueError):
        search.mini(corpus, "фонарь ! городской").count()


def test_weights(corpus):
    stats = search.rank_terms(corpus, "фонарь с* платон")
    assert stats.ranges["фонарь"] == pytest.approx(math.log(4 / 2) / math.log(4)) and stats.ranges["платон"] == 0
    assert search.load_terms("a (b* | c)") == ["a", "c", "{b*}"]
    n = search.wildcard_documents(corpus, "с*", 3)  # сказ 1, сломал 1, старый 2, сумасшедший 1
    assert n == int(1e-3 + 3 * (1 - (2 / 3) ** 3 * (1 / 3)))
    scores = {r.doc_id: r.score for r in search.bm25_search(corpus, "фонарь").collect()}
    tf = 1 / 4
    assert scores[2] == pytest.approx(0.5 * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 4 / 1000)))
    real = {r.doc_id: r.score for r in search.bm25_search(corpus, "фонарь", real_counts=True).collect()}
    assert real[1] > scores[1] and real[2] == scores[2]
    assert [r.doc_id for r in search.bm25_search(corpus, "фонарь", k=1).collect()] == [2]
    assert [r.doc_id for r in search.rich_search(corpus, "фонарь", k=5).collect()] == [1, 2]
    only = search.rich(corpus, "фонарь", fields=["body"])
    assert {r.doc_id: [e.weight for e in r.entries] for r in only.collect()} == {1: [0.5, 0.2], 2: [0.2]}


def test_lexicon(spark):
    docs = spark.createDataFrame([(1, "The cats sat"), (2, "a cat sits"), (3, "dog")], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([("cat", "CAT", [1]), ("cats", "CAT", [2]), ("sat", "SIT", [3]), ("sits", "SIT", [1]), ("sits", "SITS", [4])], "word string, term string, forms array<int>")
    c = search.Corpus.of(docs, lexicon=lexicon)
    assert points(search.rich(c, "cat")) == {1: [(1, 1, [1])], 2: [(1, 1, [1])]}
    assert {r.doc_id: r.entries[0].weight for r in search.rich(c, "cat").collect()} == {1: pytest.approx(0.5 * search.rank_terms(c, "cat").ranges["cat"]), 2: pytest.approx(search.rank_terms(c, "cat").ranges["cat"])}
    assert points(search.rich(c, '"cat sits"')) == {2: [(1, 2, [1, 2])]}
    assert points(search.rich(c, "'cat sits'")) == {1: [(1, 2, [1, 2])], 2: [(1, 2, [1, 2])]}
    guesses = spark.createDataFrame([("dog", "DOG?", [9])], "word string, term string, forms array<int>")
    t = analysis.terms(analysis.tokenize(analysis.images(docs)), lexicon, guesses)
    assert {(r.term, r.form) for r in t.filter("doc_id = 3").collect()} == {("dog", 255), ("DOG?", 9)}


def test_tokens(spark):
    rows = [(1, [(None, 9167.0), *T("Первая строка текста: просто строка", "Вторая строка в новом абзаце", "Строка внутри тега", "Строка внутри вложенного тега", "Третья строка.")], [("tag-1", 3, 4), ("tag-2", 4, 4)]), (2, None, None), (3, T("", None, " x  y\n"), [("tag-1", 0, 1)])]
    docs = spark.createDataFrame(rows, DOCS)
    f = analysis.discover_fields(docs)
    img = {r.doc_id: r for r in analysis.images(docs, f).collect()}
    assert img[1].n_words == 22 and img[2].n_words == 0 and [t.text for t in img[3].tokens] == ["x", "y"] and img[3].markup == []
    assert [(m.field, m.field_id, m.lower, m.upper) for m in img[1].markup] == [("tag-1", 0, 12, 18), ("tag-2", 1, 15, 18)]
    assert img[1].tokens[0].number == 9167 and img[1].tokens[0].text == "9167" and img[1].tokens[4].is_punct and not img[1].tokens[4].left_space
    whole = Fields.load([{"name": "tag-1", "options": "word-break: off"}])
    assert {r.doc_id: r.n_words for r in analysis.images(docs, analysis.discover_fields(docs, whole)).collect()}[1] == 20
    off = analysis.discover_fields(docs, Fields.load([{"name": "tag-1", "options": "index: off"}]))
    kept = analysis.indexed(analysis.images(docs, off), off).filter("doc_id = 1")
    assert sorted(r.pos for r in kept.collect()) == [*range(12), *range(15, 22)]
    at = {r.pos: r.field_id for r in analysis.field_at(analysis.images(docs, f), f).filter("doc_id = 1").collect()}
    assert (at[0], at[12], at[15], at[21]) == (0, 0, 1, 0)
    texts = spark.createDataFrame([(1, "Tom, (the) cat")], "doc_id bigint, text string")
    assert [(r.text, r.offset) for r in analysis.token_offsets(analysis.tokenize(analysis.images(texts))).orderBy("pos").collect()] == [("Tom", 0), (",", 3), ("(", 5), ("the", 6), (")", 9), ("cat", 11)]
    nested = [("a", 0, 3), ("b", 1, 2), ("c", 2, 2), ("d", 3, 3)]
    assert analysis.images(spark.createDataFrame([(1, T("x", "y", "z", "w"), nested)], DOCS)).first().n_words == 4
    with pytest.raises(Exception, match="tags overlap"):
        analysis.images(spark.createDataFrame([(1, T("x", "y", "z", "w"), [("a", 0, 2), ("b", 1, 3)])], DOCS)).collect()


def test_contents(spark):
    docs = spark.createDataFrame([(1, T("Сказ про радугу", "/", "Rainbow tales", "Как однажды Жак ЗвонарьГородской сломал фонарь", "Очень старый фонарь"), [])], DOCS)
    t = analysis.terms(analysis.tokenize(analysis.images(docs)))
    assert {r.term: r.tf for r in analysis.contents_bm25(t).collect() if r.tf > 1} == {"фонарь": 2}
    found = {r.term: r.positions for r in analysis.contents_rich(t).collect()}
    assert found["фонарь"] == [11, 14] and found["радугу"] == [2] and len(found) == analysis.contents_mini(t).count() == 14


# ---------------------------------------------------------------- snippets

@pytest.fixture(scope="module")
def quoted(spark):
    long = "Третья строка очень длинная и состоит из множества разных слов и букв для проявления многоточий в цитировании"
    texts = [(None, 9762.0), *T("Первая строка текста: просто строка,", "вторая строка в новом абзаце", "Строка внутри тега", "Строка внутри вложенного тега", "Текст, что надо всегда цитировать", long)]
    docs = spark.createDataFrame([(1, texts, [("tag-1", 3, 4), ("tag-2", 4, 4), ("tag-3", 5, 5)])], DOCS)
    return docs, texts


FIRST, SECOND = [([], "9762"), ([], "Первая [строка] [текста]: просто строка,")], "Текст, что надо всегда цитировать"


@pytest.mark.parametrize("hits, enforced, want", [
    ([], False, []), ([], True, [(["tag-3"], SECOND)]),
    ([(2, 3), (14, 15)], False, [*FIRST, (["tag-1"], "Строка [внутри] [тега]")]), ([(2, 3), (13, 14)], False, [*FIRST, (["tag-1"], "[Строка] [внутри] тега")]),
    ([(2, 3), (13, 14)], True, [*FIRST, (["tag-1"], "[Строка] [внутри] тега"), (["tag-3"], SECOND)]),
    ([(31, 42)], False, [([], "… строка очень длинная и [состоит] из множества разных слов…"), ([], "… для проявления многоточий в [цитировании]")]),
    ([(34,), (40,)], False, [([], "… и состоит из множества [разных] слов и букв для проявления [многоточий] в цитировании")]),
])
def test_snippets(spark, quoted, hits, enforced, want):
    docs, _ = quoted
    names = [{"name": n} for n in ("tag-1", "tag-2")] + [{"name": "tag-3", "options": "quote: always"} if enforced else {"name": "tag-3"}]
    two = {"lower": {"min": 2, "max": 4}, "upper": {"min": 2, "max": 4}}
    fields = Fields.load([n | {"indents": two} for n in names])
    found = spark.createDataFrame([(1, [(h[0], h[-1], 1.0, [(p, 0) for p in h]) for h in hits])], f"doc_id bigint, entries {search.ENTRIES}")
    got = snippets.snippet(found, analysis.images(docs, fields), fields, "[", "]", ((2, 4), (2, 4))).first().blocks
    assert [(b.tags, b.text) for b in got] == want


def test_highlight(spark, quoted):
    docs, texts = quoted
    img = analysis.images(docs, analysis.discover_fields(docs))
    none = spark.createDataFrame([], f"doc_id bigint, entries {search.ENTRIES}")
    back = [b.text for b in snippets.highlight(none, img, all_documents=True).first().blocks]
    assert back == ["9762", *[t for t, _ in texts[1:]]]
    one = spark.createDataFrame([(1, [(2, 2, 1.0, [(2, 5)])])], f"doc_id bigint, entries {search.ENTRIES}")
    assert snippets.highlight(one, img, "<%u>", "</%u>").first().blocks[1].text == "Первая <5>строка</5> текста: просто строка,"
    plain = search.Corpus.of(spark.createDataFrame([(1, "Tom, (the)  cat")], "doc_id bigint, text string"))
    assert snippets.highlight_plain(search.rich(plain, "the"), plain.images).first().text == "Tom, ([the]) cat"
    off = Fields.load([{"name": "tag-1", "options": "quote: off"}, {"name": "default_field", "options": "quote: off"}])
    hits = spark.createDataFrame([(1, [(14, 14, 1.0, [(14, 0)])])], f"doc_id bigint, entries {search.ENTRIES}")
    assert snippets.snippet(hits, analysis.images(docs, off), off).first().blocks == []


# ---------------------------------------------------------------- kernels

def entry(p, w=0.5, k=0):
    return (p, p, w, [(p, k)])


def test_all_of():
    assert [e[:2] for e in kernels.all_of([[entry(10)], [entry(12), entry(15)]])] == [(10, 12)]
    assert kernels.all_of([[entry(1)], []]) == []
    assert [e[:2] for e in kernels.all_of([[entry(1), entry(9)], [entry(2), entry(10)]])] == [(1, 2), (2, 9), (9, 10)]
    assert [e[:2] for e in kernels.all_of([[entry(1, 0.1), entry(9, 0.9)], [entry(2), entry(10)]])] == [(2, 9), (9, 10)]  # (1, 2) is weaker than what it touches; (2, 9) is as strong


lists = st.lists(st.lists(st.integers(0, 40), max_size=6).map(lambda x: sorted(set(x))), min_size=1, max_size=4)


@settings(max_examples=200, deadline=None)
@given(lists)
def test_all_of_covers_every_operand(positions):
    ops = [[entry(p, 0.2 + k / 10, k) for p in ps] for k, ps in enumerate(positions)]
    out = kernels.all_of(ops)
    assert bool(out) == all(positions)
    for lower, upper, w, found in out:
        assert {t for _, t in found} == set(range(len(ops))) and lower == min(o for o, _ in found) and upper == max(o for o, _ in found) and 0 < w < 1
    assert sorted(e[0] for e in out) == [e[0] for e in out]


@settings(max_examples=200, deadline=None)
@given(lists, st.lists(st.floats(0.05, 1), min_size=4, max_size=4))
def test_fuzzy_reaches_the_quorum(positions, weights):
    order = sorted(range(len(positions)), key=lambda i: -weights[i])
    ranges = [weights[i] for i in order]
    quorum = 0.7 * sum(ranges)
    out = kernels.fuzzy([[entry(p, 0.5, i) for p in positions[i]] for i in order], ranges, order, quorum)
    if sum(w for i, w in zip(order, ranges) if positions[i]) < quorum - 1e-9:
        assert not out
    for lower, upper, w, found in out:
        assert w >= kernels.LEAST and sum(weights[t] for t in {t for _, t in found}) >= quorum - 1e-9 and lower <= upper
    for a, b in itertools.pairwise(out):
        assert b[0] > a[1] or b[2] > a[2] or a[1] < b[0]


def test_rich_is_within_mini(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 25)))) for i in range(60)], "doc_id bigint, text string")
    c = search.Corpus.of(docs)
    for q in ("a & (b | c)", "a b c", "'a b'", "(a & b) | 'c d e'", "a (b & c) d"):
        stats = search.rank_terms(c, q)
        mini = {r.doc_id for r in search.mini(c, q, stats).collect()}
        rich = {r.doc_id for r in search.rich(c, q, stats).collect()}
        assert rich <= mini and rich


def test_blanks_of_unicode(spark):
    """The no-break space and others divide words, in texts and in queries alike."""
    blanks = [c for c in map(chr, range(0x110000)) if c.isspace()]
    docs = spark.createDataFrame([(1, "foo\u00a0bar baz"), (2, "x" + "x".join(blanks) + "x"), (3, "foobar")], "doc_id bigint, text string")
    c = search.Corpus.of(docs)
    assert points(search.rich(c, '"foo bar"')) == points(search.rich(c, '"foo\u00a0bar"')) == {1: [(0, 1, [0, 1])]}
    assert [r.doc_id for r in search.mini(c, "bar").collect()] == [1]
    assert {r.doc_id: r.n_words for r in c.lengths.collect()} == {1: 3, 2: len(blanks) + 1, 3: 1}
    img = {r.doc_id: r for r in c.images.collect()}
    assert [t.left_space for t in img[1].tokens] == [False, True, True] and img[2].n_words == len(blanks) + 1


def test_postings_are_the_same_in_rows_and_by_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, " . "), (9004, "İΑΣ ß " * 3000)], "doc_id bigint, text string"))
    rows = lambda df: sorted((r.term, r.doc_id, r.tf, r.positions, r.forms) for r in df.collect())
    got = rows(analysis.postings(docs))
    assert got == rows(analysis.contents_rich(analysis.terms(analysis.tokenize(analysis.images(docs))))) and len(got) > 10_000
    assert analysis.postings(docs.limit(0)).count() == 0
    lengths = {r.doc_id: r.n_words for r in analysis.lengths(docs).collect()}
    assert lengths == {r.doc_id: r.n_words for r in analysis.images(docs).collect()}


def test_number_ranges(spark):
    docs = spark.createDataFrame([(1, [(None, 5.0), ("x", None), (None, -3.5)], []), (2, [(None, 100.0), (None, 5.0)], []), (3, [("5", None)], [])], DOCS)
    numbers = analysis.numbers(docs)
    assert sorted((r.number, r.doc_id, r.positions) for r in numbers.collect()) == [(-3.5, 1, [2]), (5.0, 1, [0]), (5.0, 2, [1]), (100.0, 2, [0])]
    found = lambda *x: sorted(tuple(r) for r in search.number_range(numbers, *x).collect())
    assert found(-10, 5) == [(1, 2, -3.5, 5.0), (2, 1, 5.0, 5.0)] and found(5.5) == [(2, 1, 100.0, 100.0)] and len(found()) == 2 and found(None, -4) == []


# ---------------------------------------------------------------- whole tables in plain Python

TOKENS = regex.compile(r"\s*([\p{P}\p{S}]|[^\s\p{P}\p{S}]+)")


def plain_table(spark, terms):
    """Of every document of the table: its tokens (text, whether a blank is before it) and the positions of the terms; weights of the terms."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = {r.doc_id: [(m[1], len(m[0]) > len(m[1])) for m in TOKENS.finditer(r.text or "")] for r in rows}
    at = {d: {t: [i for i, (x, _) in enumerate(ws) if x.lower() == t] for t in terms} for d, ws in texts.items()}
    weights = {t: math.log((1 + len(rows)) / sum(bool(x[t]) for x in at.values())) / math.log(1 + len(rows)) for t in terms}
    return texts, at, weights


def test_every_tuple_of_and(spark):
    """Each position with the next one of the other word."""
    _, at, w = plain_table(spark, ["the", "of"])
    want = []
    for d, x in at.items():
        for a, b in (("the", "of"), ("of", "the")):
            want += [(d, p, min(q for q in x[b] if q > p)) for p in x[a] if any(q > p for q in x[b])]
    got = queries.QUERIES["rich_and"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.lower, r.upper) for r in got) == sorted(want) and len(want) > 1000
    assert all(r.weight == pytest.approx(1 - (1 - w["the"]) * (1 - w["of"]), abs=1e-6) for r in got)


def test_every_tuple_of_fuzzy(spark):
    _, at, w = plain_table(spark, ["the", "of", "in"])
    order = sorted(range(3), key=lambda k: -w[["the", "of", "in"][k]])
    names = [["the", "of", "in"][k] for k in order]
    want = []
    for d, x in at.items():
        operands = [[(p, p, w[t], [(p, t)]) for p in x[t]] for t in names]
        want += [(d, e[0], e[1], round(e[2], 6)) for e in kernels.fuzzy(operands, [w[t] for t in names], order, 0.7 * sum(w.values()))] if sum(w[t] for t in names if x[t]) >= 0.7 * sum(w.values()) - 1e-12 else []
    got = queries.QUERIES["rich_fuzzy"](spark, "/root/testdata/sf0.001").collect()
    assert [r[:3] for r in sorted(tuple(r) for r in got)] == [r[:3] for r in sorted(want)] and len(want) > 500
    assert all(a == pytest.approx(b, abs=2e-6) for a, b in zip((r[3] for r in sorted(tuple(r) for r in got)), (r[3] for r in sorted(want))))


def test_every_snippet(spark):
    """Hits and the words around them, up to a mark that breaks; cut ends have dots."""
    texts, at, _ = plain_table(spark, ["the", "of"])
    got = {r.doc_id: r.snippet for r in queries.QUERIES["snippet"](spark, "/root/testdata/sf0.001").collect()}
    want = {d for d, x in at.items() if x["the"] and x["of"] and (max(x["the"]) > min(x["of"]) or max(x["of"]) > min(x["the"]))}
    assert got.keys() == want and len(want) > 50
    for d, shown in got.items():
        hits = {p for e in kernels.all_of([[(p, p, 0.5, [(p, 0)]) for p in at[d]["the"]], [(p, p, 0.5, [(p, 1)]) for p in at[d]["of"]]]) for p, _ in e[3]}
        marked = regex.findall(r"\[(.*?)\]", shown.replace("[[", "[").replace("]]", "]"))
        assert [x.lower() for x in marked if x.lower() in ("the", "of")] == [texts[d][p][0].lower() for p in sorted(hits)]
        plain = "".join((" " if blank else "") + (f"[{x}]" if i in hits else x) for i, (x, blank) in enumerate(texts[d]))
        for piece in shown.split(" / "):
            for part in piece.strip("… ").split("…"):
                assert part.strip() in plain


def test_runs_of_postings(spark, tmp_path, monkeypatch):
    """Texts are grouped some at a time and written once, in runs by term and document, without an exchange."""
    docs = spark.createDataFrame([(k, f"b a x{k} a") for k in range(9)], "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(analysis, "GROUPED", 10)
    made = [(r.term, r.doc_id, r.tf, r.positions) for r in analysis.plain_postings(docs).collect()]
    assert len(made) == 27 and [r[:2] for r in made[:6]] == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("x0", 0), ("x1", 1)]
    assert made[0] == ("a", 0, 2, [1, 3])
    assert list(analysis.parts_of(analysis.np.array([3, 3, 50, 0, 3, 9]), 10)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    plan = analysis.plain_postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    at = f"file://{tmp_path}/postings"
    search.Corpus.of(docs).stored(at)
    assert spark.read.parquet(f"{at}/postings").count() == 27


def test_postings_with_a_dictionary_shuffle_its_words_alone(spark):
    docs = spark.createDataFrame([(1, "The cat, a cat; THE article an"), (2, "mouse"), (3, None)], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([("the", "article", [1]), ("a", "article", [2]), ("an", "article", [2]), ("an", "article", [2]), ("cat", "cat", [7]), ("cat", "animal", None)], "word string, term string, forms array<int>")
    rows = lambda df: sorted((r.term, r.doc_id, r.tf, r.positions, r.forms) for r in df.collect())
    got = rows(analysis.postings(docs, lexicon=lexicon))
    assert got == rows(analysis.contents_rich(analysis.terms(analysis.tokenize(analysis.images(docs)), lexicon)))
    assert ("article", 1, 5, [0, 3, 6, 7, 8], [1, 2, 1, 255, 2]) in got and ("mouse", 2, 1, [0], [255]) in got
    assert "SortMergeJoin" not in analysis.postings(docs, lexicon=lexicon)._jdf.queryExecution().executedPlan().toString()


def test_highlight_of_a_corpus(spark):
    """The texts meet the hits before they are divided; a long text with many hits takes no longer than one with few."""
    docs = spark.createDataFrame([(1, " Tom, (the)  cat "), (2, "no"), (3, "the x " * 20_000)], "doc_id bigint, text string")
    c = search.Corpus.of(docs)
    found = search.rich(c, "the")
    got = {r.doc_id: r.text for r in snippets.highlight_plain(found, c).collect()}
    assert got == {1: " Tom, ([the]) cat", 3: " ".join(["[the] x"] * 20_000)}
    assert got == {r.doc_id: r.text for r in snippets.highlight_plain(found.filter("doc_id > 0"), c.images).collect()}
    plan = snippets.highlight_plain(found, c)._jdf.queryExecution().executedPlan().toString()
    assert "array_contains(transform(points" not in plan and "left_space" not in plan
    by_corpus = snippets.snippet(found, c, opening="[", closing="]").collect()
    assert sorted(by_corpus) == sorted(snippets.snippet(found, c.images, opening="[", closing="]").collect())


def test_phrases_of_long_texts(spark):
    """An operand's entries are sorted once, not looked up in a map for each base."""
    docs = spark.createDataFrame([(1, "of the in of of the " * 3000)], "doc_id bigint, text string")
    c = search.Corpus.of(docs)
    got = search.tuples(search.rich(c, "\"of the in\"", search.Stats(9, {"of": 0.5, "the": 0.5, "in": 0.5})))
    assert "map_from_entries" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(got.collect(), key=lambda r: r.lower)
    assert [(r.lower, r.upper, round(r.weight, 3)) for r in rows] == [(6 * k, 6 * k + 2, 0.875) for k in range(3000)]
    assert [p.offset for p in rows[1].points] == [6, 7, 8]


def test_contents_are_grouped_in_rows(spark, monkeypatch):
    """Nothing is shuffled, but for rows that have a doc_id in common."""
    docs = spark.createDataFrame([(1, "b a a"), (2, "a")], "doc_id bigint, text string")
    again = docs.unionByName(spark.createDataFrame([(1, "a c"), (None, "c"), (None, "c")], docs.schema))
    for some, want in ((docs, [(1, "a", 2), (1, "b", 1), (2, "a", 1)]), (again, [(None, "c", 2), (1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "a", 1)])):
        monkeypatch.setattr(queries, "_docs", lambda s, d, some=some: some)
        got = queries.QUERIES["contents_bm25"](spark, "")
        assert sorted((tuple(r) for r in got.select("doc_id", "term", "tf").collect()), key=repr) == sorted(want, key=repr)
        assert sorted((tuple(r) for r in queries.QUERIES["contents_mini"](spark, "").select("doc_id", "term").collect()), key=repr) == sorted((w[:2] for w in want), key=repr)
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (some is again)


def test_tuples_are_made_without_pandas(spark):
    """Entries go through flat arrays, of words and of nodes within."""
    docs = spark.createDataFrame([(1, "a b a c b"), (2, "a"), (3, "c b x a")], "doc_id bigint, text string")
    found = search.rich(search.Corpus.of(docs), "('a b' | c) & b", search.Stats(9, {"a": 0.5, "b": 0.5, "c": 0.5}))
    assert "pandas" not in " ".join(map(str, search._tuples.__code__.co_names))
    got = {r.doc_id: [(e.lower, e.upper, e.weight, [tuple(p) for p in e.points]) for e in r.entries] for r in found.collect()}
    assert got == {1: [(0, 1, 0.875, [(0, 0), (1, 1), (1, 3)]), (1, 3, 0.75, [(3, 2), (1, 3)]), (3, 4, 0.75, [(3, 2), (4, 3)])], 3: [(0, 1, 0.75, [(0, 2), (1, 3)])]}


def test_grouping_holds_no_more_for_a_larger_batch(spark, monkeypatch):
    """What a task's Python holds besides its batch, Arrow's memory and numpy's, follows GROUPED and not the batch."""
    docs, made = spark.createDataFrame([], "doc_id bigint, text string"), []
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, group, schema: made.append(group) or self)
        analysis.plain_postings(docs)
    monkeypatch.setattr(analysis, "GROUPED", 1 << 14, raising=False)

    def held(n):
        words = pa.array([[f"w{(d * 31 + k) % 3000}" for k in range(128)] for d in range(n)])
        batch, default = pa.record_batch([pa.array(range(n), pa.int64()), words], ["doc_id", "words"]), pa.default_memory_pool()
        own = pa.proxy_memory_pool(default)
        pa.set_memory_pool(own)
        tracemalloc.start()
        try:
            assert sum(len(out.column(3).flatten()) for out in made[0](iter([batch]))) == 128 * n
            return tracemalloc.get_traced_memory()[1] + own.max_memory()
        finally:
            tracemalloc.stop()
            pa.set_memory_pool(default)

    held(512)
    assert held(4096) < 1.3 * held(512)


def test_documents_of_a_corpus_made_in_runs(spark, tmp_path, monkeypatch):
    """The postings of a stored corpus come in runs of GROUPED tokens, and words are found in all of them, without Python."""
    monkeypatch.setattr(analysis, "GROUPED", 8)
    docs = spark.createDataFrame([(k, "a b c " + "d " * (k % 2)) for k in range(10)], "doc_id bigint, text string").coalesce(1)
    stored = search.Corpus.of(docs).stored(f"file://{tmp_path}/corpus")
    terms = [r.term for r in stored.postings.coalesce(1).collect()]
    assert len(terms) == 35 and sum(x > y for x, y in zip(terms, terms[1:])) == 4  # two documents a run
    every, without = search.mini(stored, "a & b & d"), search.rich(stored, "a ! d", search.Stats(10, {"a": 0.5, "d": 0.5}))
    assert {r.doc_id: (r.n_words, len(r.factors)) for r in every.collect()} == {k: (4, 3) for k in range(1, 10, 2)}
    assert {r.doc_id: [e.lower for e in r.entries] for r in without.collect()} == {k: [0] for k in range(0, 10, 2)}
    for df in (every, without):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan
