"""Operator 8: what is planted is found, and the scoring agrees with a plain version."""

import random
from collections import defaultdict

import pytest

from lexiquarry.llm import identifiers
from lexiquarry.llm.common import Tables

DDL = "doc_id bigint, text string, lang string, entity string, seed int, patterns string"


def corpus(seed=5, n=300):
    """Documents and what is planted in each; cards and phones often fail the recognisers."""
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("abehinorst") for _ in range(rng.randint(2, 7))) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    make = {
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "card": lambda: "4" + digits(15),
        "ip": lambda: ".".join(str(rng.randint(1, 250)) for _ in range(4)),
        "email": lambda: f"{words(1)}.{digits(2)}@mail{digits(1)}.example.org",
        "secret": lambda: rng.choice([f'token = "{hexes(40)}"', f"password=a1{hexes(16)}", "AKIA" + "".join(rng.choice("ABCDEFG234567") for _ in range(16))]),
    }
    rows, planted = [], {}
    for i in range(n):
        text, mine = words(20), []
        if i % 3 == 0:
            for kind in rng.sample(list(make), rng.randint(1, 3)):
                x = make[kind]()
                text += f" {x}{rng.choice(['', '.', ',', '!!', '%%%'])} {words(5)}"
                mine.append((kind, x.split('"')[1] if '"' in x else x))
        if i % 4 == 0:
            text += "\nLicensed under CC BY 4.0.\nversion 3. of 12 parts " + words(3)
        rows.append((i, text))
        planted[i] = mine
    return rows, planted


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "x", 1, "y") for d, t in rows], DDL).repartition(3)


def test_planted_are_found_and_nothing_else(spark):
    rows, planted = corpus()
    rows += [(None, "mail to a.b@c.example.org now"), (900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1]), (903, "word " * 100_000 + "x.1@mail1.example.org")]
    out = identifiers.find(table(spark, rows)).collect()
    got = defaultdict(set)
    for r in out:
        got[r.doc_id].add((r.kind, r.entity))
    missed = [(i, x) for i, xs in planted.items() for x in xs if x not in got[i]]
    extra = [(i, x) for i, xs in planted.items() for x in got[i] if x not in xs]
    total = sum(map(len, planted.values()))
    assert len(missed) <= 0.01 * total and len(extra) <= 0.01 * total, (missed, extra)
    assert any(not r.seed and r.kind == "card" for r in out) and any(not r.seed and r.kind == "phone" for r in out)
    assert got[None] == {("email", "a.b@c.example.org")} and got[902] == got[0] and 900 not in got and 901 not in got
    assert [(r.start, r.entity) for r in out if r.doc_id == 903] == [(500_000, "x.1@mail1.example.org")]
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.start + len(r.entity)] == r.entity for r in out)
    assert identifiers.find(table(spark, rows).limit(0)).count() == 0


def test_scores_against_plain_python(spark):
    rows, _ = corpus(8, 120)
    found = identifiers._found(table(spark, rows))
    edges, seeds = defaultdict(set), {}
    for r in found.collect():
        for p in r.patterns:
            edges[p].add(r.entity)
        if r.seed:
            seeds[r.entity] = min(r.seed, seeds.get(r.entity, r.seed))
    known = {e: (k, 1.0) for e, k in seeds.items()}
    for _ in range(identifiers.ROUNDS):
        best = {}
        for p, members in edges.items():
            for kind in {known[e][0] for e in members if e in known}:
                a = sum(known[e][1] for e in members if e in known and known[e][0] == kind)
                rest = sum(known[e][1] for e in members if e in known)
                c = round(a / (rest + identifiers.UNKNOWN * sum(e not in known for e in members)), 9)
                if c >= identifiers.CONFIDENCE and round(a, 6) >= identifiers.SUPPORT:
                    for e in members:
                        best[e] = max(best.get(e, (0, "")), (c, kind))
        known = {e: (k, c) for e, (c, k) in best.items() if e not in seeds} | {e: (k, 1.0) for e, k in seeds.items()}
    got = {r.entity: (r.kind, r.score) for r in identifiers.scores(found, Tables(spark, "t")).collect()}
    assert got.keys() == known.keys()
    assert all(got[e][0] == k and got[e][1] == pytest.approx(c, abs=1e-5) for e, (k, c) in known.items())


def test_names_of_any_length_are_assigned():
    name = "the_very_long_name_of_a_setting_that_holds_the_" + "x" * 50 + "_password"
    for text, want in ((f'{name} = "', (name, "=", 0)), (f"a {name}:  ", (name, ":", 2)), ("a = b ", None), ("= ", None), ("x==", None), ("k:'", ("k", ":", 0)), ("", None)):
        assert identifiers.assigned(text, len(text)) == want
    assert [e for _, _, e, left, _ in identifiers.candidates(f"{name} = qwertyuiop") if left == f"{name} ="] == ["qwertyuiop"]
