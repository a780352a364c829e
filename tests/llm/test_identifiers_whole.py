"""Operator 8 on identifiers of many words."""

import random

from lexiquarry.llm import identifiers

DDL = "doc_id bigint, text string"


def test_long_phones_are_found_whole(spark):
    rng = random.Random(3)
    two = lambda: f"{rng.randint(10, 99)}"
    five = [f"+49 {two()} {two()} {two()} {two()}" for _ in range(8)]
    six = [f"+33 {rng.randint(1, 9)} {two()} {two()} {two()} {two()}" for _ in range(8)]
    rows = [(i, f"some words, call {x} at noon") for i, x in enumerate(five + six)]
    got = {r.doc_id: (r.kind, r.entity) for r in identifiers.find(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {i: ("phone", x) for i, x in enumerate(five + six)}


def test_candidates_of_a_long_row_grow_with_its_length():
    counts = [len(list(identifiers.candidates(" ".join(["12"] * n)))) for n in (32, 1000, 2000)]
    assert counts[0] == 32 * 33 // 2 and counts[2] < 2.01 * counts[1]
    assert max(e.count(" ") for _, _, e, _, _ in identifiers.candidates("x " + "1234 " * 6 + "y")) == 5


def test_words_without_digits_are_found_where_seeds_stand(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghkmnpqrst") for _ in range(n))
    seeds = [f'password = "{letters(10)}{i}{letters(4)}" api_key: {letters(9)}{i}{letters(6)} pwd={letters(6)}{i}' for i in range(8)]
    plain = ['password = "correcthorsebattery"', "api_key: QWERTYUIOPASDFGH", "pwd=swordfish"]
    rows = list(enumerate([*seeds, *(f"we know {x} of old" for x in plain), "title: whatever it is\nwords: password\nnothing here"]))
    got = {(r.doc_id, r.kind, r.entity) for r in identifiers.find(spark.createDataFrame(rows, DDL)).collect() if r.doc_id >= 8}
    assert got == {(8, "secret", "correcthorsebattery"), (9, "secret", "QWERTYUIOPASDFGH"), (10, "secret", "pwd=swordfish")}
