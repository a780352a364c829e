"""The pipeline's line dedup on lines that the bounds of operator 1's SQL leave out."""

import corpus_pipeline

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def own(i, k):
    """A line of document i alone."""
    return " ".join("".join("abcdefghij"[int(c)] for c in f"{i:03}{k}{w}") for w in range(9))


def dedup(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], DDL).repartition(4)
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert all(r.n_chars == len(r.text) for r in out.values())
    return [out[i].text for i in range(len(rows))]


def test_short_lines_go(spark):
    short = ["All rights reserved.", "Menu", "Back to top", "Contact us"]
    rows = ["\n".join([own(i, 0), short[i % 4], "", own(i, 1), str(i)]) for i in range(48)] + [own(99, 0) + "\nRead on"]
    want = ["\n".join([own(i, 0), "", own(i, 1), str(i)]) for i in range(48)] + rows[48:]
    assert dedup(spark, rows) == want


def test_templates_of_many_fields_go(spark):
    name = lambda i, c: c + "".join("abcdefghij"[int(d)] for d in str(i))
    lines = [
        lambda i: f"User {i} logged in at 12:{i}",  # 2 of 6 words vary
        lambda i: f"Page {i} of {i + 9} | Printed 2021-03-{i}",  # 3 of 7
        lambda i: f"Took {i}ms {i}kB {i}%",  # 3 of 4
        lambda i: f"Order was sent {name(i, 'x')} {name(i, 'y')} from {name(i, 'z')}",  # 3 of 7, without digits
        lambda i: f"Dear guest of {' '.join(name(i, c) for c in 'pqrs')}",  # 4 of 7
    ]
    rows = ["\n".join([own(i, 0), lines[i % 5](i), own(i, 1), f"{i} {i + 1}"]) for i in range(60)]
    rows += ["\n".join([own(i, 0), f"it is the {' '.join(name(i, c) for c in 'pqrst')}"]) for i in range(60, 80)]  # 5 of 8: prose that begins alike
    want = ["\n".join([own(i, 0), own(i, 1), f"{i} {i + 1}"]) for i in range(60)] + rows[60:]
    assert dedup(spark, rows) == want


def test_lines_go_whatever_their_share_but_copies_stay(spark):
    header = "\n".join(own(900, k) for k in range(3))
    rows = [f"{header}\n{own(i, 0)}\n{own(i, 1)}" for i in range(12)]  # 60 % in common: a similarity under 0.5
    copy = [own(800, k) for k in range(8)]
    rows += ["\n".join([*copy[:4], own(i, 0), *copy[5:]]) for i in range(20, 40)]
    rows += ["\n".join([header, own(40, 0)])]
    want = [f"{own(i, 0)}\n{own(i, 1)}" for i in range(12)] + rows[12:32] + [own(40, 0)]
    assert dedup(spark, rows) == want
