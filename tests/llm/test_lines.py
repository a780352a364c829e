"""Operator 1 against its SQL and in its corner cases."""

import duckdb
import pytest

from lexiquarry.llm import line_templates

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, stripped string, gone int"


def texts():
    """30 documents that share boilerplate, one of them with a variable word, and lines of their own."""
    out = []
    for i in range(30):
        own = [f"own line {'abcdefghij'[i % 10]}{'klm'[i // 10]} words {w} go here too" for w in ("red", "blue", "green", "grey")]
        out.append("\n".join([own[0], "Copyright 2024 by the big company all rights", own[1], f"Posted by our editor {'x' * (i + 1)} last night in town", own[2], own[3]]))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in enumerate(rows)], DDL).repartition(4)


@pytest.mark.parametrize("set_lines", [10**6, 0])
def test_templates_go_and_the_rest_stays(spark, set_lines):
    copies = ["\n".join(f"a whole copied document line number {w} stays" for w in ("one", "two", "three"))] + ["\n".join(["a whole copied document line number one stays", f"tail {'ab' * k}"]) for k in range(1, 15)]
    rows = texts() + copies + [None, "", "short line\n\n", texts()[0], texts()[0]]
    docs = table(spark, rows)
    out = {r.doc_id: r for r in line_templates.drop_lines(docs, counted="n", set_lines=set_lines).collect()}
    assert len(out) == len(rows) and list(out[0].asDict()) == [*docs.columns, "n"]
    for i in range(30):
        assert out[i].n == 2 and out[i].text == "\n".join(x for k, x in enumerate(rows[i].split("\n")) if k not in (1, 3))
        assert out[i].n_chars == len(out[i].text)
    for i in range(31, len(rows) - 2):
        assert (out[i].text, out[i].n) == (rows[i], 0)
    assert out[len(rows) - 1].n == 2 and out[0].gone == 1 and out[0].stripped == "x"


def test_few_documents_or_equal_ones_are_no_recurrence(spark):
    nine = ["the same line in each of them\n" + f"other {'q' * i} words of its own are here" for i in range(1, 10)]
    same = ["one more line that is in all copies of it\nand another that belongs to this text alone I say"] * 40
    assert all(r.n == 0 for r in line_templates.drop_lines(table(spark, nine + same), counted="n").collect())
    assert line_templates.drop_lines(table(spark, ["x"]).limit(0)).count() == 0


def test_one_document_with_many_like_lines(spark):
    rows = ["\n".join(f"total of row {'ab' * i} is quite large here" for i in range(1, 30)) + "\n" + "x" * 5000]
    assert line_templates.drop_lines(table(spark, rows), counted="n").first().n == 0


def test_sql_agrees(spark):
    rows = texts() + [None, "", "a b c d e\na b c d e\n\n"] + [f"a b c d e 4{i}\nthen\tsome other   words\r\nthat are not the same {'z' * i}" * 2 for i in range(20)]
    docs = table(spark, rows)
    got = line_templates.drop_lines(docs, counted="n_dropped").select("doc_id", "text", "n_chars", "n_dropped").toPandas()
    con = duckdb.connect()
    documents = docs.toPandas()
    con.register("documents", documents)
    want = con.sql(line_templates.sql()).fetchall()
    key = lambda r: r[0]
    clean = lambda r: (r[0], None if r[1] is None or r[1] != r[1] else r[1], None if r[2] is None or r[2] != r[2] else int(r[2]), int(r[3]))
    assert sorted(map(clean, got.itertuples(index=False)), key=key) == sorted(map(clean, want), key=key)
    assert any(r[3] for r in want)
