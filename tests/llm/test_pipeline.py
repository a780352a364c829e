"""The stages of corpus_pipeline, each against a plain version on the same input, and the whole."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lexiquarry.llm import line_templates, mixing, quality, tokens
from tests.llm.test_jaccard import brute
from tests.llm.test_quality import corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """240 documents with labels: boilerplate lines, near copies, junk, an empty and a null text."""
    rows = corpus(240)
    texts = {i: "\n".join(" ".join(t.split(" ")[k : k + 9]) for k in range(0, len(t.split(" ")), 9)) for i, t, _ in rows}
    for i in range(0, 240, 3):
        texts[i] += "\nAll rights of this text are reserved by us"
    for i in range(0, 200, 8):
        words = texts[i].split(" ")
        words[3] = "changed"
        texts[i + 4] = " ".join(words)
    texts |= {300: "", 301: None}
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, _, k in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    kept = stages["quality classifier"](spark, docs, folder)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    before = rows_of(docs)
    p = quality.probabilities(model, [r[1] for r in before])[:, 0]
    assert rows_of(kept) == [r for r, x in zip(before, p) if not x < quality.THRESHOLD]
    assert 100 < kept.count() < 150

    kept = kept.cache()
    cleaned = stages["line dedup"](spark, kept, folder).cache()
    con = duckdb.connect()
    frame = kept.toPandas()
    con.register("documents", frame)
    want = {r[0]: r[1] for r in con.sql(line_templates.sql()).fetchall()}
    assert {r[0]: r[1] for r in rows_of(cleaned)} == {d: None if t is None or t != t else t for d, t in want.items()}
    assert any(r[1] != s[1] for r, s in zip(rows_of(kept), rows_of(cleaned)))

    single = stages["n-gram Jaccard join"](spark, cleaned, folder).cache()
    later = {b for _, b in brute([(r[0], r[1]) for r in rows_of(cleaned)], 3, 0.5)}
    assert rows_of(single) == [r for r in rows_of(cleaned) if r[0] not in later] and later

    mixed = stages["mixing sources"](spark, single, folder).cache()
    texts = {r[0]: r[1] or "" for r in rows_of(single)}
    assert all(r[1].removesuffix(mixing.END) in texts[r[0]] and r[4] == len(r[1]) for r in rows_of(mixed))
    totals = {}
    for r in rows_of(single):
        totals[r[3]] = totals.get(r[3], 0) + len(mixing.token_starts((r[1] or "").encode()))
    blocks = mixing.mix(single).collect()
    assert len(blocks) == sum(-(-n // mixing.BLOCK) for n in totals.values())
    assert sum(len(r.doc_ids) for r in blocks) == mixed.count()
    assert sum(r.n_tokens for r in blocks) == sum(max(1, len(r[1].split())) for r in rows_of(mixed))

    order = mixed.collect()
    windows = stages["packing"](spark, mixed, folder).orderBy("window_id").collect()
    stream = [x for r in order for x in [*tokens.vocabulary().encode(r.text.removesuffix("\n")).tolist(), *[tokens.END_ID] * r.text.endswith("\n")]]
    assert [x for w in windows for x in np.frombuffer(w.ids, "<u2").tolist()] == stream
    assert 0 < stream.count(tokens.END_ID) < len(order)


def test_odd_tables(spark, folder):
    """Empty tables, repeated rows, nulls, a very long text and further columns, through all stages."""
    stages = corpus_pipeline.STAGES
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = (900, "a very long text of many words " * 100_000, "en", "s0", 3_100_000)
    odd = [long, long, (901, None, None, None, None), (None, "no id here", "en", None, 10), (902, "", "en", "s1", 0)]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 AS key", "2 AS gone_id", "3 AS part", "'x' AS Stripped", "4 AS `a.b`")
    for table in (docs.limit(0), more):
        rows = table
        for k, (name, stage) in enumerate(stages):
            rows = stage(spark, rows, folder).cache()
            n = rows.count()
            assert (n == 0) == (table is not more), name
            if k < 3:
                assert rows.columns == table.columns
            elif k == 3:
                assert rows.columns == COLUMNS


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"window_id", "ids", "doc_ids"} <= set(out.columns)
