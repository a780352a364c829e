"""Streams into an index; ids that can't be; layers."""

import pytest

from pyspark.sql import functions as F

from lexiquarry.operators import analysis, search
from lexiquarry.sources.index import Conflict, Index, merge_run
from lexiquarry.streaming.ingest import ingest

DDL = "entity_id string, text string, extra string"


def live(index):
    return {r.entity_id: r.extra for r in index.entities().collect()}


def test_stream(spark, tmp_path):
    index = Index.temporary(spark)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    spark.createDataFrame([("a", "one two", "x"), ("b", "two three", "x")], DDL).coalesce(1).write.parquet(source)

    def run():
        ingest(spark.readStream.schema(DDL).parquet(source), index, checkpoint).awaitTermination()

    run()
    assert live(index) == {"a": "x", "b": "x"}
    spark.createDataFrame([("b", "four", "y"), ("c", None, None)], DDL).coalesce(1).write.mode("append").parquet(source)
    run()
    assert live(index) == {"a": "x", "b": "y", "c": None}
    again = spark.createDataFrame([("z", "never", "z")], DDL)
    index.upsert(again, ("ingest", 1))  # a batch that was added before
    assert "z" not in live(index)
    assert search.mini(index.corpus(), "two").count() == 1


def test_ids(spark):
    index = Index.temporary(spark)
    with pytest.raises(Exception, match="entity_id is empty"):
        index.upsert(spark.createDataFrame([("", "x", None)], DDL))
    index.upsert(spark.createDataFrame([("a", "x", "1")], DDL))
    with pytest.raises(Conflict):
        index._publish(index.manifest())
    gone = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    assert {r.entity_id: r.deleted for r in index.delete(gone).collect()} == {"a": True, "b": False}
    assert {r.deleted for r in index.delete(gone).collect()} == {False}
    assert index.set_extras(spark.createDataFrame([("a", "2")], "entity_id string, extra string")).count() == 0
    assert live(index) == {} and index.check().count() == 0


def rows(spark, *data):
    return spark.createDataFrame([(*r, None)[:3] for r in data], DDL)


def test_dense_ids_that_never_meet(spark):
    index = Index.temporary(spark)
    manifest = index.manifest()
    manifest.number, manifest.next = 1, (1 << 45) - 3
    index._publish(manifest)
    index.upsert(rows(spark, *((f"e{i:03}", f"word w{i}") for i in range(40))).repartition(7))
    index.upsert(rows(spark, *((f"f{i:03}", f"word v{i}") for i in range(40))).repartition(5))
    found = index.entities().collect()
    first = (1 << 45) - 3
    assert sorted(r.doc_id for r in found) == list(range(first, first + 80)) and index.max_index() == first + 79
    assert search.mini(index.corpus(), "word").select("doc_id").distinct().count() == 80
    assert index.get_entity("f007").first().doc_id == index.get_entity(index=index.get_entity("f007").first().doc_id).first().doc_id
    index.merge()
    ids = [r.doc_id for r in index.entities_by_id().collect()]
    assert ids == list(range(ids[0], ids[0] + 80)) and index.check().count() == 0


def test_repeated_ids_and_crossing_tags(spark):
    index = Index.temporary(spark)
    versions = spark.createDataFrame([("a", "old", 1), ("a", "new", 7), ("b", "x", None)], "entity_id string, text string, version bigint")
    index.upsert(versions)
    assert {r.entity_id: r.version for r in index.entities().collect()} == {"a": 7, "b": 1}
    assert search.mini(index.corpus(), "old").count() == 0 and search.mini(index.corpus(), "new").count() == 1
    index.set_extras(spark.createDataFrame([("a", "p"), ("a", "q"), ("a", None), ("b", None)], "entity_id string, extra string"))
    assert live(index) == {"a": "q", "b": None}
    crossing = spark.createDataFrame([("c", [("x", None), ("y", None), ("z", None)], [("f", 0, 1), ("g", 1, 2)])], "entity_id string, blocks array<struct<text: string, number: double>>, tags array<struct<field: string, lower: int, upper: int>>")
    with pytest.raises(Exception, match="tags overlap"):
        index.upsert(crossing)
    assert set(live(index)) == {"a", "b"}
    index.upsert(crossing.withColumn("tags", F.slice("tags", 1, 1)))  # texts and blocks in one index
    assert search.mini(index.corpus(), "y | new").count() == 2
    index.merge()
    assert search.rich(index.corpus(), "cover(f, y)").count() == 1 and search.mini(index.corpus(), "new").count() == 1


def test_merge_of_a_run_while_others_write(spark):
    """What is added, deleted and patched during a merge counts as later."""
    index = Index.temporary(spark)
    for k in range(4):
        index.upsert(rows(spark, (f"e{k}", f"t{k} all"), ("same", f"s{k} all")))
    index.delete(rows(spark, ("e1", "")))
    index.set_extras(spark.createDataFrame([("e0", "patched")], "entity_id string, extra string"))

    class Disturbed(Index):
        def _bulletin(self, *args):
            out = super()._bulletin(*args)
            other = Index(spark, self.path)
            other.upsert(rows(spark, ("e2", "t2 later"), ("new", "all")))
            other.delete(rows(spark, ("e0", "")))
            other.set_extras(spark.createDataFrame([("same", "late")], "entity_id string, extra string"))
            return out

    Disturbed(spark, index.path).merge(0, 3)
    assert len(index.manifest().segments) == 3 and len(index.manifest().segments[0]["sources"]) == 3
    assert live(index) == {"e2": None, "e3": None, "same": "late", "new": None}
    words = {r.term: r.df for r in index.key_stats().collect()}
    assert words == {"t2": 1, "later": 1, "t3": 1, "s3": 1, "all": 3}
    index.merge()
    assert live(index) == {"e2": None, "e3": None, "same": "late", "new": None} and len(index.manifest().segments) == 1
    assert {r.term: r.df for r in index.key_stats().collect()} == words
    assert index.manifest().deletes == index.manifest().patches == []
    assert [r.term for r in index.list_keys("*t?").collect()] == ["t2", "t3"] and index.key_stats("all").first().df == 3
    assert index.key_block("all").count() == 3 and index.bulletin().first().keys == 5
    stale = index.fork()
    index.upsert(rows(spark, ("only", "here")))
    assert "only" not in live(stale)


def test_which_segments_are_merged():
    assert merge_run([]) is None and merge_run([5]) is None and merge_run([5, 0, 5]) is None
    assert merge_run([10] * 8) == (0, 8)
    assert merge_run([100_000, 10, 10, 10]) == (1, 4)
    assert merge_run([10, 12, 0, 500_000, 500_000]) == (0, 2)
    first, behind = merge_run([50_000, 3, 4, 5, 60_000, 2])
    assert (first, behind) == (1, 4)


def test_compaction_after_many_batches(spark):
    index = Index.temporary(spark)
    for k in range(6):
        index.upsert(rows(spark, (f"e{k}", f"t{k}")), ("stream", k))
    assert index.compact(2) >= 1 and len(index.manifest().segments) <= 2
    assert len(live(index)) == 6 and index.manifest().batches == {"stream": 5}


def test_a_merge_of_texts_moves_no_postings(spark, monkeypatch):
    index = Index.temporary(spark)
    rows = spark.createDataFrame([("x", "a b"), ("y", "b c"), ("z", "c c d")], "entity_id string, text string")
    index.upsert(rows)
    index.upsert(rows.filter("entity_id = 'x'").withColumn("text", F.lit("d e")))
    index.delete(rows.filter("entity_id = 'y'"))
    want, read, tables = sorted(index.key_stats().collect()), [], Index._tables
    monkeypatch.setattr(Index, "_tables", lambda self, name, segments: read.append(name) or tables(self, name, segments))
    index.merge()
    assert "postings" not in read and "bodies" in read
    assert sorted(index.key_stats().collect()) == want == [("c", 1), ("d", 2), ("e", 1)]


def test_an_entity_of_an_index_made_in_runs(spark, monkeypatch):
    """The texts of every addition are grouped GROUPED tokens at a time, and an entity is found without Python."""
    monkeypatch.setattr(analysis, "GROUPED", 6)
    rows = spark.createDataFrame([(f"e{k}", f"b a x{k}", "old") for k in range(6)], "entity_id string, text string, extra string").coalesce(1)
    index = Index.temporary(spark)
    index.upsert(rows)
    index.upsert(rows.filter("entity_id < 'e4'").withColumn("extra", F.lit("new")))
    index.set_extras(spark.createDataFrame([("e5", "patched")], "entity_id string, extra string"))
    for segment, n in zip(index.manifest().segments, (6, 4), strict=True):
        terms = [r.term for r in spark.read.parquet(f"{segment['path']}/postings").coalesce(1).collect()]
        assert len(terms) == 3 * n and sum(a > b for a, b in zip(terms, terms[1:])) == n // 2 - 1  # two documents a run
    found = {e: index.get_entity(e) for e in ("e0", "e4", "e5", "e9")}
    assert {e: [r.extra for r in df.collect()] for e, df in found.items()} == {"e0": ["new"], "e4": ["old"], "e5": ["patched"], "e9": []}
    plan = found["e0"]._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "EqualTo(entity_id,e0)" in plan
