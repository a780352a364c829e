"""A stored index: segments of Parquet tables under a manifest.

A segment has entities (entity_id, doc_id, version, number, extra, bundle),
postings by term and document, bodies (the documents as they came) and
lengths; besides there are logs of deletions and of patches of extras.
Nothing is changed in place: every operation writes new files and then a
manifest with the next number, which makes them visible at once.  Which row
of an entity counts is told by the numbers of the operations when the index
is read, so that segments may be merged while others are added.

Ids of documents are allotted from a counter in the manifest, before the
tables that hold them are written: they are dense and never meet.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fields import Field, Fields
from ..functions.text import strmatch
from ..operators import analysis
from ..operators.search import Corpus, write_postings
from .shared import shared_dir

ENTITY = "entity_id string, doc_id bigint, version bigint, number bigint, extra string, bundle string"
#: Attempts to publish a manifest while others publish theirs.
ATTEMPTS = 50
_ROW = (1 << 33) - 1


class Conflict(RuntimeError):
    """Someone else has written the manifest in the meantime."""


@dataclass
class Manifest:
    number: int = 0
    segments: list[dict] = field(default_factory=list)
    deletes: list[dict] = field(default_factory=list)
    patches: list[dict] = field(default_factory=list)
    fields: list[dict] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)
    next: int = 0
    writes: int = 0


def merge_run(sizes: list[int]) -> tuple[int, int] | None:
    """Which neighbouring segments to merge, (first, behind the last), given their numbers of documents; 0 stands for one that is being merged.

    Segments are the better to merge the more alike in size, the smaller on
    average, and the more they are, up to about eight; of equally good runs
    the longest is taken.
    """

    def worth(run: list[int]) -> float:
        alike = 1 / (1 + math.log1p((max(run) - min(run)) / 1000))
        small = 0.2 + 0.8 * math.sin(1.57 + math.atan((sum(run) // len(run) - 1) / 10_000))
        many = 0.2 + 0.8 * math.sin(2 * math.atan((len(run) - 2) / 6))
        return alike * small * many

    runs = [(worth(sizes[a:b]), b - a, -a) for a in range(len(sizes)) for b in range(a + 2, len(sizes) + 1) if all(sizes[a:b])]
    if not runs:
        return None
    _, n, first = max(runs)
    return -first, n - first


class Index:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, fields: Fields | None = None):
        self.spark, self.path, self.given = spark, path.rstrip("/"), fields
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(f"{self.path}/manifest"))

    @classmethod
    def temporary(cls, spark: SparkSession, fields: Fields | None = None) -> Index:
        """An index in the shared folder that goes when the driver's JVM ends."""
        out = cls(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", fields)
        out._fs.deleteOnExit(out._hadoop(out.path))
        return out

    # ------------------------------------------------------------ manifest

    def manifest(self) -> Manifest:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(f"{self.path}/manifest"))]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return Manifest()
        stream = self._fs.open(self._hadoop(f"{self.path}/manifest/{max(numbers):012d}.json"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _publish(self, manifest: Manifest) -> Manifest:
        to = self._hadoop(f"{self.path}/manifest/{manifest.number:012d}.json")
        part = self._hadoop(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(part)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        if self._fs.exists(to) or not self._fs.rename(part, to):
            self._fs.delete(part, False)
            raise Conflict(f"manifest {manifest.number} exists")
        return manifest

    def _next(self) -> Manifest:
        out = self.manifest()
        out.number += 1
        return out

    def _commit(self, change: Callable[[Manifest], bool | None]) -> Manifest:
        """Publish a change to the latest manifest, again where someone else was first; one that returns False isn't made."""
        for _ in range(ATTEMPTS):
            manifest = self._next()
            if change(manifest) is False:
                return manifest
            try:
                return self._publish(manifest)
            except Conflict:
                continue
        raise Conflict(f"{self.path} is published to all the time")

    def _allot(self, n: int) -> int:
        """The first of n ids."""

        def take(manifest: Manifest) -> None:
            manifest.next += n

        return self._commit(take).next - n

    def fork(self) -> Index:
        """An index of its own that begins with what this one has. Segments are shared, as they don't change."""
        out = Index.temporary(self.spark, self.given)
        manifest = self.manifest()
        if manifest.number:
            out._publish(manifest)
        return out

    def fields(self) -> Fields:
        stored = [Field(**(f | {"indents": tuple(map(tuple, f["indents"])), "defined": frozenset(f["defined"])})) for f in self.manifest().fields]
        return Fields(stored) if stored else Fields(self.given or ())

    # ------------------------------------------------------------ writing

    def upsert(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add documents (entity_id; text, or blocks and tags; version, extra, bundle if there are) as a segment.

        A document replaces what the index has under its id.  Of several with
        one id that of the greatest version counts, by default the number of
        this addition; a null or empty id, or
        tags that cross, raise an error.  A ``batch`` (stream, number) that
        was added before is left out, so that a stream may send it again.
        """
        if batch and self.manifest().batches.get(batch[0], -1) >= batch[1]:
            return

        def begin(manifest: Manifest) -> None:
            manifest.writes += 1

        begun = self._commit(begin)
        number = begun.number
        at = f"{self.path}/segment-{number}-{uuid.uuid4().hex[:8]}"
        columns = {c: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind) for c, kind in (("version", "bigint"), ("extra", "string"), ("bundle", "string"))}
        body = [c for c in ("text", "blocks", "tags") if c in docs.columns]
        if "blocks" in body and "text" in body:
            body.remove("text")
        rows = docs.select("entity_id", F.coalesce(columns["version"], F.lit(begun.writes)).alias("version"), columns["extra"].alias("extra"), columns["bundle"].alias("bundle"), *body)
        rows = rows.withColumn("entity_id", F.when(F.length("entity_id") > 0, F.col("entity_id")).otherwise(F.raise_error(F.lit("entity_id is empty"))))
        if not rows.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # else no text is shuffled
            rows = rows.groupBy("entity_id").agg(F.max_by(F.struct("version", "extra", "bundle", *body), F.struct("version", F.xxhash64(*body))).alias("d")).select("entity_id", "d.*")
        source = self._numbered(rows, at)
        known = analysis.discover_fields(source, self.fields())
        source.select("entity_id", "doc_id", "version", F.lit(number).cast("bigint").alias("number"), "extra", "bundle").write.parquet(f"{at}/entities")
        source.select("doc_id", *body).write.parquet(f"{at}/bodies")
        bodies = self.spark.read.parquet(f"{at}/bodies")
        analysis.lengths(bodies, known).write.parquet(f"{at}/lengths")
        write_postings(analysis.postings(bodies, known), at, analysis.is_plain(bodies, known))
        segment = self._bulletin(at, number)
        self._drop(f"{at}/source")

        def add(manifest: Manifest) -> bool | None:
            if batch and manifest.batches.get(batch[0], -1) >= batch[1]:
                return False
            manifest.segments.append(segment)
            manifest.fields = [asdict(f) | {"defined": sorted(f.defined)} for f in known]
            if batch:
                manifest.batches[batch[0]] = batch[1]

        self._commit(add)

    def _drop(self, path: str) -> None:
        self._fs.delete(self._hadoop(path), True)

    def _numbered(self, rows: DataFrame, at: str) -> DataFrame:
        """The rows with doc_ids, ascending in their order and dense: a prefix sum over the numbers of rows in the partitions."""
        row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))
        rows.withColumns({"part_": F.spark_partition_id(), "row_": row}).write.parquet(f"{at}/source")
        written = self.spark.read.parquet(f"{at}/source")
        totals = written.groupBy("part_").agg(F.count("*").alias("n"))
        before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.select("part_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_"))  # a row a partition
        first = self._allot(written.count())
        return written.join(F.broadcast(bases), "part_").withColumn("doc_id", F.col("base_") + F.col("row_") + F.lit(first)).drop("part_", "row_", "base_")

    def _bulletin(self, at: str, number: int, sources: list[str] | None = None) -> dict:
        """What the manifest says of a segment."""
        postings = self.spark.read.parquet(f"{at}/postings")
        links, keys = postings.agg(F.count("*"), F.countDistinct("term")).first()
        documents = self.spark.read.parquet(f"{at}/entities").count()
        return {"path": at, "number": number, "documents": documents, "keys": keys, "links": links, "written": int(time.time()), "by": __name__.split(".")[0], "sources": sources or []}

    def bulletin(self) -> DataFrame:
        """A row a segment: path, number, documents, keys, links, written (seconds since 1970), by, sources."""
        return self.spark.createDataFrame([tuple(s[c] for c in ("path", "number", "documents", "keys", "links", "written", "by", "sources")) for s in self.manifest().segments], "path string, number bigint, documents bigint, keys bigint, links bigint, written bigint, by string, sources array<string>")

    def delete(self, ids: DataFrame) -> DataFrame:
        """Delete entities; returns entity_id and whether it was there."""
        at = f"{self.path}/deletes-{uuid.uuid4().hex[:8]}"
        live = self.entities().select("entity_id", F.lit(True).alias("was"))
        ids.select("entity_id").distinct().join(live, "entity_id", "left").select("entity_id", F.coalesce("was", F.lit(False)).alias("deleted")).write.parquet(at)
        self._commit(lambda m: m.deletes.append({"path": at, "number": m.number}))
        return self.spark.read.parquet(at)

    def set_extras(self, extras: DataFrame) -> DataFrame:
        """Give entities other extras (entity_id, extra); returns those that are there. What is deleted stays deleted.

        Of several extras for an id in one call the greatest counts, as rows
        have no order; a null only where there is no other.
        """
        at = f"{self.path}/patches-{uuid.uuid4().hex[:8]}"
        one = extras.groupBy("entity_id").agg(F.max("extra").alias("extra"))
        one.join(self.entities().select("entity_id"), "entity_id", "left_semi").write.parquet(at)
        self._commit(lambda m: m.patches.append({"path": at, "number": m.number}))
        return self.spark.read.parquet(at)

    def merge(self, first: int = 0, last: int | None = None) -> None:
        """One segment of what is live in segments first .. last - 1, with ids in the order of entities.

        Segments, deletions and patches that others add meanwhile stay as
        they are and count as later.  Where all segments are merged, the logs
        that were there at the beginning go.
        """
        begun = self.manifest()
        run = begun.segments[first:last]
        if not run:
            return
        everything = len(run) == len(begun.segments)
        number = run[-1]["number"]
        at = f"{self.path}/segment-{begun.number}-{uuid.uuid4().hex[:8]}"
        live = self._winners(begun, patched=everything)
        if not everything:
            mine = self._tables("entities", run).select(F.col("doc_id").alias("mine"))
            live = live.join(mine, F.col("doc_id") == F.col("mine"), "left_semi")
        ordered = live.withColumnRenamed("doc_id", "old").repartitionByRange("entity_id").sortWithinPartitions("entity_id")
        source = self._numbered(ordered, at)
        source.select("entity_id", "doc_id", "version", "number", "extra", "bundle").write.parquet(f"{at}/entities")
        moved = source.select(F.col("old").alias("doc_id"), F.col("doc_id").alias("new"))
        plain = analysis.is_plain(self._tables("bodies", run), self.fields())
        for name in ("bodies", "lengths", "postings"):
            if name == "postings" and plain:  # texts are moved but once, and smaller than their postings
                write_postings(analysis.postings(self.spark.read.parquet(f"{at}/bodies"), self.fields()), at, True)
                continue
            table = self._tables(name, run)
            table = table.join(moved, "doc_id").withColumn("doc_id", F.col("new")).select(*table.columns)
            write_postings(table, at) if name == "postings" else table.write.parquet(f"{at}/{name}")
        merged = self._bulletin(at, number, [s["path"].rsplit("/", 1)[-1] for s in run])
        self._drop(f"{at}/source")
        gone = {s["path"] for s in run}
        logs = {x["path"] for x in begun.deletes + begun.patches} if everything else set()

        def swap(manifest: Manifest) -> None:
            if not gone <= {s["path"] for s in manifest.segments}:
                raise Conflict("the segments have been merged by someone else")
            place = next(k for k, s in enumerate(manifest.segments) if s["path"] in gone)
            manifest.segments = [s for s in manifest.segments if s["path"] not in gone]
            manifest.segments.insert(place, merged)
            manifest.deletes = [x for x in manifest.deletes if x["path"] not in logs]
            manifest.patches = [x for x in manifest.patches if x["path"] not in logs]

        self._commit(swap)

    def compact(self, most: int = 4) -> int:
        """Merge runs of segments (see merge_run) until no more than ``most`` are left; returns the number of merges."""
        n = 0
        while len(segments := self.manifest().segments) > max(1, most):
            run = merge_run([max(1, s["documents"]) for s in segments])
            self.merge(*run)
            n += 1
        return n

    def remove(self) -> None:
        self._fs.delete(self._hadoop(self.path), True)

    # ------------------------------------------------------------ reading

    def _tables(self, name: str, segments: list[dict]) -> DataFrame:
        tables = [self.spark.read.parquet(f"{s['path']}/{name}") for s in segments]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t, allowMissingColumns=True)
        return out

    def _winners(self, manifest: Manifest, where: Column | None = None, patched: bool = True) -> DataFrame:
        """ENTITY of the live entities, with their patches or without. The condition is on entity_id and reaches the files."""
        events = self.spark.createDataFrame([], ENTITY + ", op string")
        for s in manifest.segments:
            events = events.unionByName(self.spark.read.parquet(f"{s['path']}/entities").withColumn("op", F.lit("set")))
        if where is not None:
            events = events.filter(where)
        if len(manifest.segments) == 1 and not manifest.deletes and not manifest.patches:
            return events.drop("op")
        for op, logs in (("delete", manifest.deletes), ("patch", manifest.patches)):
            for log in logs:
                rows = self.spark.read.parquet(log["path"]).drop("deleted").withColumns({"number": F.lit(log["number"]).cast("bigint"), "op": F.lit(op)})
                events = events.unionByName(rows if where is None else rows.filter(where), allowMissingColumns=True)
        kept = F.col("op") != "patch"
        last = F.max_by(F.struct("op", "number", "doc_id", "version", "extra", "bundle"), F.when(kept, F.col("number"))).alias("e")
        patch = F.max(F.when(~kept, F.struct("number", "extra"))).alias("p")
        live = events.groupBy("entity_id").agg(last, patch).filter("e.op = 'set'")
        extra = F.when(F.col("p.number") > F.col("e.number"), F.col("p.extra")).otherwise(F.col("e.extra")) if patched else F.col("e.extra")
        return live.select("entity_id", "e.doc_id", "e.version", "e.number", extra.alias("extra"), "e.bundle")

    def entities(self, where: Column | None = None) -> DataFrame:
        """Live entities: entity_id, doc_id, version, extra, bundle. One shuffle by id, however many segments and logs there are."""
        return self._winners(self.manifest(), where).drop("number")

    def get_entity(self, entity_id: str | None = None, index: int | None = None) -> DataFrame:
        """An entity by its id, or by the index of its document."""
        if entity_id is not None:
            return self.entities(F.col("entity_id") == entity_id)
        named = self._tables("entities", self.manifest().segments).filter(F.col("doc_id") == index).select("entity_id").collect()  # at most a row
        return self.entities(F.col("entity_id").isin([r[0] for r in named])).filter(F.col("doc_id") == index)

    def entities_by_index(self, start: int = 0) -> DataFrame:
        """Live entities from an index on, ascending."""
        return self.entities().filter(F.col("doc_id") >= start).orderBy("doc_id")

    def entities_by_id(self, start: str = "") -> DataFrame:
        """Live entities from an id on, in the order of bytes."""
        return self.entities(F.col("entity_id") >= start).orderBy("entity_id")

    def collection_size(self) -> int:
        return self.entities().count()

    def max_index(self) -> int:
        """The greatest index that was given to a document; -1 if none was."""
        return self.manifest().next - 1

    def corpus(self) -> Corpus:
        """What queries run over: postings and lengths of live entities alone."""
        manifest = self.manifest()
        if not manifest.segments:
            raise ValueError(f"{self.path} has no segments")
        postings, lengths, bodies = (self._tables(x, manifest.segments) for x in ("postings", "lengths", "bodies"))
        if len(manifest.segments) > 1 or manifest.deletes:
            live = self._winners(manifest).select("doc_id")
            postings, lengths, bodies = (x.join(live, "doc_id", "left_semi") for x in (postings, lengths, bodies))
        return Corpus(postings.select("term", "doc_id", "tf", "positions", "forms"), bodies, lengths, self.fields())

    def key_stats(self, term: str | None = None) -> DataFrame:
        """term and df, the number of live documents, of all terms or of one."""
        postings = self.corpus().postings
        return analysis.key_stats(postings if term is None else postings.filter(F.col("term") == term))

    def key_block(self, term: str, start: int = 0) -> DataFrame:
        """A term's postings, ascending from a document on: doc_id, tf, positions, forms."""
        return self.corpus().postings.filter((F.col("term") == term) & (F.col("doc_id") >= start)).drop("term").orderBy("doc_id")

    def list_keys(self, pattern: str = "*") -> DataFrame:
        """Terms that match a glob, in order, with df."""
        return analysis.key_stats(self.corpus().postings.filter(strmatch(F.col("term"), pattern.lower()))).orderBy("term")

    def check(self) -> DataFrame:
        """Postings without an entity in their segment, or of an index that was never given: term, doc_id. None in a sound index."""
        manifest = self.manifest()
        postings = self._tables("postings", manifest.segments).select("term", "doc_id")
        known = self._tables("entities", manifest.segments).filter(F.col("doc_id").between(0, manifest.next - 1)).select("doc_id")
        return postings.join(known, "doc_id", "left_anti").select("term", "doc_id")

    def stats(self) -> DataFrame:
        """A row an entity: entity_id, doc_id, version, extra_length, bundle_length."""
        return self.entities().select("entity_id", "doc_id", "version", F.coalesce(F.octet_length("extra"), F.lit(0)).alias("extra_length"), F.coalesce(F.octet_length("bundle"), F.lit(0)).alias("bundle_length"))
