"""Operator 1: drop lines whose template recurs across documents.

A line is parsed by a tree of fixed depth: first by its number of words, then
by its leading words; a word with a digit in it counts as variable, ``<*>``.
In a leaf of the tree, a word that many documents have at the same place is
constant and any other is a variable field.  The sequence that remains is the
line's template.  Lines whose template many documents share are dropped.

Nothing depends on the order of the lines, so the tree is built by
aggregation: tasks first merge the equal lines of their input, one shuffle
brings the lines of a leaf together, and only the lines of leaves that enough
documents reach go any further.  Whether min_docs texts have something is
told from up to so many of their keys, so that hot lines, leaves and words
take no more room than others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join
from .common import Tables, arrow_schema, column, free_name, require, text_key

DEPTH = 3
MIN_DOCS = 10
#: Share of a line's words without a digit that must be constant.
SIMILARITY = 0.4
#: Texts that would lose more than this share may be copies of one another, which is then looked into.
HEAVY = 0.5
#: Up to so many recurring lines of so many bytes in all go to every task; beyond, a join takes their place.
SET_LINES, SET_BYTES = 1_000_000, 64 << 20
WILD = "<*>"
_FLUSH = 16 << 20
_WORD = re.compile(r"[^ \t\r\f\v]+")
_DIGIT = re.compile(r"[0-9]")
_RARE = re.compile(r"[\x1c-\x1f]")


def masked(line: str) -> str | None:
    """The words of a line, those with a digit replaced; None for a blank line."""
    words = line.split() if line.isascii() and not _RARE.search(line) else _WORD.findall(line)
    if not words:
        return None
    if _DIGIT.search(line):
        words = [WILD if _DIGIT.search(w) else w for w in words]
    return " ".join(words)


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(docs: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """Distinct masked lines of a task's input, with up to min_docs keys of texts that have them."""
    ddl = "leaf bigint, line string, texts array<bigint>"
    schema = arrow_schema(ddl)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(seen)
            for at in range(0, len(names), 20_000):
                part = names[at : at + 20_000]
                leaves = []
                for line in part:
                    words = line.split(" ")
                    leaves.append(_hash(f"{len(words)} " + " ".join(words[:depth])))
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(part, pa.string()), pa.array([seen[x] for x in part], pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            for text, key in zip(batch.column(0), batch.column(1).to_pylist()):
                for line in set((text.as_py() or "").split("\n")):
                    name = masked(line)
                    if name is None:
                        continue
                    have = seen.get(name)
                    if have is None:
                        seen[name] = [key]
                        size += len(name)
                    elif len(have) < min_docs and key not in have:
                        have.append(key)
                if size > _FLUSH:
                    yield from flush()
                    seen.clear()
                    size = 0
        yield from flush()

    text = column(docs, "text")
    return docs.select(text.alias("text"), text_key(text).alias("key")).mapInArrow(collect, ddl)


def _leaves(docs: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """The distinct lines of the leaves that min_docs texts may reach: leaf, line, texts (up to min_docs keys).

    The rows of a leaf pass by in order, so that no group of them is held.
    """
    ddl = "leaf bigint, line string, texts array<bigint>"
    schema = arrow_schema(ddl)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = line = None
        have: list[int] = []
        waiting: list[tuple] = []  # of a leaf that hasn't been reached often enough so far
        reached = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal reached
            if line is not None:
                reached += len(have)
                waiting.append((leaf, line, have))
                if reached >= min_docs:
                    out.extend(waiting)
                    waiting.clear()

        for batch in batches:
            for at, name, texts in zip(*(c.to_pylist() for c in batch.columns)):
                if at == leaf and name == line:
                    if len(have) < min_docs:
                        have = list(dict.fromkeys(have + texts))[:min_docs]
                    continue
                close()
                if at != leaf:
                    waiting.clear()
                    reached = 0
                leaf, line, have = at, name, texts
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return _lines(docs, depth, min_docs).repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(merge, ddl)


def _shared_by(rows: DataFrame, by: list[str], min_docs: int) -> DataFrame:
    """The values of ``by`` that min_docs different keys in ``texts`` have; counted in parts, no group is held."""
    return rows.select(*by, F.explode("texts").alias("key")).distinct().groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select(*by)


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, tables: Tables | None = None) -> DataFrame:
    """Masked lines whose template at least min_docs different texts share: line, template. See drop_lines."""
    tables = tables or Tables(docs.sparkSession, "lines")
    lines = tables.write(_leaves(docs, depth, min_docs), "leaves")
    words = lines.select("leaf", "line", "texts", F.posexplode(F.split("line", " ")).alias("place", "word"))
    lead = F.col("place") < depth
    constant = _shared_by(words.filter(~lead & (F.col("word") != WILD)), ["leaf", "place", "word"], min_docs).withColumn("fixed", F.lit(True))
    fixed = (F.col("word") != WILD) & (lead | F.coalesce("fixed", F.lit(False)))
    parsed = (
        words.drop("texts")
        .join(constant, ["leaf", "place", "word"], "left")
        .groupBy("leaf", "line")
        .agg(
            F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", F.when(fixed, F.col("word")).otherwise(WILD).alias("w")))), lambda x: x["w"])).alias("template"),
            F.avg(F.when(F.col("word") != WILD, fixed.cast("double"))).alias("alike"),
        )
        .filter(F.col("alike") >= similarity)
        .select("leaf", "line", "template")
    )
    parsed = tables.write(parsed.join(lines, ["leaf", "line"]).select("line", "texts", "template"), "parsed")
    out = tables.write(parsed.join(_shared_by(parsed, ["template"], min_docs), "template", "left_semi").select("line", "template"), "recurring")
    tables.drop(lines, parsed)
    return out


def _hashed(recurring: DataFrame) -> DataFrame:
    @F.pandas_udf("bigint")
    def hash_of(lines: pd.Series) -> pd.Series:
        return lines.map(_hash).astype("int64")

    return recurring.select(hash_of("line").alias("hash"), F.xxhash64("template").alias("template")).distinct()


def _known(recurring: DataFrame, set_lines: int):
    """Broadcast map of the recurring lines' hashes to those of their templates, or None where they are too many."""
    n, size = recurring.agg(F.count("*"), F.coalesce(F.sum(F.length("line")), F.lit(0))).first()
    if n > set_lines or size > SET_BYTES:
        return None
    return recurring.sparkSession.sparkContext.broadcast({r["hash"]: r["template"] for r in _hashed(recurring).collect()})  # of checked size


def _hits(docs: DataFrame, recurring: DataFrame, known) -> DataFrame:
    """Which recurring lines each text has: key, hash, template, size (characters of its lines of that kind), whole (of the text)."""
    ddl = "key bigint, hash bigint, template bigint, size bigint, whole bigint"
    schema = arrow_schema(ddl)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[int | None]] = [[], [], [], [], []]
            for t, key in zip(batch.column(0), batch.column(1).to_pylist()):
                mine: dict[int, int] = {}
                whole = t.as_py() or ""
                for line in whole.split("\n"):
                    if (x := masked(line)) is not None:
                        h = _hash(x)
                        if known is None or h in known.value:
                            mine[h] = mine.get(h, 0) + len(line)
                templates = [None if known is None else known.value[h] for h in mine]
                for values, more in zip(rows, ([key] * len(mine), mine, templates, mine.values(), [len(whole)] * len(mine))):
                    values += more
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=schema)

    text = column(docs, "text")
    found = docs.select(text.alias("text"), text_key(text).alias("key")).mapInArrow(find, ddl)
    return found if known is not None else found.drop("template").join(_hashed(recurring), "hash").select("key", "hash", "template", "size", "whole")


def _apart(docs: DataFrame, recurring: DataFrame, min_docs: int, set_lines: int, tables: Tables) -> DataFrame:
    """Of recurring lines, those whose template min_docs texts share if near copies count as one text: line, template.

    Texts that would lose more than HEAVY are the ones that may be near
    copies; the similar ones among them are found by their Jaccard similarity.
    """
    known = _known(recurring, set_lines)
    hits = tables.write(_hits(docs, recurring, known).distinct(), "hits")
    heavy = hits.groupBy("key").agg((F.sum("size") > HEAVY * F.first("whole")).alias("heavy")).filter("heavy").select("key")
    text = column(docs, "text")
    texts = docs.select(text.alias("text"), text_key(text).alias("key")).join(heavy, "key", "left_semi").dropDuplicates(["key"]).select(F.col("key").alias("doc_id"), "text")
    texts = tables.write(texts, "heavy")
    roots, _ = jaccard_join.similar_roots(texts, tables)
    counted = hits.select("key", "template").distinct().join(roots, F.col("key") == F.col("node"), "left")
    shared = counted.select("template", F.coalesce("root", "key").alias("text")).distinct().groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select(F.col("template").alias("shared"))
    out = tables.write(recurring.join(shared, F.xxhash64("template") == F.col("shared"), "left_semi").select("line", "template"), "apart")
    tables.drop(recurring, hits, texts)
    if known is not None:
        known.unpersist()
    return out


def _strip(text: str | None, gone) -> tuple[str | None, int]:
    """The text without the lines in gone, and how many went."""
    if not text:
        return text, 0
    lines = text.split("\n")
    kept = [x for x in lines if (name := masked(x)) is None or not gone(name)]
    return (text, 0) if len(kept) == len(lines) else ("\n".join(kept), len(lines) - len(kept))


def drop_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, counted: str | None = None, set_lines: int = SET_LINES) -> DataFrame:
    """The table with text (and n_chars, where there is one) without recurring lines; every row stays.

    Every line that isn't blank is parsed, however short.  A word at a place
    past the ``depth`` leading ones is constant if at least min_docs
    different texts have it there in the same leaf; a word with a digit is a
    field.  The line goes if at least ``similarity`` of its words without a
    digit are constant, it has such a word, and at least min_docs different
    texts have lines of its template.

    Lines go whatever their share of a text.  But copies aren't boilerplate:
    equal texts count as one of the min_docs, and so do texts that would lose
    more than HEAVY (by characters) and are connected by a Jaccard similarity
    as in ``jaccard_join``; a deduplication of documents is to judge them.

    Null and empty texts stay as they are; repeated rows are treated alike
    and count once; a very long text is handled whole; an empty table gives
    an empty one; ids may be null and other columns are kept, whatever their
    names.  ``counted`` names a column to add with the number of lines
    dropped.  Lines are compared by 64-bit hashes.
    """
    require(docs, ["text"])
    tables = Tables(docs.sparkSession, "lines")
    recurring = recurring_lines(docs, depth, min_docs, similarity, tables)
    recurring = _apart(docs, recurring, min_docs, set_lines, tables)
    known = _known(recurring, set_lines)
    held = free_name(docs, "stripped")
    kind = "text string, n int"
    text = column(docs, "text")
    if known is not None:

        @F.pandas_udf(kind)
        def strip(texts: pd.Series) -> pd.DataFrame:
            gone = known.value
            return pd.DataFrame([_strip(t, lambda x: _hash(x) in gone) for t in texts], columns=["text", "n"])

        out = docs.withColumn(held, strip(text))
    else:

        @F.pandas_udf(kind)
        def strip_these(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
            rows = [(t, 0) if g is None else _strip(t, (lambda x, s=set(g): _hash(x) in s)) for t, g in zip(texts, gone)]
            return pd.DataFrame(rows, columns=["text", "n"])

        key, gone = free_name(docs, "text_key"), free_name(docs, "gone")
        hit = _hits(docs, recurring, None).groupBy("key").agg(F.collect_set("hash").alias(gone)).withColumnRenamed("key", key)  # the lines of one text
        joined = docs.withColumn(key, text_key(text)).join(hit, key, "left")
        out = joined.withColumn(held, strip_these(column(joined, "text"), F.col(gone)))
    names = [c for c in docs.columns]
    new = {"text": F.col(held)["text"]}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col(held)["n"] > 0, F.length(F.col(held)["text"])).otherwise(column(docs, "n_chars")).cast(docs.schema["n_chars"].dataType)
    chosen = [(new[c] if c in new else column(out, c)).alias(c) for c in names]
    return out.select(*chosen, *([F.col(held)["n"].alias(counted)] if counted else []))


def sql() -> str:
    """drop_lines over documents in DuckDB's SQL, with the default parameters."""
    return rf"""
WITH RECURSIVE texts AS (SELECT DISTINCT text FROM documents WHERE text <> ''),
split AS (SELECT text, unnest(string_split(text, chr(10))) AS line FROM texts),
words AS (SELECT text, line, list_filter(string_split_regex(line, '[ 	]+'), lambda w: w <> '') AS w FROM (SELECT DISTINCT text, line FROM split)),
kept AS (SELECT text, line, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{WILD}' ELSE x END) AS w FROM words WHERE len(w) >= 1),
named AS (SELECT text, line, w, array_to_string(w, ' ') AS name, len(w) || ' ' || array_to_string(w[1:{DEPTH}], ' ') AS leaf FROM kept),
hot AS (SELECT leaf FROM named GROUP BY leaf HAVING count(DISTINCT text) >= {MIN_DOCS}),
mine AS (SELECT DISTINCT n.text, n.name, n.leaf, n.w FROM named n SEMI JOIN hot USING (leaf)),
spread AS (SELECT text, name, leaf, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM mine),
fixed AS (SELECT leaf, place, word FROM spread WHERE place > {DEPTH} AND word <> '{WILD}' GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_DOCS}),
parsed AS (
  SELECT s.name, s.leaf, string_agg(CASE WHEN word <> '{WILD}' AND (place <= {DEPTH} OR f.leaf IS NOT NULL) THEN word ELSE '{WILD}' END, ' ' ORDER BY place) AS template,
         avg(CASE WHEN place <= {DEPTH} OR f.leaf IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (word <> '{WILD}') AS alike
  FROM (SELECT DISTINCT name, leaf, word, place FROM spread) s LEFT JOIN fixed f USING (leaf, place, word) GROUP BY s.name, s.leaf),
alike AS (SELECT * FROM parsed WHERE alike >= {SIMILARITY}),
shared AS (SELECT template FROM alike JOIN (SELECT DISTINCT text, name FROM mine) USING (name) GROUP BY template HAVING count(DISTINCT text) >= {MIN_DOCS}),
recurring AS (SELECT DISTINCT name, template FROM alike SEMI JOIN shared USING (template)),
sized AS (SELECT text, line, count(*) * length(line) AS size FROM split GROUP BY text, line),
hits AS (SELECT n.text, n.name, template, sum(size) AS size FROM named n JOIN recurring USING (name) JOIN sized s ON n.text = s.text AND n.line = s.line GROUP BY ALL),
heavy AS (SELECT text FROM hits GROUP BY text HAVING sum(size) > {HEAVY} * length(text)),
{jaccard_join.closure_sql("SELECT text FROM heavy")},
grouped AS (SELECT x AS text, min(y) AS first_text FROM reach GROUP BY x),
spread_out AS (SELECT template FROM hits LEFT JOIN grouped USING (text) GROUP BY template HAVING count(DISTINCT coalesce(first_text, text)) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT name FROM recurring SEMI JOIN spread_out USING (template)),
drops AS (SELECT DISTINCT n.text, n.line FROM named n SEMI JOIN gone USING (name)),
marked AS (
  SELECT t.text, t.place, t.line, d.line IS NOT NULL AS drop
  FROM (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM texts) t LEFT JOIN drops d ON t.text = d.text AND t.line = d.line),
result AS (
  SELECT text, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT drop), '') AS stripped, count(*) FILTER (drop) AS n
  FROM marked GROUP BY text HAVING count(*) FILTER (drop) > 0)
SELECT d.doc_id, coalesce(r.stripped, d.text) AS text, coalesce(length(r.stripped), d.n_chars) AS n_chars, CAST(coalesce(r.n, 0) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN result r ON d.text = r.text
"""
