"""From documents to tokens, terms and contents.

A document is a row with ``doc_id`` and either ``text`` or ``blocks`` (texts
and numbers, in order) with ``tags`` (a field and the first and last block
that it covers, outermost first).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fields import Fields
from ..functions.text import BLOCKS_TYPE, TAGS_TYPE, block_tokens, crossing, innermost, lower_term, token_texts

PLAIN_FORM = 255


def blocked(docs: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, blocks, tags, and columns that are carried along: a plain text is one block without tags; nulls have no blocks. Tags that cross are an error."""
    none = F.array().cast(BLOCKS_TYPE)
    one = F.lit(None).cast(BLOCKS_TYPE)
    if "text" in docs.columns:
        one = F.when(docs["text"].isNotNull(), F.array(F.struct(docs["text"].alias("text"), F.lit(None).cast("double").alias("number"))).cast(BLOCKS_TYPE))
    blocks = F.coalesce(docs["blocks"].cast(BLOCKS_TYPE), one, none) if "blocks" in docs.columns else F.coalesce(one, none)
    tags = F.array().cast(TAGS_TYPE)
    if "blocks" in docs.columns and "tags" in docs.columns:
        tags = F.coalesce(docs["tags"].cast(TAGS_TYPE), tags)
        tags = F.when(crossing(tags), F.raise_error(F.lit("tags overlap: one must lie within the other"))).otherwise(tags)
    return docs.select("doc_id", blocks.alias("blocks"), tags.alias("tags"), *carried)


def discover_fields(docs: DataFrame, fields: Fields | None = None) -> Fields:
    """The given fields and those that documents have besides, in the order in which they first occur."""
    out = Fields(fields or ())
    if "tags" in docs.columns:
        found = blocked(docs).select("doc_id", F.posexplode("tags").alias("seq", "tag")).groupBy(F.col("tag.field").alias("field")).agg(F.min(F.struct("doc_id", "seq")).alias("first"))
        for row in found.filter("field IS NOT NULL").orderBy("first").collect():  # a row a field
            out.add(row["field"])
    return out


def _ids(fields: Fields, name: Column) -> Column:
    out = F.lit(None).cast("int")
    for f in fields:
        out = F.when(name == f.name, F.lit(f.id)).otherwise(out)
    return out


def map_markup(tokens: Column, tags: Column, fields: Fields) -> Column:
    """Tags over blocks as spans of positions, inclusive: array<struct<field, field_id, lower, upper>>; empty and repeated ones go."""

    def span(t: Column) -> Column:
        return F.struct(
            t["field"].alias("field"),
            _ids(fields, t["field"]).alias("field_id"),
            F.size(F.filter(tokens, lambda x: x["block"] < t["lower"])).alias("lower"),
            (F.size(F.filter(tokens, lambda x: x["block"] <= t["upper"])) - 1).alias("upper"),
        )

    return F.array_distinct(F.filter(F.transform(tags, span), lambda s: s["upper"] >= s["lower"]))


def images(docs: DataFrame, fields: Fields | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, tokens, n_words, markup; tags, which say where fields begin and end in blocks; and columns that are carried along."""
    fields = fields or Fields()
    b = blocked(docs, carried)
    whole = [f.name for f in fields if not f.break_words]
    b = b.withColumn("tokens", block_tokens(F.col("blocks"), F.col("tags"), whole))
    return b.select("doc_id", "tokens", F.size("tokens").alias("n_words"), map_markup(F.col("tokens"), F.col("tags"), fields).alias("markup"), "tags", *carried)


def tokenize(images: DataFrame) -> DataFrame:
    """A row a token: doc_id, pos, and what a token has."""
    return images.select("doc_id", F.posexplode("tokens").alias("pos", "token")).select("doc_id", "pos", "token.*")


def token_offsets(tokens: DataFrame) -> DataFrame:
    """Tokens with the characters that they begin at within their block, for texts whose blanks are single."""
    of = Window.partitionBy("doc_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    blank = F.col("left_space").cast("int")
    before = F.coalesce(F.sum(F.col("length") + blank).over(of), F.lit(0))
    return tokens.withColumn("offset", (before + blank).cast("int"))


def indexed(images: DataFrame, fields: Fields | None = None) -> DataFrame:
    """Tokens that are searched: all but those in fields that aren't indexed.

    A ``default_field`` that isn't indexed takes out what no field covers.
    """
    off = [f.name for f in fields or () if not f.index]
    if not off:
        return tokenize(images)
    rows = images.select("doc_id", "tags", F.posexplode("tokens").alias("pos", "token")).withColumn("field", F.coalesce(innermost(F.col("tags"), F.col("token.block")), F.lit("default_field")))
    return rows.filter(~F.col("field").isin(off)).select("doc_id", "pos", "token.*")


def _known(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(F.lower("word").alias("word"), "term", F.coalesce(F.try_element_at("forms", F.lit(1)), F.lit(PLAIN_FORM)).cast("int").alias("form"))


def terms(tokens: DataFrame, lexicon: DataFrame | None = None, guesses: DataFrame | None = None) -> DataFrame:
    """Terms of the tokens: doc_id, pos, term, form.

    ``lexicon`` (word, term, forms) gives the terms of the words that it has;
    any other word is its own term in lower case, and has those of
    ``guesses``, of the same shape, besides.
    """
    rows = tokens.select("doc_id", "pos", lower_term(F.col("text")).alias("word"))
    plain = F.lit(PLAIN_FORM)

    if lexicon is None:
        return rows.select("doc_id", "pos", F.col("word").alias("term"), plain.alias("form"))
    joined = rows.join(F.broadcast(_known(lexicon)), "word", "left")  # the size of a dictionary, not of the documents
    out = joined.select("doc_id", "pos", F.coalesce("term", "word").alias("term"), F.coalesce("form", plain).alias("form"))
    if guesses is not None:
        out = out.unionByName(joined.filter("term IS NULL").select("doc_id", "pos", "word").join(_known(guesses), "word").select("doc_id", "pos", "term", "form"))
    return out


def contents_mini(terms: DataFrame) -> DataFrame:
    """Which terms each document has."""
    return terms.select("doc_id", "term").distinct()


def contents_bm25(terms: DataFrame) -> DataFrame:
    """How often each document has each term."""
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def contents_rich(terms: DataFrame) -> DataFrame:
    """Where each document has each term, and in which forms: positions and forms belong together."""
    hits = F.array_sort(F.collect_set(F.struct("pos", "form")))
    rows = terms.groupBy("term", "doc_id").agg(hits.alias("hits"))
    return rows.select("term", "doc_id", F.size("hits").alias("tf"), F.col("hits.pos").alias("positions"), F.col("hits.form").alias("forms"))


POSTINGS = "term string, doc_id bigint, tf int, positions array<int>, forms array<int>"
#: So many tokens are grouped at a time: what a task's Python holds besides a batch of Arrow's.
GROUPED = 1 << 19


def parts_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows, (first, behind the last), of no more than ``most`` in all; a row that is larger is by itself."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, last
        first = last


def plain_postings(docs: DataFrame, columns: Sequence[str] = ("term", "doc_id", "tf", "positions", "forms")) -> DataFrame:
    """contents_rich of texts without fields, numbers and a dictionary: POSTINGS, or some of its columns.

    All tokens of a document are in its row, so they are grouped there, some
    documents at a time, and nothing is shuffled.  The rows of GROUPED tokens
    are a run by term and document.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, offsets = batch.column(0), batch.column(1).values, batch.column(1).offsets.to_numpy()
            for a, b in parts_of(np.diff(offsets), GROUPED):
                if offsets[a] < offsets[b]:
                    yield grouped(ids.slice(a, b - a), words.slice(offsets[a], offsets[b] - offsets[a]), np.diff(offsets[a : b + 1]))

    def grouped(ids: pa.Array, words: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        coded = words.dictionary_encode()
        terms = coded.dictionary.cast(pa.string())
        terms, rank = terms.take(by_term := pc.sort_indices(terms)), np.empty(len(terms), np.int64)
        rank[by_term.to_numpy()] = np.arange(len(terms))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        key = rank[coded.indices.to_numpy()] * len(sizes) + doc
        order = np.argsort(key, kind="stable")  # positions ascend
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = pa.array(np.append(starts, len(key)).astype(np.int32))
        code, doc = np.divmod(key[starts], len(sizes))
        made = {
            "term": lambda: terms.take(pa.array(code)),
            "doc_id": lambda: ids.take(pa.array(doc)),
            "tf": lambda: pa.array(np.diff(np.append(starts, len(key))).astype(np.int32)),
            "positions": lambda: pa.ListArray.from_arrays(ends, pa.array((order - np.repeat(np.cumsum(sizes) - sizes, sizes)[order]).astype(np.int32))),
            "forms": lambda: pa.ListArray.from_arrays(ends, pa.array(np.full(len(key), PLAIN_FORM, np.int32))),
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in columns], names=list(columns))

    words = F.transform(token_texts(docs["text"]), lower_term)
    kinds = dict(x.strip().split(" ") for x in POSTINGS.split(","))
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), words.alias("words")).mapInArrow(group, ", ".join(f"{c} {kinds[c]}" for c in columns))


def distinct_ids(docs: DataFrame) -> bool:
    """Whether no two rows have the same doc_id; of the documents only the ids are read."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def lexicon_postings(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """plain_postings with a dictionary, which goes to every task.

    Only the postings of its words and terms are brought together in a
    shuffle, a row for a word of a document; all others stay where they are.
    """
    words = _known(lexicon)
    bare = lexicon.filter("term IS NOT NULL").select(F.col("term").alias("word")).distinct().join(F.broadcast(words), "word", "left_anti")
    known = F.broadcast(words.unionByName(bare, allowMissingColumns=True).withColumnsRenamed({"term": "known", "form": "other"}))
    rows = plain_postings(docs).withColumnRenamed("term", "word")
    form = F.coalesce("other", F.lit(PLAIN_FORM))
    met = rows.join(known, "word").select(F.coalesce("known", "word").alias("term"), "doc_id", F.transform("positions", lambda p: F.struct(p.alias("pos"), form.alias("form"))).alias("hits"))
    met = met.groupBy("term", "doc_id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    before = F.concat(F.array(F.lit(None).cast("struct<pos: int, form: int>")), F.col("hits"))
    once = F.filter(F.arrays_zip(F.col("hits").alias("h"), before.alias("b")), lambda x: x["h"].isNotNull() & ~x["h"].eqNullSafe(x["b"]))
    met = met.select("term", "doc_id", F.transform(once, lambda x: x["h"]).alias("hits")).sortWithinPartitions("term", "doc_id")
    met = met.select("term", "doc_id", F.size("hits").alias("tf"), F.col("hits.pos").alias("positions"), F.col("hits.form").alias("forms"))
    return rows.join(known, "word", "left_anti").withColumnRenamed("word", "term").select(*met.columns).unionByName(met)


def is_plain(docs: DataFrame, fields: Fields | None = None) -> bool:
    """Whether documents are texts all of which is searched."""
    return "blocks" not in docs.columns and all(f.index for f in fields or ())


def postings(docs: DataFrame, fields: Fields | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Where each document has each term, of what is indexed: POSTINGS."""
    if is_plain(docs, fields):
        return plain_postings(docs) if lexicon is None else lexicon_postings(docs, lexicon)
    return contents_rich(terms(indexed(images(docs, fields), fields), lexicon))


def lengths(docs: DataFrame, fields: Fields | None = None) -> DataFrame:
    """doc_id, n_words and markup of each document."""
    if "blocks" in docs.columns:
        return images(docs, fields).select("doc_id", "n_words", "markup")
    nothing = F.array().cast("array<struct<field: string, field_id: int, lower: int, upper: int>>")
    return docs.select("doc_id", F.size(token_texts(docs["text"])).alias("n_words"), nothing.alias("markup"))


def numbers(docs: DataFrame) -> DataFrame:
    """The number blocks of documents by value, in order: number, doc_id, tf, positions. Stored so, a range of numbers is a range of rows."""
    rows = tokenize(images(docs)).filter("number IS NOT NULL")
    return rows.groupBy("number", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions")).select("number", "doc_id", F.size("positions").alias("tf"), "positions")


def key_stats(postings: DataFrame) -> DataFrame:
    """Number of documents of every term."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def field_at(images: DataFrame, fields: Fields) -> DataFrame:
    """Field of every position: the innermost that covers it, 0 where none does."""
    covering = F.filter("markup", lambda m: (m["lower"] <= F.col("pos")) & (m["upper"] >= F.col("pos")))
    rows = images.select("doc_id", "markup", F.posexplode("tokens").alias("pos", "token"))
    return rows.select("doc_id", "pos", F.coalesce(F.when(F.size(covering) > 0, F.element_at(covering, -1)["field_id"]), F.lit(0)).alias("field_id"))
