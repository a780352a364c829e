"""Snippets and highlighted texts of what a rich query found."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fields import Fields
from ..functions import kernels
from ..functions.text import spaced_texts, token_texts
from . import analysis
from .search import Corpus

OPENING, CLOSING = "\x07", "\x08"
BLOCKS = "array<struct<tags: array<string>, text: string>>"


def _path(tags: list[tuple[str, int, int]], index: int, position: int) -> list[str]:
    """Names of the tags around a position, outermost first."""
    return [t[0] for t in tags if t[1] <= position <= t[2]]


def _hits(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.flatten(F.transform(F.coalesce("entries", F.array()), lambda e: e["points"])).alias("points"))


def _with_images(found: DataFrame, images: DataFrame | Corpus, how: str) -> DataFrame:
    """Documents with their tokens and the points of their hits. Of a corpus the texts meet the hits, before they are divided into tokens."""
    hits = _hits(found)
    if isinstance(images, DataFrame):
        rows = images.select("doc_id", "tokens", "markup").join(hits, "doc_id", how)
    else:
        rows = analysis.images(images.docs.join(hits, "doc_id", how), images.fields, ["points"])
    return rows.select("doc_id", "tokens", "markup", F.coalesce("points", F.array()).alias("points"))


def _shown(rows: DataFrame):
    """What the tokens of a document look like, as two flat arrays, its tags, and its hits with the numbers of their words."""

    def bit(c, n: int):
        return F.when(c, n).otherwise(0)

    kinds = F.transform("tokens", lambda t: (bit(t["left_space"], kernels.SPACED) + bit(t["is_first"], kernels.FIRST) + bit(t["number"].isNotNull(), kernels.NUMBER) + bit(t["is_punct"] & t["text"].isin(sorted(kernels.BREAKS)), kernels.BREAK)).cast("int"))
    return F.transform("tokens", lambda t: t["text"]), kinds, F.col("markup"), F.transform("points", lambda p: p["offset"]), F.transform("points", lambda p: p["term"])


def _blocks(show: Callable, texts: pa.Array, kinds: pa.Array, markup: pa.Array, places: pa.Array, words: pa.Array) -> pa.Array:
    """BLOCKS of what ``show`` makes of a document's tokens, their kinds, its tags and its marks: (names of tags, text). One document at a time is in Python's objects."""
    sizes, depths, names, shown = [], [], [], []
    for k in range(len(texts)):
        tags = [(m["field"], m["lower"], m["upper"]) for m in markup[k].as_py()]
        at, of = places[k].as_py(), words[k].as_py()
        blocks = show(texts[k].as_py(), kinds[k].as_py(), tags, dict(zip(reversed(at), reversed(of))))
        sizes.append(len(blocks))
        for path, text in blocks:
            depths.append(len(path))
            names += path
            shown.append(text)
    ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(np.array(x, np.int32))]).astype(np.int32))
    values = pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends(depths), pa.array(names, pa.string())), pa.array(shown, pa.string())], ["tags", "text"])
    return pa.ListArray.from_arrays(ends(sizes), values)


def snippet(found: DataFrame, images: DataFrame, fields: Fields | None = None, opening: str = OPENING, closing: str = CLOSING, indents: tuple | None = None, all_documents: bool = False) -> DataFrame:
    """doc_id and blocks of text around the hits, each with the fields that it lies in.

    ``found`` has doc_id and entries.  Around each hit as many words are
    shown as the field's indents say, up to a breaking mark; ``…`` stands
    where a text is cut.  Fields with quote 'always' are shown whole, those
    with 'never' not at all.  ``%u`` in a mark is the number of the query's
    word.  ``indents`` are for texts without a field of their own settings;
    with all_documents, those without hits are shown as well.
    """
    known = fields or Fields()

    def settings(name: str):
        f = known.options_of(name)
        if indents is not None and known.get(name) is None and known.get("default_field") is None:
            return f.quote, indents
        return f.quote, f.indents

    def show(texts: list, kinds: list, tags: list, marks: dict) -> list[tuple[list[str], str]]:
        windows = kernels.windows([bool(x & kernels.BREAK) for x in kinds], list(marks), tags, settings)
        return [(_path(tags, tag, a), x) for a, b, before, behind, tag in windows for x in kernels.render(texts, kinds, a, b, before, behind, marks, opening, closing)]

    @F.arrow_udf(BLOCKS)
    def quote(texts: pa.Array, kinds: pa.Array, markup: pa.Array, places: pa.Array, words: pa.Array) -> pa.Array:
        return _blocks(show, texts, kinds, markup, places, words)

    rows = _with_images(found, images, "left" if all_documents else "inner")
    return rows.select("doc_id", quote(*_shown(rows)).alias("blocks"))


def highlight(found: DataFrame, images: DataFrame, opening: str = OPENING, closing: str = CLOSING, all_documents: bool = False) -> DataFrame:
    """doc_id and the whole text in blocks, with marks around the hits."""

    def show(texts: list, kinds: list, tags: list, marks: dict) -> list[tuple[list[str], str]]:
        return [(_path(tags, tag, a), x) for a, b, tag in kernels.regions(len(texts), tags) for x in kernels.render(texts, kinds, a, b, False, False, marks, opening, closing)]

    @F.arrow_udf(BLOCKS)
    def source(texts: pa.Array, kinds: pa.Array, markup: pa.Array, places: pa.Array, words: pa.Array) -> pa.Array:
        return _blocks(show, texts, kinds, markup, places, words)

    rows = _with_images(found, images, "left" if all_documents else "inner")
    return rows.select("doc_id", source(*_shown(rows)).alias("blocks"))


def highlight_plain(found: DataFrame, images: DataFrame | Corpus, opening: str = "[", closing: str = "]") -> DataFrame:
    """As highlight, for texts without fields and numbers, in one string: doc_id, text. The tokens of a batch are marked and joined at once."""

    @F.arrow_udf("string")
    def marked(texts: pa.Array, wide: pa.Array, at: pa.Array) -> pa.Array:
        starts, hits, behind = texts.offsets.to_numpy(), at.offsets.to_numpy(), wide.offsets.to_numpy()
        out = []
        for a, b in analysis.parts_of(np.diff(starts), analysis.GROUPED):
            first, size = int(starts[a]), int(starts[b] - starts[a])
            n, many = np.diff(starts[a : b + 1]), np.diff(hits[a : b + 1])
            place = at.values.slice(hits[a], hits[b] - hits[a]).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.zeros(size, bool)
            hit[(np.repeat(starts[a:b] - first, many) + place)[(place >= 0) & (place < np.repeat(n, many))]] = True
            hit, text = pa.array(hit), texts.values.slice(first, size)
            spaced = pc.greater(pc.binary_length(wide.values.slice(behind[a], size)), pc.binary_length(text))
            shown = pc.binary_join_element_wise(pc.if_else(spaced, " ", ""), pc.if_else(hit, opening, ""), text, pc.if_else(hit, closing, ""), "")
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array((starts[a : b + 1] - first).astype(np.int32)), shown), ""))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    if isinstance(images, DataFrame) or not analysis.is_plain(images.docs):
        rows = _with_images(found, images, "inner")
        texts, wide = F.transform("tokens", lambda t: t["text"]), F.transform("tokens", lambda t: F.concat(F.when(t["left_space"], " ").otherwise(""), t["text"]))
    else:
        rows = images.docs.join(_hits(found), "doc_id")
        texts, wide = token_texts(rows["text"]), spaced_texts(rows["text"])
    return rows.select("doc_id", marked(texts, wide, F.transform("points", lambda p: p["offset"])).alias("text"))
