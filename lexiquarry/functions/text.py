"""Tokenising and matching as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.parser import glob_prefix, glob_regex

#: Blanks, as in a class of a regular expression: those of ASCII, its separators, and the ones that Unicode adds, such as the no-break space.
BLANK = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
#: A punctuation mark or symbol is a token by itself; so is any run of other characters that aren't blanks.
TOKEN = rf"[\p{{P}}\p{{S}}]|[^{BLANK}\p{{P}}\p{{S}}]+"
_SPACED = rf"[{BLANK}]*({TOKEN})"

TOKEN_TYPE = "struct<text: string, number: double, block: int, length: int, left_space: boolean, is_punct: boolean, is_first: boolean>"
BLOCKS_TYPE = "array<struct<text: string, number: double>>"
TAGS_TYPE = "array<struct<field: string, lower: int, upper: int>>"


def token_texts(text: Column) -> Column:
    """The tokens of a text, in order; none for a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def spaced_texts(text: Column) -> Column:
    """The tokens of a text with the blanks before them."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_SPACED), F.lit(0)), F.array().cast("array<string>"))


def lower_term(text: Column) -> Column:
    """The term of a word without a dictionary."""
    return F.lower(text)


def number_text(number: Column) -> Column:
    """How a number block reads, and is searched as a word."""
    return F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))


def innermost(tags: Column, block: Column) -> Column:
    """Field of the innermost tag around a block; tags come outermost first."""
    around = F.filter(tags, lambda t: (t["lower"] <= block) & (t["upper"] >= block))
    return F.when(F.size(around) > 0, F.element_at(around, -1)["field"])


def block_tokens(blocks: Column, tags: Column | None = None, unbroken: Iterable[str] = ()) -> Column:
    """The tokens of a document's blocks, array<TOKEN_TYPE>; a token's place in it is its position.

    A number is a token; a block in a field of ``unbroken`` is one token; any
    other is divided at blanks and around punctuation marks and symbols.
    """
    unbroken = list(unbroken)

    def of_block(block: Column, number: Column) -> Column:
        text = block["text"]
        whole = spaced_texts(text)
        broken = F.transform(
            F.arrays_zip(token_texts(text).alias("t"), whole.alias("w")),
            lambda x, i: F.struct(
                x["t"].alias("text"), F.lit(None).cast("double").alias("number"), number.cast("int").alias("block"), F.length(x["t"]).alias("length"),
                (F.length(x["w"]) > F.length(x["t"])).alias("left_space"), x["t"].rlike(r"^[\p{P}\p{S}]").alias("is_punct"), (i == 0).alias("is_first"),
            ),
        )

        def single(shown: Column, value: Column) -> Column:
            return F.array(F.struct(shown.alias("text"), value.cast("double").alias("number"), number.cast("int").alias("block"), F.length(shown).alias("length"), F.lit(False).alias("left_space"), F.lit(False).alias("is_punct"), F.lit(True).alias("is_first")))

        out = broken
        if unbroken and tags is not None:
            kept = F.trim(text)
            out = F.when(F.coalesce(innermost(tags, number).isin(unbroken), F.lit(False)) & (F.length(kept) > 0), single(kept, F.lit(None))).otherwise(broken)
        return F.when(block["number"].isNotNull(), single(number_text(block["number"]), block["number"])).otherwise(out).cast(f"array<{TOKEN_TYPE}>")

    return F.flatten(F.transform(blocks, of_block))


def strmatch(text: Column, pattern: str) -> Column:
    """Whether a text matches a glob: ``*`` is any characters, ``?`` one."""
    prefix = glob_prefix(pattern)
    if prefix == pattern:
        return text == pattern
    found = text.rlike(glob_regex(pattern))
    return text.startswith(prefix) & found if prefix else found


def crossing(tags: Column) -> Column:
    """Whether two tags over blocks overlap without one lying within the other."""
    return F.exists(tags, lambda a: F.exists(tags, lambda b: (a["lower"] < b["lower"]) & (b["lower"] <= a["upper"]) & (a["upper"] < b["upper"])))


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]
#: What is no text in a page, and what then ends a block or merely is a tag.
PAGE = [(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>", " "), (r"(?is)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|body|html)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", "")]
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"


def unescaped(html: Column) -> Column:
    for entity, char in _ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and its head, blocks in lines."""
    for pattern, by in PAGE:
        html = F.regexp_replace(html, pattern, by)
    return unescaped(html)


def page_title(html: Column) -> Column:
    return unescaped(F.regexp_extract(html, TITLE, 1))
