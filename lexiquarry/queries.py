"""A query for each operator of the search engine, over whole tables, and its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fields import Field, Fields
from .functions.text import BLANK, PAGE, TITLE, TOKEN, page_text, page_title
from .operators import analysis, search, snippets
from .sources.index import Index
from .sources.shared import shared_dir

#: Word and the term that stands for it in the queries with a dictionary.
LEXICON = [("the", "article", [1]), ("a", "article", [2]), ("an", "article", [2])]
_KEPT: dict[tuple, object] = {}


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", "text")


def _kept(spark: SparkSession, sf: str, name: str, make):
    """What is built once in a session for the tables of a folder: queries are asked of an index, not of texts."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _stored(spark: SparkSession, sf: str, name: str, make) -> search.Corpus:
    def write() -> search.Corpus:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        return make().stored(path)

    return _kept(spark, sf, name, write)


def _corpus(spark: SparkSession, sf: str) -> search.Corpus:
    return _stored(spark, sf, "documents", lambda: search.Corpus.of(_docs(spark, sf)))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.images(_docs(spark, sf))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.terms(analysis.tokenize(_images(spark, sf)))


def _grouped(spark: SparkSession, sf: str, by_shuffle, *columns: str) -> DataFrame:
    """Contents of the documents, grouped in their rows; where rows have a doc_id in common, in a shuffle."""
    docs = _docs(spark, sf)
    return analysis.plain_postings(docs, columns) if analysis.distinct_ids(docs) else by_shuffle(_terms(spark, sf))


def _dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, term string, forms array<int>")


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    """A document a conversation, a block a turn, under a field for its role."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    rows = _read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(turns)
    block = F.transform("turns", lambda t: F.struct(t["text"].alias("text"), F.lit(None).cast("double").alias("number")))
    tag = F.transform("turns", lambda t, i: F.struct(t["role"].alias("field"), i.alias("lower"), i.alias("upper")))
    return rows.select("doc_id", block.alias("blocks"), tag.alias("tags"))


def _talk(spark: SparkSession, sf: str) -> search.Corpus:
    return _stored(spark, sf, "conversations", lambda: search.Corpus.of(_conversations(spark, sf), Fields([Field(0, "system"), Field(1, "user"), Field(2, "assistant")])))


def _mini(query: str, lexicon: bool = False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        corpus = _stored(spark, sf, "lexicon", lambda: search.Corpus.of(_docs(spark, sf), lexicon=_dictionary(spark))) if lexicon else _corpus(spark, sf)
        total = F.aggregate("factors", F.lit(0.0), lambda acc, x: acc + x["idf"])
        return search.mini(corpus, query).select("doc_id", "n_words", F.size("factors").alias("factors"), F.round(total, 6).alias("idf"))

    return run


def _rich(query: str, corpus=_corpus):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = search.tuples(search.rich(corpus(spark, sf), query))
        return found.select("doc_id", "lower", "upper", F.round("weight", 6).alias("weight"))

    return run


def _stat(name: str, query: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        stats = search.rank_terms(_corpus(spark, sf), query)
        return spark.createDataFrame(sorted(stats.ranges.items()), "word string, weight double").withColumn("weight", F.round("weight", 6))

    return run


def _built(spark: SparkSession, sf: str) -> Index:
    """documents, as entities with their sources as extras."""
    out = Index.temporary(spark)
    out.upsert(_entities(spark, sf))
    return out


def _index(spark: SparkSession, sf: str) -> Index:
    return _kept(spark, sf, "index", lambda: _built(spark, sf))


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("entity_id"), "text", F.col("source").alias("extra"), "lang")


def _changed(spark: SparkSession, sf: str) -> Index:
    """After an upsert of the English ones, a deletion of the German ones and a patch of the French ones and of deleted ones."""

    def change() -> Index:
        out, rows = _index(spark, sf).fork(), _entities(spark, sf)
        out.upsert(rows.filter("lang = 'en'").withColumn("extra", F.lit("again")).withColumn("text", F.concat("text", F.lit(" amended"))))
        out.delete(rows.filter("lang = 'de'"))
        out.set_extras(rows.filter("lang IN ('fr', 'de')").select("entity_id", F.lit("patched").alias("extra")))
        return out

    return _kept(spark, sf, "changed", change)


def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    out = _index(spark, sf).fork()
    out.upsert(_entities(spark, sf).filter("lang = 'en'").withColumn("extra", F.lit("again")))
    return out.entities().select("entity_id", "version", "extra")


def _delete(spark: SparkSession, sf: str) -> DataFrame:
    out = _index(spark, sf).fork()
    gone = _entities(spark, sf).filter("lang = 'de'")
    out.delete(gone)
    return out.delete(gone.unionByName(_entities(spark, sf).filter("lang = 'en'")))


def _set_extras(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf).entities().select("entity_id", "extra")


def _merge(spark: SparkSession, sf: str) -> DataFrame:
    out = _changed(spark, sf).fork()
    out.merge()
    return out.key_stats()


def _merged_search(spark: SparkSession, sf: str) -> DataFrame:
    out = _changed(spark, sf)
    entities = out.entities().select("doc_id", "entity_id")
    return search.mini(out.corpus(), "the & of").join(entities, "doc_id").select("entity_id", "n_words")


def _check(spark: SparkSession, sf: str) -> DataFrame:
    """An index of which a segment lost the entities of the German documents: the terms of its postings that belong to none."""
    out = _index(spark, sf).fork()

    def lose(manifest) -> None:
        segment = dict(manifest.segments[0])
        at = f"{out.path}/damaged"
        for name in ("postings", "entities"):
            rows = spark.read.parquet(f"{segment['path']}/{name}")
            if name == "entities":
                rows = rows.join(_entities(spark, sf).filter("lang = 'de'"), "entity_id", "left_anti")
            rows.write.mode("overwrite").parquet(f"{at}/{name}")
        manifest.segments = [segment | {"path": at}]

    out._commit(lose)
    return out.check().groupBy("term").agg(F.count("*").alias("postings"))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark in ten additions, each again with half of the one before, in as many segments as the policy leaves."""
    out = Index.temporary(spark)
    rows = _read(spark, sf, "benchmark").select(F.format_string("item-%012d", "item_id").alias("entity_id"), "text", (F.col("item_id") % 10).alias("tenth"), (F.col("item_id") % 20).alias("half"))
    for k in range(10):
        out.upsert(rows.filter((F.col("tenth") == k) | (F.col("half") == (k + 9) % 10)).select("entity_id", "text"))
    out.compact(3)
    assert len(out.manifest().segments) == 3
    return out.key_stats()


def _bulletin(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf).bulletin().select("documents", "keys", "links", F.size("sources").alias("sources"))


def _by_index(spark: SparkSession, sf: str) -> DataFrame:
    """The entities that the first and the last index and one beyond it have."""
    index = _index(spark, sf)
    top = index.max_index()
    found = index.get_entity(index=0).unionByName(index.get_entity(index=top)).unionByName(index.get_entity(index=top + 1))
    return found.agg(F.count("*").alias("found"), F.countDistinct("entity_id").alias("entities"))


def _seek(spark: SparkSession, sf: str) -> DataFrame:
    """A term's postings from a document on."""
    return _corpus(spark, sf).postings.filter("term = 'of' AND doc_id >= 100").select("doc_id", "tf").orderBy("doc_id")


def _bounded(spark: SparkSession, sf: str) -> DataFrame:
    """A query over the documents 100 to 299 of the whole collection, with its weights."""
    corpus = _corpus(spark, sf)
    stats = search.rank_terms(corpus, '"of the"')
    found = search.tuples(search.rich(search.within(corpus, 100, 299), '"of the"', stats))
    return found.select("doc_id", "lower", "upper", F.round("weight", 6).alias("weight"))


def _rich_scores(spark: SparkSession, sf: str) -> DataFrame:
    return search.rich_search(_corpus(spark, sf), '"of the" | in').select("doc_id", F.round("score", 6).alias("score"))


def _number_range(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array(F.struct(F.lit(None).cast("string").alias("text"), F.col("o_totalprice").cast("double").alias("number"))).alias("blocks"))
    return search.number_range(analysis.numbers(docs), 1000, 50000).select("doc_id", "tf", F.round("least", 4).alias("least"))


def _order_fields(spark: SparkSession, sf: str) -> search.Corpus:
    """Orders with their statuses, a word each, and their priorities, of several words, as fields."""
    text = lambda c: F.struct(F.col(c).alias("text"), F.lit(None).cast("double").alias("number"))
    tag = lambda name, k: F.struct(F.lit(name).alias("field"), F.lit(k).alias("lower"), F.lit(k).alias("upper"))
    docs = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array(text("o_orderstatus"), text("o_orderpriority")).alias("blocks"), F.array(tag("status", 0), tag("priority", 1)).alias("tags"))
    return _stored(spark, sf, "orders", lambda: search.Corpus.of(docs))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and texts of pages as fields of documents."""
    text = lambda c: F.struct(c.alias("text"), F.lit(None).cast("double").alias("number"))
    tag = lambda name, k: F.struct(F.lit(name).alias("field"), F.lit(k).alias("lower"), F.lit(k).alias("upper"))
    return _read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.array(text(page_title(F.col("html"))), text(page_text(F.col("html")))).alias("blocks"), F.array(tag("title", 0), tag("body", 1)).alias("tags"))


def _page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a word in their titles."""
    corpus = _stored(spark, sf, "pages", lambda: search.Corpus.of(_pages(spark, sf)))
    return search.rich(corpus, "cover(title, the | that)").select("doc_id", F.size("entries").alias("hits"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of events as texts."""
    return _read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).stats().select("entity_id", "version", "extra_length", "bundle_length")


def _unbroken(spark: SparkSession, sf: str) -> DataFrame:
    fields = Fields([Field(0, "system"), Field(1, "user", break_words=False), Field(2, "assistant")])
    return analysis.images(_conversations(spark, sf), fields).select("doc_id", "n_words")


def _unindexed(spark: SparkSession, sf: str) -> DataFrame:
    fields = Fields([Field(0, "system"), Field(1, "user", index=False), Field(2, "assistant")])
    images = analysis.images(_conversations(spark, sf), fields)
    return analysis.contents_bm25(analysis.terms(analysis.indexed(images, fields)))


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of orders as number blocks, found as words."""
    blocks = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.floor("o_totalprice").cast("double").alias("number")), F.struct(F.col("o_orderpriority").alias("text"), F.lit(None).cast("double").alias("number")))
    docs = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), blocks.alias("blocks"))
    return analysis.contents_mini(analysis.terms(analysis.tokenize(analysis.images(docs))))


def _snippet(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _corpus(spark, sf)
    found = search.rich(corpus, "the & of")
    rows = snippets.snippet(found, corpus, opening="[", closing="]")
    return rows.select("doc_id", F.array_join(F.transform("blocks", lambda b: b["text"]), " / ").alias("snippet"))


def _highlight(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _corpus(spark, sf)
    found = search.rich(corpus, "the")
    return snippets.highlight_plain(found, corpus)


QUERIES = {
    "tokenize": lambda s, d: analysis.tokenize(_images(s, d)).select("doc_id", "pos", "text", "left_space", "is_punct"),
    "lowercase_term": lambda s, d: _terms(s, d).select("doc_id", "pos", "term"),
    "lemmatize_term": lambda s, d: analysis.terms(analysis.tokenize(_images(s, d)), _dictionary(s)),
    "numeric_term": _numbers,
    "no_break_fields": _unbroken,
    "no_index_fields": _unindexed,
    "markup_map": lambda s, d: _talk(s, d).images.select("doc_id", F.explode("markup").alias("m")).select("doc_id", "m.field_id", "m.lower", "m.upper"),
    "field_at_pos": lambda s, d: analysis.field_at(_talk(s, d).images, _talk(s, d).fields),
    "doc_length": lambda s, d: analysis.lengths(_docs(s, d)).select("doc_id", "n_words"),
    "contents_mini": lambda s, d: _grouped(s, d, analysis.contents_mini, "doc_id", "term"),
    "contents_bm25": lambda s, d: _grouped(s, d, analysis.contents_bm25, "doc_id", "term", "tf").withColumn("tf", F.col("tf").cast("bigint")),
    "build_index": lambda s, d: _built(s, d).bulletin().select("documents", "keys", "links"),
    "contents_rich": lambda s, d: analysis.plain_postings(_docs(s, d), ("doc_id", "term", "tf", "positions")).withColumn("positions", F.array_join("positions", " ")),
    "key_stats": lambda s, d: _corpus(s, d).key_stats,
    "key_block": lambda s, d: _corpus(s, d).postings.filter("term = 'the'").select("doc_id", "tf"),
    "list_keys": lambda s, d: _corpus(s, d).key_stats.filter(search.strmatch(F.col("term"), "th?n*")).orderBy("term"),
    "collection_size": lambda s, d: _corpus(s, d).lengths.agg(F.count("*").alias("documents")),
    "term_idf": lambda s, d: _corpus(s, d).key_stats.select("term", F.round(search.idf_column(F.col("df"), F.lit(_corpus(s, d).size)), 6).alias("idf")),
    "rank_word": _stat("rank_word", "the of in"),
    "rank_wildcard": _stat("rank_wildcard", "th?n*"),
    "mini_term": _mini("the"),
    "mini_multiterm": _mini("a", lexicon=True),
    "mini_and": _mini("the & of & in"),
    "mini_or": _mini("the | of"),
    "mini_fuzzy": _mini("the of thon"),
    "mini_wildcard": _mini("th?n*"),
    "bm25": lambda s, d: search.bm25_search(_corpus(s, d), "the & of").select("doc_id", F.round("score", 6).alias("score")),
    "bm25_counts": lambda s, d: search.bm25_search(_corpus(s, d), "the | of", real_counts=True).select("doc_id", F.round("score", 6).alias("score")),
    "bm25_top": lambda s, d: search.bm25_search(_corpus(s, d), "the | of", k=20).select("doc_id", F.round("score", 6).alias("score")),
    "rich_term": _rich("the"),
    "rich_or": _rich("the | of"),
    "rich_quote": _rich('"of the"'),
    "rich_order": _rich("'in the of'"),
    "rich_not": _rich("the ! of"),
    "rich_and": _rich("the & of"),
    "rich_fuzzy": _rich("the of in"),
    "rich_wildcard": _rich("th?n"),
    "rich_context": _rich("ctx(2, 'of the in' | 'of the' | the)"),
    "rich_cover": _rich("cover(assistant, the)", _talk),
    "rich_match": _rich("match(status, f) | match(priority, urgent)", _order_fields),
    "snippet": _snippet,
    "highlight": _highlight,
    "entities_by_index": lambda s, d: _index(s, d).entities_by_index().select("entity_id", "extra"),
    "entities_by_id": lambda s, d: _index(s, d).entities_by_id("doc-000000000100").select("entity_id", "extra"),
    "get_entity": lambda s, d: _changed(s, d).get_entity("doc-000000000007").select("entity_id", "extra"),
    "upsert": _upsert,
    "delete": _delete,
    "set_extras": _set_extras,
    "merge_segments": _merge,
    "search_layers": _merged_search,
    "index_check": _check,
    "index_stats": _stats,
    "index_bulletin": _bulletin,
    "entity_at_index": _by_index,
    "index_key_stats": lambda s, d: _changed(s, d).key_stats("the"),
    "index_list_keys": lambda s, d: _changed(s, d).list_keys("th?n*"),
    "index_key_block": lambda s, d: _index(s, d).key_block("the").join(_index(s, d).entities().select("doc_id", "entity_id"), "doc_id").select("entity_id", "tf"),
    "compact_segments": _batches,
    "posting_seek": _seek,
    "bounded_query": _bounded,
    "rich_scores": _rich_scores,
    "number_range": _number_range,
    "page_text": lambda s, d: _read(s, d, "pages").select("page_id", page_title(F.col("html")).alias("title"), page_text(F.col("html")).alias("text")),
    "page_titles": _page_titles,
    "event_terms": lambda s, d: analysis.key_stats(analysis.postings(_events(s, d))),
}

RX = TOKEN
_TOK = rf"""lists AS (SELECT doc_id, regexp_extract_all(text, '{RX}') AS l, regexp_extract_all(text, '[{BLANK}]*({RX})') AS w FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(l) AS text, unnest(w) AS wide, (generate_subscripts(l, 1) - 1)::INTEGER AS pos FROM lists),
len AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '{RX}')), 0)::INTEGER AS n_words FROM documents),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
post AS (SELECT doc_id, lower(text) AS term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT term, ln((1 + n) / df) / ln(1 + n) AS w FROM df, n)"""
_TALK = rf"""turns AS (SELECT conv_id AS doc_id, role, coalesce(regexp_extract_all(text, '{RX}'), []) AS l, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
begun AS (SELECT *, coalesce(sum(len(l)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS lower FROM turns),
tok AS (SELECT doc_id, role, unnest(l) AS text, (lower + generate_subscripts(l, 1) - 1)::INTEGER AS pos FROM begun),
n AS (SELECT count(DISTINCT conv_id)::DOUBLE AS n FROM conversations),
df AS (SELECT lower(text) AS term, count(DISTINCT doc_id) AS df FROM tok GROUP BY ALL),
w AS (SELECT term, ln((1 + n) / df) / ln(1 + n) AS w FROM df, n)"""
_FIELD = "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END"
_ENT = "ent AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 12, '0') AS entity_id, text, source, lang FROM documents)"


def _with(rest: str, head: str = _TOK) -> str:
    return f"WITH {head} {rest}"


def _mini_sql(words: list[str], having: str) -> str:
    some = ", ".join(f"'{x}'" for x in words)
    return _with(f"SELECT p.doc_id, n_words, count(*)::INTEGER AS factors, round(sum(w), 6) AS idf FROM post p JOIN w USING (term) JOIN len USING (doc_id) WHERE term IN ({some}) GROUP BY p.doc_id, n_words HAVING {having}")


_SCORE = "round(sum(w.w * ({occurs}::DOUBLE / n_words * 2.5) / ({occurs}::DOUBLE / n_words + 1.5 * (0.25 + 0.75 * n_words / 1000.0))), 6) AS score"


def _bm25_sql(occurs: str, having: str, tail: str = "") -> str:
    return _with(f"SELECT p.doc_id, {_SCORE.format(occurs=occurs)} FROM post p JOIN w USING (term) JOIN len USING (doc_id) WHERE term IN ('the', 'of') GROUP BY p.doc_id HAVING {having} {tail}")


def _phrase_sql(words: list[str]) -> str:
    tables = "tok t0" + "".join(f" JOIN tok t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.pos = t0.pos + {k}" for k in range(1, len(words)))
    where = " AND ".join(f"lower(t{k}.text) = '{x}'" for k, x in enumerate(words))
    rest = " * ".join(f"(1 - (SELECT w FROM w WHERE term = '{x}'))" for x in words)
    return _with(f"SELECT t0.doc_id, t0.pos AS lower, (t0.pos + {len(words) - 1})::INTEGER AS upper, round(1 - {rest}, 6) AS weight FROM {tables} WHERE {where}")


_ROW = "doc_id, pos AS lower, pos AS upper, round(w, 6) AS weight FROM tok JOIN w ON term = lower(text)"
_LIVE = _ENT + """, live AS (SELECT entity_id, CASE WHEN lang = 'en' THEN text || ' amended' ELSE text END AS text, CASE lang WHEN 'en' THEN 'again' WHEN 'fr' THEN 'patched' ELSE source END AS extra FROM ent WHERE lang IS DISTINCT FROM 'de')"""
_title_sql = f"regexp_extract(html, '{TITLE}', 1)"
_page_sql = "html"
for _pattern, _by in PAGE:
    _page_sql = f"regexp_replace({_page_sql}, '{_pattern}', {'chr(10)' if _by == chr(10) else repr(_by)}, 'g')"


def _unescape_sql(html: str) -> str:
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        html = f"replace({html}, '{entity}', {char})"
    return html


SQL = {
    "tokenize": _with(r"SELECT doc_id, pos, text, length(wide) > length(text) AS left_space, regexp_matches(text, '^[\p{P}\p{S}]') AS is_punct FROM tok"),
    "lowercase_term": _with("SELECT doc_id, pos, lower(text) AS term FROM tok"),
    "lemmatize_term": _with("SELECT doc_id, pos, CASE WHEN lower(text) IN ('the', 'a', 'an') THEN 'article' ELSE lower(text) END AS term, CASE WHEN lower(text) = 'the' THEN 1 WHEN lower(text) IN ('a', 'an') THEN 2 ELSE 255 END::INTEGER AS form FROM tok"),
    "numeric_term": f"SELECT o_orderkey AS doc_id, floor(o_totalprice)::BIGINT::VARCHAR AS term FROM orders WHERE o_totalprice IS NOT NULL UNION SELECT o_orderkey, lower(unnest(regexp_extract_all(o_orderpriority, '{RX}'))) FROM orders",
    "no_break_fields": _with("SELECT doc_id, sum(CASE WHEN role = 'user' THEN (length(trim(coalesce(text, ''))) > 0)::INTEGER ELSE len(l) END)::INTEGER AS n_words FROM begun GROUP BY doc_id", _TALK),
    "no_index_fields": _with("SELECT doc_id, lower(text) AS term, count(*) AS tf FROM tok WHERE role IS DISTINCT FROM 'user' GROUP BY ALL", _TALK),
    "markup_map": _with(f"SELECT DISTINCT doc_id, ({_FIELD})::INTEGER AS field_id, lower, (lower + len(l) - 1)::INTEGER AS upper FROM begun WHERE len(l) > 0", _TALK),
    "field_at_pos": _with(f"SELECT doc_id, pos, coalesce({_FIELD}, 0)::INTEGER AS field_id FROM tok", _TALK),
    "build_index": _with("SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS keys, count(*) AS links FROM post"),
    "doc_length": _with("SELECT doc_id, n_words FROM len"),
    "contents_mini": _with("SELECT doc_id, term FROM post"),
    "contents_bm25": _with("SELECT doc_id, term, tf FROM post"),
    "contents_rich": _with("SELECT doc_id, lower(text) AS term, count(*)::INTEGER AS tf, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY doc_id, lower(text)"),
    "key_stats": _with("SELECT term, df FROM df"),
    "key_block": _with("SELECT doc_id, tf::INTEGER AS tf FROM post WHERE term = 'the'"),
    "list_keys": _with("SELECT term, df FROM df WHERE term LIKE 'th_n%' ORDER BY term"),
    "collection_size": "SELECT count(*) AS documents FROM documents",
    "term_idf": _with("SELECT term, round(w, 6) AS idf FROM w"),
    "rank_word": _with("SELECT term AS word, round(w, 6) AS weight FROM w WHERE term IN ('the', 'of', 'in')"),
    "rank_wildcard": _with("SELECT '{th?n*}' AS word, round(ln((1 + n) / d) / ln(1 + n), 6) AS weight FROM (SELECT n, floor(0.001 + n * (1 - exp(sum(ln(1 - df / n))))) AS d FROM df, n WHERE term LIKE 'th_n%' GROUP BY n)"),
    "mini_term": _mini_sql(["the"], "true"),
    "mini_multiterm": _with("SELECT doc_id, n_words, 1::INTEGER AS factors, round(ln((1 + n) / (count(*) OVER ())) / ln(1 + n), 6) AS idf FROM (SELECT DISTINCT doc_id FROM post WHERE term IN ('the', 'a', 'an')) JOIN len USING (doc_id), n"),
    "mini_and": _mini_sql(["the", "of", "in"], "count(*) = 3"),
    "mini_or": _mini_sql(["the", "of"], "true"),
    "mini_fuzzy": _mini_sql(["the", "of", "thon"], "sum(w) >= 0.7 * (SELECT sum(w) FROM w WHERE term IN ('the', 'of', 'thon')) - 1e-12"),
    "mini_wildcard": _with("SELECT p.doc_id, n_words, 1::INTEGER AS factors, round(max(w), 6) AS idf FROM post p JOIN w USING (term) JOIN len USING (doc_id) WHERE term LIKE 'th_n%' GROUP BY p.doc_id, n_words"),
    "bm25": _bm25_sql("1", "count(*) = 2"),
    "bm25_counts": _bm25_sql("tf", "true"),
    "bm25_top": _bm25_sql("1", "true", "ORDER BY sum(w.w * (1::DOUBLE / n_words * 2.5) / (1::DOUBLE / n_words + 1.5 * (0.25 + 0.75 * n_words / 1000.0))) DESC, p.doc_id LIMIT 20"),
    "rich_term": _with(f"SELECT {_ROW} WHERE term = 'the'"),
    "rich_or": _with(f"SELECT {_ROW} WHERE term IN ('the', 'of')"),
    "rich_quote": _phrase_sql(["of", "the"]),
    "rich_order": _phrase_sql(["in", "the", "of"]),
    "rich_and": _with("SELECT doc_id, pos AS lower, upper, round(1 - (1 - (SELECT w FROM w WHERE term = 'the')) * (1 - (SELECT w FROM w WHERE term = 'of')), 6) AS weight FROM (SELECT doc_id, pos, min(pos) FILTER (lower(text) = 'of') OVER later AS next_of, min(pos) FILTER (lower(text) = 'the') OVER later AS next_the, CASE lower(text) WHEN 'the' THEN next_of ELSE next_the END AS upper FROM tok WHERE lower(text) IN ('the', 'of') WINDOW later AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE upper IS NOT NULL"),
    "rich_context": _phrase_sql(["of", "the"]) + " AND NOT EXISTS (SELECT 1 FROM tok t2 WHERE t2.doc_id = t0.doc_id AND t2.pos = t0.pos + 2 AND lower(t2.text) = 'in') UNION ALL SELECT " + _ROW + " WHERE term = 'the'",
    "rich_not": _with(f"SELECT {_ROW} WHERE term = 'the' AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'of')"),
    "rich_wildcard": _with(f"SELECT {_ROW} WHERE term LIKE 'th_n'"),
    "rich_cover": _with(f"SELECT {_ROW} WHERE term = 'the' AND role = 'assistant'", _TALK),
    "rich_match": "WITH n AS (SELECT count(*)::DOUBLE AS n FROM orders), d AS (SELECT count(*) AS df FROM orders WHERE lower(o_orderstatus) = 'f') SELECT o_orderkey AS doc_id, 0::INTEGER AS lower, 0::INTEGER AS upper, round(ln((1 + n) / df) / ln(1 + n), 6) AS weight FROM orders, n, d WHERE lower(o_orderstatus) = 'f'",
    "highlight": _with("SELECT doc_id, string_agg(CASE WHEN length(wide) > length(text) THEN ' ' ELSE '' END || CASE WHEN lower(text) = 'the' THEN '[' || text || ']' ELSE text END, '' ORDER BY pos) AS text FROM tok WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'the') GROUP BY doc_id"),
    "entities_by_index": _with("SELECT entity_id, source AS extra FROM ent", _ENT),
    "entities_by_id": _with("SELECT entity_id, source AS extra FROM ent WHERE entity_id >= 'doc-000000000100' ORDER BY entity_id", _ENT),
    "get_entity": _with("SELECT entity_id, extra FROM live WHERE entity_id = 'doc-000000000007'", _LIVE),
    "upsert": _with("SELECT entity_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN lang = 'en' THEN 'again' ELSE source END AS extra FROM ent", _ENT),
    "delete": _with("SELECT entity_id, lang = 'en' AS deleted FROM ent WHERE lang IN ('en', 'de')", _ENT),
    "set_extras": _with("SELECT entity_id, extra FROM live", _LIVE),
    "merge_segments": _with(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT entity_id, lower(unnest(regexp_extract_all(text, '{RX}'))) AS term FROM live) GROUP BY term", _LIVE),
    "search_layers": _with(f"SELECT entity_id, len(l)::INTEGER AS n_words FROM (SELECT entity_id, regexp_extract_all(text, '{RX}') AS l FROM live) WHERE list_contains(list_transform(l, lambda x: lower(x)), 'the') AND list_contains(list_transform(l, lambda x: lower(x)), 'of')", _LIVE),
    "index_check": _with("SELECT term, count(*) AS postings FROM post JOIN documents USING (doc_id) WHERE lang = 'de' GROUP BY term"),
    "index_bulletin": f"WITH p AS (SELECT 1 AS part, doc_id, lower(unnest(regexp_extract_all(text, '{RX}'))) AS term FROM documents UNION ALL SELECT 2, doc_id, lower(unnest(regexp_extract_all(text || ' amended', '{RX}'))) FROM documents WHERE lang = 'en'), d AS (SELECT part, count(DISTINCT term) AS keys, count(DISTINCT (doc_id, term)) AS links FROM p GROUP BY part) SELECT CASE part WHEN 1 THEN (SELECT count(*) FROM documents) ELSE (SELECT count(*) FROM documents WHERE lang = 'en') END AS documents, keys, links, 0::INTEGER AS sources FROM d",
    "entity_at_index": "SELECT 2::BIGINT AS found, 2::BIGINT AS entities",
    "index_key_stats": _with(f"SELECT 'the' AS term, count(*) AS df FROM live WHERE list_contains(list_transform(regexp_extract_all(text, '{RX}'), lambda x: lower(x)), 'the')", _LIVE),
    "index_list_keys": _with(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT entity_id, lower(unnest(regexp_extract_all(text, '{RX}'))) AS term FROM live) WHERE term LIKE 'th_n%' GROUP BY term", _LIVE),
    "index_key_block": _with("SELECT 'doc-' || lpad(doc_id::VARCHAR, 12, '0') AS entity_id, tf::INTEGER AS tf FROM post WHERE term = 'the'"),
    "compact_segments": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '{RX}'))) AS term FROM benchmark) GROUP BY term",
    "posting_seek": _with("SELECT doc_id, tf::INTEGER AS tf FROM post WHERE term = 'of' AND doc_id >= 100"),
    "bounded_query": _phrase_sql(["of", "the"]) + " AND t0.doc_id BETWEEN 100 AND 299",
    "rich_scores": _with("SELECT doc_id, round(max(weight), 6) AS score FROM (SELECT t0.doc_id, 1 - (1 - (SELECT w FROM w WHERE term = 'of')) * (1 - (SELECT w FROM w WHERE term = 'the')) AS weight FROM tok t0 JOIN tok t1 ON t1.doc_id = t0.doc_id AND t1.pos = t0.pos + 1 WHERE lower(t0.text) = 'of' AND lower(t1.text) = 'the' UNION ALL SELECT doc_id, w FROM tok JOIN w ON term = lower(text) WHERE term = 'in') GROUP BY doc_id"),
    "number_range": "SELECT o_orderkey AS doc_id, count(*)::INTEGER AS tf, round(min(o_totalprice), 4) AS least FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 GROUP BY o_orderkey",
    "page_text": f"SELECT page_id, {_unescape_sql(_title_sql)} AS title, {_unescape_sql(_page_sql)} AS text FROM pages",
    "page_titles": f"WITH t AS (SELECT page_id AS doc_id, lower(unnest(regexp_extract_all({_unescape_sql(_title_sql)}, '{RX}'))) AS term FROM pages) SELECT doc_id, count(*)::INTEGER AS hits FROM t WHERE term IN ('the', 'that') GROUP BY doc_id",
    "event_terms": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT event_id, lower(unnest(regexp_extract_all(props, '{RX}'))) AS term FROM events) GROUP BY term",
    "index_stats": _with("SELECT entity_id, 1::BIGINT AS version, coalesce(strlen(source), 0)::INTEGER AS extra_length, 0::INTEGER AS bundle_length FROM ent", _ENT),
}
