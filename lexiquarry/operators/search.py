"""Evaluation of queries over a corpus.

A query becomes one plan: the postings of its words are filtered (which
reaches the files, as postings are stored by term), brought together by
document in a single shuffle, and the tree is a boolean expression over what
each document has.  Only the two kinds of tuples that are sequential within a
document leave the JVM, and only for documents that match.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import Fields
from ..functions import kernels
from ..functions.ranking import AVERAGE, NUDGE, bm25, estimated_documents, idf as idf_column, idf_value, word_range
from ..functions.text import strmatch
from ..plans.parser import Node, operator, parse_query, words
from . import analysis

QUORUM = 0.7
#: Weight of a position in a field that the search isn't about.
ELSEWHERE = 0.2
ENTRY = "struct<lower: int, upper: int, weight: double, points: array<struct<offset: int, term: int>>>"
ENTRIES = f"array<{ENTRY}>"


@dataclass
class Corpus:
    """What queries run over: postings (term, doc_id, tf, positions, forms) and lengths (doc_id, n_words, markup).

    The documents themselves are read only where texts are shown.
    """

    postings: DataFrame
    docs: DataFrame
    lengths: DataFrame
    fields: Fields = field(default_factory=Fields)
    lexicon: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, fields: Fields | None = None, lexicon: DataFrame | None = None) -> Corpus:
        """Analyse documents, again for each query; ``stored`` does it once."""
        fields = analysis.discover_fields(docs, fields)
        return cls(analysis.postings(docs, fields, lexicon), docs, analysis.lengths(docs, fields), fields, lexicon)

    def stored(self, path: str) -> Corpus:
        """Write what queries read to a folder that all executors share."""
        read = self.postings.sparkSession.read
        write_postings(self.postings, path, analysis.is_plain(self.docs, self.fields))
        self.lengths.write.parquet(f"{path}/lengths")
        return Corpus(read.parquet(f"{path}/postings"), self.docs, read.parquet(f"{path}/lengths"), self.fields, self.lexicon)

    @property
    def images(self) -> DataFrame:
        return analysis.images(self.docs, self.fields)

    def images_of(self, found: DataFrame) -> DataFrame:
        """Images of the documents that a query found: no other text is divided into tokens."""
        return analysis.images(self.docs.join(found.select("doc_id"), "doc_id", "left_semi"), self.fields)

    @cached_property
    def size(self) -> int:
        return self.lengths.count()

    @cached_property
    def key_stats(self) -> DataFrame:
        return analysis.key_stats(self.postings)

    def doc_stats(self) -> DataFrame:
        return self.lengths.select("doc_id", "n_words")

    def terms_of(self, some: set[str]) -> dict[str, list[tuple[str, list[int]]]]:
        """Terms of words, with the forms that each word stands for."""
        out: dict[str, list[tuple[str, list[int]]]] = {w: [] for w in some}
        if self.lexicon is not None and some:
            rows = self.lexicon.withColumn("word", F.lower("word")).filter(F.col("word").isin([w.lower() for w in some])).select("word", "term", "forms").collect()  # of the query's words
            for w in some:
                out[w] = sorted((r["term"], list(r["forms"] or [])) for r in rows if r["word"] == w.lower())
        return {w: found or [(w.lower(), [])] for w, found in out.items()}


def write_postings(postings: DataFrame, at: str, in_runs: bool = False) -> None:
    """Postings by term and document within every file, or in long runs that are in this order; each is written once, without a shuffle.

    So a query's words reach few pages of every file, by the least and the
    greatest term of a page, and the most frequent ones are in many files.
    """
    (postings if in_runs else postings.sortWithinPartitions("term", "doc_id")).write.parquet(f"{at}/postings")


@dataclass
class Stats:
    """Number of documents and weights of a query's words; those of wildcards are under the pattern in braces."""

    size: int
    ranges: dict[str, float]
    terms: dict[str, list[tuple[str, list[int], float]]] = field(default_factory=dict)


def load_terms(query: str | Node) -> list[str]:
    """The words of a query, those of wildcards in braces."""
    return sorted(words(_tree(query)))


def rank_terms(corpus: Corpus, query: str | Node, external: dict[str, float] | None = None, size: int | None = None) -> Stats:
    """Weights of a query's words. ``external`` and ``size`` stand in for what a larger collection says.

    One aggregation over the postings of the query's words; what comes to the
    driver is a row a term of the query, and one a wildcard.
    """
    found = words(_tree(query))
    plain = {w for w in found if not _braced(w)}
    terms = corpus.terms_of(plain)
    size = corpus.size if size is None else size
    wanted = sorted({t for some in terms.values() for t, _ in some})
    df = {r["term"]: r["df"] for r in analysis.key_stats(corpus.postings.filter(F.col("term").isin(wanted))).collect()} if wanted else {}
    ranges = {w: word_range(estimated_documents([df[t] for t, _ in terms[w] if t in df], size), size) for w in plain}
    for w in found - plain:
        ranges[w] = word_range(wildcard_documents(corpus, w[1:-1], size), size)
    return Stats(size, ranges | (external or {}), {w: [(t, forms, idf_value(df.get(t, 0), size)) for t, forms in terms[w]] for w in plain})


def wildcard_documents(corpus: Corpus, pattern: str, size: int) -> int:
    """Documents that have a term of the pattern, as if the terms were independent."""
    n = F.lit(float(size))
    keys = analysis.key_stats(corpus.postings.filter(strmatch(F.col("term"), pattern.lower())))
    row = keys.agg(F.count("*").alias("keys"), F.max("df").alias("df"), F.sum(F.when(F.col("df") < n, F.log1p(-F.col("df") / n))).alias("s"), F.max((F.col("df") >= n).cast("int")).alias("full")).first()
    if row["keys"] < 2:
        return row["df"] or 0
    import math

    return size if row["full"] else int(NUDGE + size * (1 - math.exp(row["s"])))


def _braced(word: str) -> bool:
    return len(word) > 1 and word[0] == "{" and word[-1] == "}"


def _tree(query: str | Node) -> Node:
    return parse_query(query) if isinstance(query, str) else query


# ---------------------------------------------------------------- planning

@dataclass
class Plan:
    """A node that isn't empty. leaf: its number; strict: only the forms asked for count."""

    kind: str
    range: float
    parts: list[Plan] = field(default_factory=list)
    leaf: int = -1
    word: str = ""
    strict: bool = False
    detail: object = None


def simplify(node: Node, stats: Stats, rich: bool, leaves: list[Plan], strict: bool = False) -> Plan | None:
    """The plan of a tree, without what can't match; None if nothing can.

    An empty operand empties ``&&``, quote and order, and leaves ``||``, fuzzy
    and the excluded side of ``!``; a single operand stands for its node.
    """
    kind, argument = operator(node)
    if kind in ("word", "wildcard"):
        weight = stats.ranges.get("{" + argument + "}" if kind == "wildcard" else argument, 0.0)
        if weight <= (0.01 if kind == "wildcard" and rich else 0.0):
            return None
        leaves.append(Plan(kind, weight, leaf=len(leaves), word=argument, strict=strict or kind == "wildcard"))
        return leaves[-1]
    if kind in ("cover", "match", "limit"):
        inner = simplify(argument["query"], stats, rich, leaves, strict)
        if inner is None or not rich:
            return inner
        return Plan(kind, inner.range, [inner], detail=argument)
    if kind == "!" and not rich:
        raise ValueError("operator ! needs positions: use a rich query")
    parts = [simplify(x, stats, rich, leaves, strict or kind == "quote") for x in argument]
    present = [p for p in parts if p is not None]
    if kind in ("&&", "quote", "order"):
        if len(present) < len(parts) or not present:
            return None
        return present[0] if len(present) == 1 else Plan("&&" if kind == "&&" or not rich else "order", max(p.range for p in present), present)
    if kind == "!":
        if not parts or parts[0] is None:
            return None
        return present[0] if len(present) == 1 else Plan("!", present[0].range, present)
    if not present:
        return None
    if kind == "||":
        return present[0] if len(present) == 1 else Plan("||", min(1.0, *(p.range for p in present)), present)
    return Plan("fuzzy", QUORUM * sum(p.range for p in present), present)


def _quorum(plan: Plan, found: list[Column]) -> Column:
    total = sum(p.range for p in plan.parts)
    reached = sum((F.when(f, F.lit(p.range)).otherwise(0.0) for p, f in zip(plan.parts, found)), F.lit(0.0))
    return reached >= F.lit(QUORUM * total - 1e-12)


def _matches(plan: Plan, present) -> Column:
    """Whether a document has what a plan asks for, of which positions may still fall short."""
    if plan.leaf >= 0:
        return present(plan.leaf)
    found = [_matches(p, present) for p in plan.parts]
    if plan.kind in ("&&", "order"):
        out = found[0]
        for f in found[1:]:
            out = out & f
        return out
    if plan.kind == "||":
        out = found[0]
        for f in found[1:]:
            out = out | f
        return out
    if plan.kind == "fuzzy":
        return _quorum(plan, found)
    return found[0]


def _hits(corpus: Corpus, leaves: list[Plan], stats: Stats, columns: list[str]) -> DataFrame:
    """Postings of the leaves: doc_id, leaf, ord (the order of a leaf's terms), idf, wanted forms, and the columns asked for."""
    spark = corpus.postings.sparkSession
    rows = [(t, p.leaf, k, float(w), forms) for p in leaves if p.kind == "word" for k, (t, forms, w) in enumerate(stats.terms.get(p.word) or [(t, f, -1.0) for t, f in corpus.terms_of({p.word})[p.word]])]
    out = None
    kept = ["doc_id", "leaf", "ord", "idf", "wanted", *columns]
    if rows:
        asked = spark.createDataFrame(rows, "term string, leaf int, ord int, idf double, wanted array<int>")
        some = corpus.postings.filter(F.col("term").isin(sorted({r[0] for r in rows})))
        out = some.join(F.broadcast(asked), "term").select(*kept)  # the words of the query
    for p in leaves:
        if p.kind != "wildcard":
            continue
        some = corpus.postings.filter(strmatch(F.col("term"), p.word.lower()))
        n = F.lit(float(stats.size))
        idf = F.when(F.col("df") <= n, F.log((1 + n) / F.col("df")) / F.log(1 + n)).otherwise(-1.0)
        keyed = some.join(analysis.key_stats(some), "term").select("doc_id", F.lit(p.leaf).alias("leaf"), F.col("term").alias("ord"), idf.alias("idf"), F.array().cast("array<int>").alias("wanted"), *columns)
        keyed = keyed.withColumn("ord", F.lit(0)) if "positions" not in columns else keyed.withColumn("ord", F.pmod(F.xxhash64("ord"), F.lit(1 << 30)).cast("int"))
        out = keyed.select(*kept) if out is None else out.unionByName(keyed.select(*kept))
    return out


# ---------------------------------------------------------------- documents

def mini(corpus: Corpus, query: str | Node, stats: Stats | None = None) -> DataFrame:
    """Documents that match, whatever the positions: doc_id, n_words, factors (term_id, idf, occurs).

    A factor for each word that takes part: its idf is the greatest among its
    terms in the document, and occurs is 1.  quote and order are ``&&``;
    cover, match and limit are their queries; ``!`` raises ValueError.
    """
    node = _tree(query)
    operator(node)
    stats = stats or rank_terms(corpus, node)
    leaves: list[Plan] = []
    plan = simplify(node, stats, False, leaves)
    schema = "doc_id bigint, n_words int, factors array<struct<term_id: int, idf: double, occurs: int>>"
    if plan is None:
        return corpus.postings.sparkSession.createDataFrame([], schema)
    hits = _hits(corpus, leaves, stats, [])
    by_doc = hits.groupBy("doc_id").agg(*[F.max(F.when(F.col("leaf") == p.leaf, F.col("idf"))).alias(f"leaf_{p.leaf}") for p in leaves])

    def present(k: int) -> Column:
        return F.col(f"leaf_{k}").isNotNull()

    taking: dict[int, Column] = {}

    def mark(p: Plan, within: Column) -> None:
        here = within & _matches(p, present)
        if p.leaf >= 0:
            taking[p.leaf] = here
        for x in p.parts:
            mark(x, here)

    mark(plan, F.lit(True))
    factors = F.array_compact(F.array(*[F.when(taking[p.leaf], F.struct(F.lit(p.leaf).alias("term_id"), F.col(f"leaf_{p.leaf}").alias("idf"), F.lit(1).alias("occurs"))) for p in leaves if p.leaf in taking]))
    return by_doc.filter(_matches(plan, present)).select("doc_id", factors.alias("factors")).join(corpus.doc_stats(), "doc_id").select("doc_id", "n_words", "factors")


def bm25_search(corpus: Corpus, query: str | Node, stats: Stats | None = None, k: int | None = None, real_counts: bool = False, average: float = AVERAGE) -> DataFrame:
    """Documents that match with their BM25 score: doc_id, score; the k best, if given.

    With real_counts a word counts as often as the document has it (its most
    frequent term), instead of once.
    """
    node = _tree(query)
    stats = stats or rank_terms(corpus, node)
    found = mini(corpus, node, stats)
    if real_counts:
        leaves: list[Plan] = []
        if simplify(node, stats, False, leaves) is not None:
            counts = _hits(corpus, leaves, stats, ["tf"]).groupBy("doc_id", "leaf").agg(F.max("tf").alias("tf")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "tf"))).alias("tfs"))
            found = found.join(counts, "doc_id").withColumn("factors", F.expr("transform(factors, x -> struct(x.term_id AS term_id, x.idf AS idf, tfs[x.term_id] AS occurs))"))
    scored = found.select("doc_id", bm25(F.col("factors"), F.col("n_words"), average).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "doc_id").limit(k)


# ---------------------------------------------------------------- tuples

def _sorted(entries: Column) -> Column:
    """Entries by lower bound, of equal ones the heaviest alone, then the first operand's."""
    order = F.array_sort(entries, lambda a, b: F.when(a["lower"] != b["lower"], a["lower"] - b["lower"]).when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).otherwise(a["k"] - b["k"]).cast("int"))
    return order


def _or(parts: list[Column]) -> Column:
    def numbered(c: Column, k: int) -> Column:
        return F.transform(c, lambda e: F.struct(e["lower"].alias("lower"), e["upper"].alias("upper"), e["weight"].alias("weight"), e["points"].alias("points"), F.lit(k).alias("k")))

    tagged = F.concat(*[numbered(c, k) for k, c in enumerate(parts)])
    every = _sorted(tagged)
    first = F.filter(F.transform(F.arrays_zip(every.alias("e"), F.concat(F.array(F.lit(-1)), F.transform(every, lambda e: e["lower"])).alias("before")), lambda x: x), lambda x: x["e"].isNotNull() & (x["e"]["lower"] != x["before"]))
    return F.transform(first, lambda x: F.struct(x["e"]["lower"].alias("lower"), x["e"]["upper"].alias("upper"), x["e"]["weight"].alias("weight"), x["e"]["points"].alias("points")))


def _in_order(parts: list[Column]) -> Column:
    """Bases b such that operand k has an entry at b + k: neighbours with one base, once all entries are sorted by base and operand."""

    def moved(p: Column, k: int) -> Column:
        return F.transform(p, lambda e: F.struct((e["lower"] - k).alias("base"), F.lit(k).alias("k"), e["weight"].alias("weight"), F.slice(e["points"], 1, 1).alias("points")))

    every = F.array_sort(F.concat(*[moved(p, k) for k, p in enumerate(parts)]))
    names = [f"e{k}" for k in range(len(parts))]
    rows = F.arrays_zip(*[F.slice(every, k + 1, F.size(every)).alias(name) for k, name in enumerate(names)])

    def made(x: Column) -> Column:
        rest = F.lit(1.0)
        for name in names:
            rest = rest * (1 - x[name]["weight"])
        base = x[names[0]]["base"]
        return F.struct(base.alias("lower"), (base + len(parts) - 1).alias("upper"), (1 - rest).alias("weight"), F.concat(*[x[name]["points"] for name in names]).alias("points"))

    return F.transform(F.filter(rows, lambda x: x[names[0]]["base"] == x[names[-1]]["base"]), made)


def _listed(sizes: array, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array(sizes))]).astype(np.int32)), values)


def _flat(rows: Iterable[list[kernels.Entry]]) -> pa.Array:
    """Entries of documents, ENTRIES: in flat arrays of numbers."""
    sizes, lower, upper, many, offset, term = (array("i") for _ in range(6))
    weight = array("d")
    for entries in rows:
        sizes.append(len(entries))
        for a, b, w, points in entries:
            lower.append(a)
            upper.append(b)
            weight.append(w)
            many.append(len(points))
            for o, t in points:
                offset.append(o)
                term.append(t)
    of = lambda x: pa.array(np.array(x))
    points = _listed(many, pa.StructArray.from_arrays([of(offset), of(term)], ["offset", "term"]))
    return _listed(sizes, pa.StructArray.from_arrays([of(lower), of(upper), of(weight), points], ["lower", "upper", "weight", "points"]))


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _of_word(places: pa.ListArray, weights: pa.ListArray, k: int) -> Iterator[list[kernels.Entry]]:
    """A word's entries, document by document."""
    ends, at, weight = _numbers(places.offsets), _numbers(places.values), _numbers(weights.values)
    for a, b in zip(ends, ends[1:]):
        yield [(p, p, w, [(p, k)]) for p, w in zip(at[a:b].tolist(), weight[a:b].tolist())]


def _of_node(entries: pa.ListArray) -> Iterator[list[kernels.Entry]]:
    """A node's entries, document by document."""
    lower, upper, weight, points = entries.values.flatten()
    ends, starts, (offset, term) = _numbers(entries.offsets), _numbers(points.offsets), map(_numbers, points.values.flatten())
    lower, upper, weight = map(_numbers, (lower, upper, weight))
    for a, b in zip(ends, ends[1:]):
        points = [list(zip(offset[x:y].tolist(), term[x:y].tolist())) for x, y in zip(starts[a:b], starts[a + 1 : b + 1])]
        yield list(zip(lower[a:b].tolist(), upper[a:b].tolist(), weight[a:b].tolist(), points))


def _by_weight(parts: list[Plan]) -> list[int]:
    return sorted(range(len(parts)), key=lambda i: -parts[i].range)


def _tuples(plan: Plan, leaf_entries, fields: Fields) -> Column:
    """The tuples of a plan as an expression, ENTRIES."""
    if plan.leaf >= 0:
        return leaf_entries(plan.leaf)
    parts = [_tuples(p, leaf_entries, fields) for p in plan.parts]
    if plan.kind == "||":
        return _or(parts)
    if plan.kind == "order":
        return _in_order(parts)
    if plan.kind == "!":
        return parts[0]
    if plan.kind == "limit":
        return F.filter(parts[0], lambda e: e["upper"] - e["lower"] < plan.detail["context"])
    if plan.kind in ("cover", "match"):
        names = plan.detail["field"]
        ids = [F.lit(i) for i in fields.ids([names] if isinstance(names, str) else names)]
        spans = F.filter("markup", lambda m: m["field_id"].isin(ids) if ids else F.lit(False))
        if plan.kind == "cover":
            return F.filter(parts[0], lambda e: F.exists(spans, lambda m: (m["lower"] <= e["lower"]) & (e["upper"] <= m["upper"])))
        return F.filter(parts[0], lambda e: F.exists(spans, lambda m: (m["lower"] == e["lower"]) & (e["upper"] == m["upper"])))
    order = _by_weight(plan.parts)
    columns, leaves = [], []
    for i in order:  # of a word only places and weights are needed
        leaf = plan.parts[i].leaf
        columns += [parts[i]] if leaf < 0 else [F.transform(parts[i], lambda e: e["lower"]), F.transform(parts[i], lambda e: e["weight"])]
        leaves.append(leaf)

    def documents(columns: tuple[pa.Array, ...]) -> Iterator[tuple[list[kernels.Entry], ...]]:
        values = iter(columns)
        return zip(*[_of_node(next(values)) if k < 0 else _of_word(next(values), next(values), k) for k in leaves])

    if plan.kind == "&&":

        @F.arrow_udf(ENTRIES)
        def every(*columns: pa.Array) -> pa.Array:
            return _flat(kernels.all_of(list(x)) for x in documents(columns))

        return every(*columns)
    ranges, quorum = [plan.parts[i].range for i in order], plan.range

    @F.arrow_udf(ENTRIES)
    def near(*columns: pa.Array) -> pa.Array:
        return _flat(kernels.fuzzy(list(x), ranges, order, quorum) for x in documents(columns))

    return near(*columns)


def _asks_fields(plan: Plan) -> bool:
    return plan.kind in ("cover", "match") or any(map(_asks_fields, plan.parts))


def _needs_tuples(plan: Plan, entries) -> Column:
    """Whether a document with these entries can have tuples: excluded operands must have none."""
    if plan.kind == "!":
        out = _needs_tuples(plan.parts[0], entries)
        for p in plan.parts[1:]:
            out = out & ~_needs_tuples(p, entries)
        return out
    if plan.leaf >= 0 or not plan.parts:
        return _matches(plan, entries)
    found = [_needs_tuples(p, entries) for p in plan.parts]
    if plan.kind == "fuzzy":
        return _quorum(plan, found)
    out = found[0]
    for f in found[1:]:
        out = out | f if plan.kind == "||" else out & f
    return out


def rich(corpus: Corpus, query: str | Node, stats: Stats | None = None, fields: list[str] | None = None) -> DataFrame:
    """Documents with tuples of the query: doc_id, n_words, entries (lower, upper, weight, points).

    ``fields`` names those that the search is about; positions elsewhere
    weigh ELSEWHERE.  A word's weight is that in stats; in another form than
    asked for it is half, or none within a quote.  A document that matches
    but has no tuple isn't returned.  ``!`` excludes documents that match its
    further operands; ``limit`` keeps tuples narrower than its context.
    """
    node = _tree(query)
    operator(node)
    stats = stats or rank_terms(corpus, node)
    leaves: list[Plan] = []
    plan = simplify(node, stats, True, leaves)
    if plan is None:
        return corpus.postings.sparkSession.createDataFrame([], f"doc_id bigint, n_words int, entries {ENTRIES}")
    hits = _hits(corpus, leaves, stats, ["positions", "forms"])
    # Each row's hits as (pos, ord, weight), with the forms weighed.
    strict = [p.leaf for p in leaves if p.strict]
    base = F.lit(None).cast("double")
    for p in leaves:
        base = F.when(F.col("leaf") == p.leaf, F.col("idf") if p.kind == "wildcard" else F.lit(p.range)).otherwise(base)
    other = F.when(F.col("leaf").isin(strict), F.lit(-1.0)).otherwise(0.5 * F.col("base")) if strict else 0.5 * F.col("base")
    listed = F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(F.array(F.lit(analysis.PLAIN_FORM)))
    weighed = hits.withColumn("base", base).withColumn("listed", listed).withColumn("other", other)
    weighed = weighed.select(
        "doc_id", "leaf",
        F.transform(F.arrays_zip("positions", "forms"), lambda x: F.struct(x["positions"].alias("pos"), F.col("ord"), F.when(F.array_contains(F.col("listed"), x["forms"]), F.col("base")).otherwise(F.col("other")).alias("w"))).alias("hits"),
    )
    by_doc = weighed.groupBy("doc_id").agg(*[F.flatten(F.collect_list(F.when(F.col("leaf") == p.leaf, F.col("hits")))).alias(f"hits_{p.leaf}") for p in leaves])
    matched = by_doc.filter(_needs_tuples(plan, lambda k: F.size(f"hits_{k}") > 0))
    about = None if fields is None else [F.lit(i) for i in corpus.fields.ids(fields)]
    spans = about is not None or _asks_fields(plan)
    with_docs = matched.join(corpus.lengths if spans else corpus.lengths.select("doc_id", "n_words", F.array().cast("array<struct<field_id: int, lower: int, upper: int>>").alias("markup")), "doc_id")

    def field_of(pos: Column) -> Column:
        around = F.filter("markup", lambda m: (m["lower"] <= pos) & (m["upper"] >= pos))
        return F.coalesce(F.when(F.size(around) > 0, F.element_at(around, -1)["field_id"]), F.lit(0))

    def entries_of(k: int) -> Column:
        rows = F.col(f"hits_{k}")
        if about is not None:
            rows = F.transform(rows, lambda h: F.struct(h["pos"].alias("pos"), h["ord"].alias("ord"), F.when(field_of(h["pos"]).isin(about) if about else F.lit(False), h["w"]).otherwise(F.lit(ELSEWHERE)).alias("w")))
        rows = F.array_sort(F.filter(rows, lambda h: h["w"] > 0))
        before = F.concat(F.array(F.lit(-1)), F.transform(rows, lambda h: h["pos"]))
        first = F.filter(F.arrays_zip(rows.alias("h"), before.alias("b")), lambda x: x["h"].isNotNull() & (x["h"]["pos"] != x["b"]))
        return F.transform(first, lambda x: F.struct(x["h"]["pos"].alias("lower"), x["h"]["pos"].alias("upper"), x["h"]["w"].alias("weight"), F.array(F.struct(x["h"]["pos"].alias("offset"), F.lit(k).alias("term"))).alias("points"))).cast(ENTRIES)

    with_entries = with_docs.select("doc_id", "n_words", "markup", *[entries_of(p.leaf).alias(f"entries_{p.leaf}") for p in leaves])
    out = with_entries.select("doc_id", "n_words", _tuples(plan, lambda k: F.col(f"entries_{k}"), corpus.fields).cast(ENTRIES).alias("entries"))
    return out.filter(F.size("entries") > 0)


def number_range(numbers: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Documents with numbers from low to high, both included: doc_id, tf, least, most. See analysis.numbers."""
    if low is not None:
        numbers = numbers.filter(F.col("number") >= low)
    if high is not None:
        numbers = numbers.filter(F.col("number") <= high)
    return numbers.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("tf"), F.min("number").alias("least"), F.max("number").alias("most"))


def rich_search(corpus: Corpus, query: str | Node, stats: Stats | None = None, fields: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Documents with tuples, scored by their heaviest: doc_id, score; the k best, if given."""
    scored = rich(corpus, query, stats, fields).select("doc_id", F.array_max(F.transform("entries", lambda e: e["weight"])).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "doc_id").limit(k)


def tuples(found: DataFrame) -> DataFrame:
    """Tuples of a rich result, a row each: doc_id, lower, upper, weight, points."""
    return found.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.*")


def within(corpus: Corpus, low: int, high: int) -> Corpus:
    """The corpus of the documents with ids from low to high, for queries that are divided by document.

    The bounds reach the files; weights are still to come from the whole (see rank_terms).
    """
    some = F.col("doc_id").between(low, high)
    return replace(corpus, postings=corpus.postings.filter(some), docs=corpus.docs.filter(some), lengths=corpus.lengths.filter(some))
