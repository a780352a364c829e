"""Operator 8: personal identifiers and secrets, by bootstrapping.

Candidates are runs of words with a digit or an at sign in them, and any word
that is assigned to a name, as in ``name: word`` or ``name=word``.  Strict
recognisers name some of them: the seeds.  Every candidate is tied to lexical
patterns: its shape, its head and tail, the words on either side.  Seeds lend
their kind to patterns, patterns in which one kind prevails lend it to their
other instances, and so on over the graph of patterns and instances until
nothing changes; what confident patterns reach is found although no recogniser
knows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_schema, column, require, text_key

#: Rounds go on until no kind and no score (to 6 digits) changes; scores that never settle end here.
ROUNDS = 30
CONFIDENCE = 0.5
SUPPORT = 3
#: What an instance of unknown kind weighs against a pattern, next to one of another kind.
UNKNOWN = 0.05
#: Candidates go on to the end of a run of marked words; in a run of more than RUN_WORDS, such as a row of a table, up to
#: LONG_WORDS, which no recogniser exceeds (a phone has five) nor any common identifier (the longest IBAN has nine groups).
RUN_WORDS, LONG_WORDS = 32, 9

_WORD = re.compile(r"\S+")
_MARKED = re.compile(r"[0-9@]")
_SLOT = re.compile(r"[0-9@=:]")
_EDGE = " .,;:!?\"'`*#$%&|<>[]{}~^…«»“”"
_RUN = re.compile(r"[^\W_]+|[\W_]")
_EMAIL = re.compile(r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}")
_PHONE = re.compile(r"\+1 \(?[2-9][0-9]{2}\)?[ -][2-9][0-9]{2}[ -][0-9]{4}|\+[2-9][0-9]{0,2} [0-9]{2,4}([ -][0-9]{2,4}){2,3}")
_IP = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})")
_CARD = re.compile(r"[3-6][0-9]{12,18}|[3-6][0-9]{3}([ -][0-9]{4}){3}")
_KEY = re.compile(r"akia[0-9a-z]{16}|(password|passwd|pwd|secret|token|api[_-]?key)[=:]\S*[0-9]\S*")
_ASSIGNS = re.compile(r"[^\s=:]+[=:].*[^\W_]")
_NAMED = re.compile(r"(password|passwd|pwd|secret|token|api[_-]?key) ?[=:]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def assigned(text: str, start: int) -> tuple[str, str, int] | None:
    """Name and sign of an assignment (``name = "``, ``name:``) that ends at start, and where it begins."""
    i = start
    if i and text[i - 1] in "\"'`":
        i -= 1
    while i and text[i - 1].isspace():
        i -= 1
    if not i or text[i - 1] not in "=:":
        return None
    end = i - 1
    while end and text[end - 1].isspace():
        end -= 1
    begin = end
    while begin and not text[begin - 1].isspace() and text[begin - 1] not in "=:":
        begin -= 1
    return (text[begin:end], text[i - 1], begin) if begin < end else None


def seed_kind(entity: str, left: str) -> str | None:
    """What the strict recognisers take a candidate (in lower case) for, given the word before it, with the sign of an assignment."""
    if _EMAIL.fullmatch(entity):
        return "email"
    if _PHONE.fullmatch(entity):
        return "phone"
    if (m := _IP.fullmatch(entity)) and all(int(x) < 256 and str(int(x)) == x for x in m.groups()):
        return "ip"
    if _CARD.fullmatch(entity) and _luhn(re.sub(r"\D", "", entity)):
        return "card"
    if _KEY.fullmatch(entity) or (" " not in entity and len(entity) >= 12 and _MARKED.search(entity) and _NAMED.fullmatch(left)):
        return "secret"
    return None


def _class(run: str) -> str:
    n = len(run)
    if run.isdigit():
        return "9" if n <= 4 else "9" + "<" * min(4, (n - 1) // 4)
    if run.isalpha():
        return "a"
    long = "+" if n >= 12 else ""
    return ("h" if re.fullmatch("[0-9a-f]+", run) else "w") + long


def patterns(entity: str, left: str, right: str) -> set[str]:
    """The lexical patterns of a candidate."""
    runs = _RUN.findall(entity)
    shape = "".join(_class(r) if r[0].isalnum() else r for r in runs)
    out = {"shape " + shape}
    words = [r for r in runs if r[0].isalnum()]
    if len(runs) == 1 and (m := re.match("[a-z]{4}", entity)):
        out.add(f"head {m[0]} {_class(entity)}")
    if len(runs) > 1 and words:
        if words[0].isalpha() and entity.startswith(words[0]) and runs[1] in "=:":
            out.add(f"name {words[0]}{runs[1]}")
        if words[-1].isalpha():
            out.add("end " + "".join(runs[-3:]))
    if left:
        out |= {f"left {left} {shape}", f"left {left}"}
    if right:
        out.add(f"right {right} {shape}")
    return out


def candidates(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Runs of marked words and single assigned ones: start, end, entity in lower case, words to the left, word to the right."""
    if not _SLOT.search(text):
        return
    words = []
    for m in _WORD.finditer(text):
        core = m[0].strip(_EDGE)
        at = m.start() + m[0].find(core) if core else m.start()
        words.append((at, at + len(core), core.lower(), bool(_MARKED.search(core))))
    plain = lambda k: words[k][2] if 0 <= k < len(words) and not words[k][3] else ""
    last = list(range(len(words)))  # of the run that a word is in
    for i in range(len(words) - 2, -1, -1):
        if words[i][3] and words[i + 1][3] and not text.count("\n", words[i][1], words[i + 1][0]):
            last[i] = last[i + 1]
    begin = 0
    for i, (start, _, _, marked) in enumerate(words):
        if not i or last[i] != last[i - 1]:
            begin = i
        sign = assigned(text, start)
        if not marked and not (_ASSIGNS.match(words[i][2]) or (sign and "\n" not in text[sign[2] : start] and any(c.isalnum() for c in words[i][2]))):
            continue
        left = f"{sign[0].strip(_EDGE).lower()} {sign[1]}" if sign else plain(i - 1)
        stop = last[i] if last[i] - begin < RUN_WORDS else min(last[i], i + LONG_WORDS - 1)
        for j in range(i, stop + 1):
            yield start, words[j][1], " ".join(w[2] for w in words[i : j + 1]), left, plain(j + 1)


FOUND = "doc_id bigint, key bigint, start int, stop int, entity string, seed string, patterns array<string>, surface string"


def _found(docs: DataFrame) -> DataFrame:
    schema = arrow_schema(FOUND)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = text.as_py()
                for start, stop, entity, left, right in candidates(t):
                    rows.append((doc_id, key, start, stop, entity, seed_kind(entity, left), sorted(patterns(entity, left, right)), t[start:stop]))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    text = column(docs, "text")
    marked = docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), text_key(text).alias("key"), text.alias("text")).filter(F.col("text").rlike(_SLOT.pattern))
    return marked.mapInArrow(find, FOUND)


def scores(found: DataFrame, tables: Tables, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Instances with a kind: entity, kind, score, seed.

    In each round a pattern's confidence in a kind is p / (p + q + UNKNOWN * u):
    p adds the scores of its instances of that kind, q those of other kinds,
    and u counts the rest.  Patterns of at least ``confidence`` whose p is at
    least ``support`` give it to their instances; an instance takes the kind
    of its most confident pattern, ties going to the first kind in order.
    Seeds keep theirs, with score 1.  Rounds end when nothing changes, or
    after ``rounds``.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("entity", "kind", F.round("score", 6)).cast("decimal(38,0)"))).first())


    edges = tables.write(found.select("entity", F.explode("patterns").alias("pattern")).distinct(), "edges")
    seeds = tables.write(found.filter("seed IS NOT NULL").groupBy("entity").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0)), "scores")
    known = seeds
    sizes = tables.write(edges.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    now = mark(seeds)
    for _ in range(rounds):
        of_kind = edges.join(known, "entity").groupBy("pattern", "kind").agg(F.sum("score").alias("p"), F.count("*").alias("m"))
        all_kinds = Window.partitionBy("pattern")
        rated = of_kind.withColumn("all", F.sum("p").over(all_kinds)).withColumn("named", F.sum("m").over(all_kinds)).join(sizes, "pattern")
        # Sums of doubles come in any order: rounding settles what they are compared for.
        rated = rated.withColumn("c", F.round(F.col("p") / (F.col("all") + UNKNOWN * (F.col("n") - F.col("named"))), 9))
        sure = rated.filter((F.col("c") >= confidence) & (F.round("p", 6) >= support)).select("pattern", "kind", "c")
        reached = edges.join(sure, "pattern").groupBy("entity").agg(F.max(F.struct("c", F.col("kind").alias("k"))).alias("best"))
        new = reached.join(seeds, "entity", "left_anti").select("entity", F.col("best.k").alias("kind"), F.col("best.c").alias("score"))
        before, known = known, tables.write(seeds.unionByName(new), "scores")
        if before is not seeds:
            tables.drop(before)
        last, now = now, mark(known)
        if now == last:
            break
    return known.join(seeds.select("entity", F.lit(True).alias("seed")), "entity", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))


def find(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Where identifiers stand: doc_id, start (character, from 0), kind, entity as written, score, seed.

    Kinds are email, phone, ip, card and secret.  Of finds that overlap, the
    one that begins first stays, and of these the longest.

    Texts are searched whole.  Null and empty texts hold nothing; a null
    doc_id is reported as null; repeated rows are reported once; an empty
    table gives no rows; other columns aren't read.
    """
    require(docs, ["doc_id", "text"])
    tables = Tables(docs.sparkSession, "identifiers")
    found = tables.write(_found(docs), "found")
    named = scores(found, tables, rounds, confidence, support)
    hits = found.select("doc_id", "key", "start", "stop", "entity", "surface").distinct().join(named, "entity")
    before = Window.partitionBy("doc_id", "key").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    kept = hits.withColumn("reach", F.max("stop").over(before)).filter(F.col("reach").isNull() | (F.col("stop") > F.col("reach")))
    return kept.select("doc_id", "start", "kind", F.col("surface").alias("entity"), F.round("score", 6).alias("score"), "seed").distinct()
