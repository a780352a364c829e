"""Statistics and weights of words, and BM25."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, AVERAGE = 1.5, 0.75, 1000.0
#: Added before rounding an estimated number of documents down.
NUDGE = 1e-3


def idf(n: Column, size: Column) -> Column:
    """ln((1 + N) / n) / ln(1 + N); -1 for a term of no documents or of more than there are."""
    return F.when((n <= 0) | (n > size), F.lit(-1.0)).otherwise(F.log((F.lit(1.0) + size) / n) / F.log(F.lit(1.0) + size))


def idf_value(n: int, size: int) -> float:
    return math.log((1 + size) / n) / math.log(1 + size) if 0 < n <= size else -1.0


def estimated_documents(frequencies: list[int], size: int) -> int:
    """How many documents have a word with several terms: exact for one, else as if the terms were independent."""
    if len(frequencies) < 2:
        return frequencies[0] if frequencies else 0
    absent = 1.0
    for n in frequencies:
        absent *= 1 - n / size
    return int(NUDGE + size * (1 - absent))


def word_range(n: int, size: int) -> float:
    """Weight of a word that n of size documents have; 0 for none."""
    return math.log((1 + size) / n) / math.log(1 + size) if n > 0 and size > 0 else 0.0


def bm25_term(term_idf: Column, occurs: Column, n_words: Column, average: float = AVERAGE) -> Column:
    tf = occurs.cast("double") / n_words
    return term_idf * (tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * n_words / F.lit(average)))


def bm25(factors: Column, n_words: Column, average: float = AVERAGE) -> Column:
    """Sum over factors, array<struct<idf, occurs>>; 0 for a document without words."""
    return F.when(n_words > 0, F.aggregate(factors, F.lit(0.0), lambda acc, x: acc + bm25_term(x["idf"], x["occurs"], n_words, average))).otherwise(0.0)
