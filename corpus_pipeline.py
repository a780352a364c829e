"""A training corpus from raw documents: filtered, cleaned, deduplicated, mixed and packed.

Each stage takes the session, the documents that the stage before kept and
the folder of the tables.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiquarry.llm import jaccard_join, line_templates, mixing, packing, quality
from lexiquarry.llm.common import Tables, documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject.

    Null and empty texts aren't rejected; repeated rows are treated alike; all columns are kept.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs.

    Null and empty texts stay as they are; repeated rows are treated alike; all columns are kept.
    """
    return line_templates.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest doc_id.

    Rows with a null doc_id and texts without words stay; rows with the same
    doc_id stay or go together; all columns are kept.
    """
    return jaccard_join.distinct_documents(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, in blocks drawn by the sources' weights; a row for each document's share of a block.

    The rows have the five columns of documents and no others.  A newline
    ends the row with which a document ends, and no other row.  Null and
    empty texts have no token and no row; a null source is a source.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids, with the end id only where a document ends."""
    return packing.pack(docs, ends=mixing.END)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing_sources),
    ("packing", packed),
]

#: A fitted classifier and a tokenizer's merges are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    tables = Tables(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else tables.write(out, f"stage{k}")
    return docs
