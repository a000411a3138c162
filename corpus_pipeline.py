"""A corpus pipeline of five stages: quality rules, near duplicates, decontamination, PII, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it back as the docs of the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, only_ids, read_table
from millrace.llm.decontam import clean_documents as without_items
from millrace.llm.jaccard import JaccardJoin, jaccard_components
from millrace.llm.pieces import encode_documents
from millrace.llm.pii import masked
from millrace.llm.quality import clean_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No stage of the near-duplicate join, template matching, bootstrapping or merge fold can be written as one SQL query.
ORACLE_SQL = None


def sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines; null and empty texts go."""
    return sized(clean_documents(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one whose doc_id names it. Rows that share a doc_id are kept or go together;
    rows without one are no copies of anything that could be named, and stay."""
    found = jaccard_components(docs, JaccardJoin(size=5, num=80, den=100))
    other = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    named = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    return only_ids(docs, other.join(named, "doc_id", "left_anti"), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_items(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return sized(masked(docs.select(*COLUMNS)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document."""
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
