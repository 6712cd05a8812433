"""A training-corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents. Null and empty texts, repeated rows, empty tables and
extra columns are treated as the operators of ``trustweave.llm`` state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.llm.common import stored, table, without
from trustweave.llm.decontamination import contaminated
from trustweave.llm.jaccard_join import similar_groups
from trustweave.llm.line_dedup import remove_lines, repeated_lines
from trustweave.llm.packing import pack_documents
from trustweave.llm.quality import classify

TOKENIZER = "byte_bpe_50k.json"
#: SQL can't express the fitted classifier or the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    judged = classify(docs, table(spark, sf_dir, "labels"))
    return without(docs, stored(judged.where("predicted = 0").select("doc_id")), "doc_id")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones; documents of which nothing is left go."""
    left = remove_lines(docs, stored(repeated_lines(docs)))
    return left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that is linked by five-word shingles at a similarity of 0.8."""
    groups = similar_groups(docs, shingle=5, percent=80)
    return without(docs, stored(groups.where("doc_id <> component_id").select("doc_id")), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    hits = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, stored(hits.select("doc_id")), "doc_id")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
