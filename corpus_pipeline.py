"""A corpus pipeline of five stages over `documents`; each works on all that the one before kept.

Toxic documents go, repeated three-line windows are removed, of each class of near copies one
document stays, sources are mixed to target weights, and what is left is encoded. All stages but
the last return the columns of `documents`; n_chars follows the text. The mixture repeats documents
of sources that need more than one epoch, as rows of their own.

Results of a stage are written as Parquet and read again by the next, so a lost executor never
costs more than its stage; what was read is deleted then, and only the input of the last stage stays,
as the result still reads it.

Defined results: rows with a null text pass the first three stages unchanged (n_chars stays, too) and
take no part in the mixture, nor do texts without words; rows with a null doc_id are never copies of
others; repeated rows of a document stay or go together, and each counts in the mixture. Very long
texts are processed whole. Extra columns are kept up to the mixture; an empty table gives none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from chronoloom.llm.common import ensure_checkpoint_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents keep their rows, even where all lines go: an empty text is a result."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: Nearest neighbours under TF-IDF and byte-pair merges have no SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; results between them lie in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    jvm = spark.sparkContext._jvm
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            read = jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            read.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(read, True)
    return docs
