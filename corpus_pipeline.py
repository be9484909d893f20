"""Documents made ready for training: toxic ones go, then copies, near copies and benchmark leaks, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. It reads what that
stage wrote as Parquet; run() writes to the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from basketry.llm.common import ready, table
from basketry.session import checkpoint_dir


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.3 or more under the clause grammar, fitted to labels. Null and empty texts stay; equal texts go or
    stay together; all columns are passed on."""
    return toxicity.drop_toxic(docs, table(ready(spark), sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id; a null text is empty, a null doc_id comes last. All columns are passed on."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; texts without words are one group, a null doc_id comes last.
    All columns are passed on."""
    return simhash.drop_near_copies(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item; null and empty texts hold none. All columns are passed on."""
    return decontaminate.drop_leaks(docs, table(ready(spark), sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that the kept documents fill; a null text is empty, which is one token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("SimHash near-dedup", remove_near_copies),
    ("benchmark decontamination", remove_leaks),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold each against a brute-force version or the cases that its labels and items give.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir.

    Each stage's rows are written to the shared folder and taken away again when the next stage's are there; the last stage's stay, as the
    returned rows are read from them. An empty table of documents gives no rows; what becomes of nulls, ties and repeated rows each stage says.
    """
    docs = table(ready(spark), sf_dir, "documents")
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            _delete(spark, f"{at}/{i - 1}")
    return docs
