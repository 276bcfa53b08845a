"""From raw documents to packed training sequences.

Each stage takes all that the stage before it kept and returns a DataFrame, which is written as Parquet and read again as
the next one's documents. All but the last keep the columns of documents, extra ones and ones of any name too.

Cases, alike in all stages: an empty table gives an empty one; null texts count as empty and null ids are ids like others, ranked last.
Empty texts are judged by the classifier's bias, are equal to one another, near to nothing and hold no item; of rows repeated with id and
text one is left after the exact dedup; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from termlake.llm import op4_quality, op6_decontam, op7_exact_dedup, op9_packing, op10_minhash
from termlake.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return op4_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return op7_exact_dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return op10_minhash.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op6_decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return op9_packing.packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: A trained classifier, a tokenizer and BM25 retrieval are not SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns lies in the shared checkpoint folder."""
    out = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{i}")
        docs = spark.read.parquet(f"{out}/{i}")
        if i:  # what the stage before wrote has been read for the last time
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{i - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
