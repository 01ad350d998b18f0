"""A training corpus from raw documents in five stages.

Each stage is a function of (spark, docs, sf_dir) to a DataFrame; ``run`` writes what a stage returns as Parquet in the shared scratch folder and reads
it again for the next one; what a stage wrote for itself is deleted then, and so is its predecessor's table. All but the last return the columns of documents. SQL cannot express the classifier, MinHash or
alignment, so ORACLE_SQL is None and the stages are tested against brute-force versions.

Rows: a null or empty text is kept by the classifier. Null texts are kept by all filters; of empty ones one stays. Both are in no bin. Very long texts are read whole by every stage. Of repeated rows one stays. Ties are settled
by the least doc_id, null last; ids may be of any type with an order. Extra columns, whatever their names, are passed on to the last stage, which gives bins. Empty tables give no bins, and an empty benchmark or
labels table lets every document pass its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokloom.llm import decontaminate, exact_dedup, minhash, packing, quality
from tokloom.session import drop, passing_tables, prepare, save

ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels, does not reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the documents' tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("minhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing_tables(spark) as keep:
            kept = keep(save(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
