"""A corpus pipeline of five stages, each calling an operator of the training-data package.

Every stage but the last returns documents with all their columns: the classifier's rejects go, one document of each
near-duplicate component stays, documents that hold a benchmark item go, and secrets are masked in place. The last stage
packs what is left. Empty tables pass through; rows with null texts are scored, compared and packed like empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common, decontamination, packing, quality, secrets, simhash


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of these documents, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, quality.learn(docs, labels))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles."""
    return simhash.deduplicated(docs)


def untainted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of documents and where they go."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good),
    ("simhash_near_dedup", single),
    ("benchmark_decontamination", untainted),
    ("secret_scan", masked),
    ("best_fit_packing", packed),
]
#: Learned trees, hash components and tokens can't be told in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. A stage's scratch tables, and what it read, are dropped as soon as its rows are written."""
    docs, last = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with common.passing(spark) as keep:
            docs, path = common.written(stage(spark, docs, sf_dir), f"stage_{name}")
            keep.append(path)
        if last:
            common.removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
