"""A training corpus from `documents`: five stages, each one operator, each over all that the stage before kept.

quality: documents that the classifier rejects go. exact_dedup: one document of each group of equal texts stays.
near_dedup: one document of each group of near copies stays; a wide SimHash radius and an estimated Jaccard similarity of
0.65 find the candidates, and the Jaccard similarity of their sets of five-word shingles, 0.8 at least, confirms them. mixing: documents are
dropped or repeated until each source has its share. packing: sequences of 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import text_or_empty
from corvane.llm.exact_dedup import exact_dedup, keep_one
from corvane.llm.mixing import mixed
from corvane.llm.packing import pack
from corvane.llm.quality import quality_score, train
from corvane.llm.queries import vocabulary
from corvane.llm.simhash import keep_representatives, near_components


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(spark, net, text_or_empty()) >= 0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs, near_components(docs, words=5, radius=20, sketch_words=5, min_similarity=0.65, least_jaccard=0.8))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]
#: The stages fit a network, cut byte pairs and lay out windows; none of that is SQL. tests/llm/test_pipeline.py holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result is stored, as in a cluster run."""
    from corvane.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
