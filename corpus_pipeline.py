"""A training-data pipeline over ``documents``: five stages, each one operator of ``pagewright.llm``.

Each stage takes the rows its predecessor kept and returns rows with the columns
of ``documents``; the last adds the sampled pieces of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import blocknames, dartminhash, discriminant, latticepieces, winnowing
from pagewright.llm.scratch import stored, table

CUT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, trained on the labels at hand, scores below ``CUT``."""
    model = discriminant.train(docs, table(spark, sf_dir, "labels"))
    return discriminant.good(docs, model, cut=CUT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest doc_id of equal texts."""
    return blocknames.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each class of near-duplicates."""
    return dartminhash.near_deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return winnowing.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add piece_ids, n_pieces and whether decoding them gives the text back."""
    coded = latticepieces.encoded(docs, out="piece_ids", lossless="lossless")
    return coded.withColumn("n_pieces", F.size("piece_ids"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pieces", pieces)]
#: SQL cannot express the classifier's training, nor the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
