"""Corpus pipeline: documents in, packed training batches out.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept,
and returns the columns of ``documents``; the last returns the packing plan.
"""

from pyspark.sql import DataFrame, SparkSession

from rankfield.llm import line_dedup, mixing, near_copies, packing, quality_rules
from rankfield.llm.common import stored, table

# The near-duplicate stage's hashed keys have no SQL form; the stages are tested
# against brute-force versions instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated_documents(docs, long_words=50)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, follow=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("source_mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
