"""A corpus pipeline over ``documents``.

Each stage calls one operator on all that its predecessor kept: toxic
documents go, of documents linked by a similarity of 0.8 or more (Jaccard, on
five-word shingles) one stays, sources are mixed to
their target weights (a document may then occur twice), and what is left is
packed into token sequences. All but the last return the columns of their
input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenequarry.llm import mixing, near_copies, packing, toxicity
from scenequarry.llm.queries import BYTE_BPE, table
from scenequarry.llm.shared import remove, scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, BYTE_BPE, end_id=0))


STAGES = [("toxicity", without_toxic), ("near-dedup", without_near_copies), ("source mix", mixed), ("pattern packing", packed)]
#: No SQL expresses a trained classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again.

    A stage's output goes once the next one's is written, so one copy of the corpus lies in the shared folder at a time.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
