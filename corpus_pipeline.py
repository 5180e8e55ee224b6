"""A training corpus from ``documents``: quality, exact and near copies, mix, sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
``run`` writes each result as Parquet in the shared folder and rereads it, so a
lost executor never costs more than its own stage.

Defined results: a null or empty text is rejected by the first stage; a null id
comes after all others, and of equal texts or near copies it stays only if no
other id is there; rows that repeat id and text are one document to the two
stages on copies, of which the first keeps one row; a null source is a source of
its own; other columns go along to the mix, and the last stage returns the
columns of packing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm.common import Scratch, table
from changeloom.llm.exact_dedup import drop_exact_copies
from changeloom.llm.minhash import drop_near_copies
from changeloom.llm.mixing import mixed
from changeloom.llm.quality import keep_good
from changeloom.llm.queries import pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and the lines above the limits go from the others; n_chars follows the text."""
    return keep_good(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, one of them if it is repeated."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; texts without words have no copies."""
    return drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: left out, cut, or repeated up to three times; without words they go."""
    return mixed(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix and their places in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Packing needs a tokenizer, which SQL cannot express; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
