"""A training corpus from raw documents: five stages, each over all that the one before it kept.

``STAGES`` has (name, function); a function takes (spark, docs, sf_dir) and returns the next documents, the last one the
token blocks. Whoever runs the stages writes each result as Parquet and gives the next stage what it reads back.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphmine.llm import decontam, langid, mixing, simhash, token_codec
from glyphmine.llm.textkit import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; the others go."""
    return langid.drop_foreign(docs, langid.fit(langid.sample(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources call for; each at least once."""
    return mixing.resample(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the documents as compressed blocks."""
    return token_codec.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mix),
    ("token blocks", token_blocks),
]

#: Language ID, fingerprints, alignments and range coding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, with each stage's result written to the shared folder and read again.

    A lost executor costs the tasks it ran, never a finished stage. Null and empty texts go in the first stage; an
    empty table gives no blocks; columns beyond those of ``documents`` are carried along up to the last stage.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    here = os.path.dirname(os.path.abspath(__file__))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
