"""The training-data pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Each stage works on all rows that its predecessor kept. All but the last return the columns of documents; in the mixing
stage a document stands as often as its rate says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from annolith.llm import queries
from annolith.llm.decontaminate import remove_contaminated
from annolith.llm.language_id import keep_identified
from annolith.llm.mixing import fit_domains, mixed
from annolith.llm.shared import fresh_path, scratch, set_small_batches, small_batches, table
from annolith.llm.simhash import keep_one
from annolith.llm.token_files import read_tokens, write_tokens

#: Bits in which fingerprints of near copies differ at most.
STAGE_DISTANCE = 6

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """A stage whose rows reach Python in small batches, when they are made too, which is after it has returned."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        set_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or whose likeliest one is hardly likelier than chance, go."""
    return keep_identified(docs, queries.language_model(docs))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays.

    Fingerprints link at six bits: of the check tool's pairs of texts that share four fifths or more of their five-word shingles
    0.63 are then linked, with the four bits of op7_simhash 0.37.
    """
    return keep_one(docs, distance=STAGE_DISTANCE)


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more lies in benchmark passages."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the domains' token shares meet the targets."""
    return mixed(docs, fit_domains(docs, queries.domain_labels(spark, sf_dir), queries.DOMAINS), queries.TARGETS)


@in_small_batches
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written; the result is what they say of each document."""
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token files", token_files)]
#: SQL can express none of the stages' methods; the pipeline is tested against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        with scratch(spark), small_batches(spark):  # what the stage writes for itself goes when its result is stored
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
