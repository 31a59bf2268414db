"""From raw documents to token files, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontamination, language_id, mixing, simhash, token_output
from cadenza.llm.queries import TOKENIZER
from cadenza.llm.text import table
from cadenza.plans.materialize import cut, scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; the others get the language learned from the labelled ones, if they have none."""
    return language_id.identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the one with the smallest id."""
    return simhash.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words one in twenty lies in a passage of the benchmark."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in order of the mix; a source that is used up leaves it, and the others go on."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, in the order of the mix, and one row per document read back from them.

    The mixing stage's table holds the documents in that order and has no column for it, so it is
    taken from the places of the rows in the table's files.
    """
    path = scratch_path(spark, "token-files")
    token_output.write_token_files(docs, path, TOKENIZER, order=token_output.stored_order())
    return token_output.read_token_files(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

# Neither code lengths nor a tokenizer can be put into SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
