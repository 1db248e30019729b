"""From ``documents`` to token files: rules, near-duplicates, decontamination, mixing, tokens.

Every stage is (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet to the shared folder and read back as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folioloom.llm import decontaminate, mixing, rules, simhash, tokenfiles
from folioloom.llm.store import Workspace, forget, recording

NEAR = 0.8
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_worked_in: list = []


def _after(first: bool) -> Callable[[Stage], Stage]:
    """Lets go of the folders of the stage before (none before the first one)."""

    def wrap(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            _worked_in.clear() if first else forget(_worked_in)
            with recording() as made:
                out = stage(spark, docs, sf_dir)
            _worked_in.extend(made)
            return out

        return run_stage

    return wrap


@_after(first=True)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the standard policy."""
    return rules.filter_documents(docs, "standard-v1")


@_after(first=False)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links and of near copies (5-word shingles, similarity 0.8 or more)."""
    return simhash.keep_one(docs, jaccard=NEAR)


@_after(first=False)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_after(first=False)
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to ``mixing.MAX_REPEATS`` times."""
    return mixing.mixed(docs).drop("__epoch", "__block", "__rank", "__place")


@_after(first=False)
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back as the digest of each document."""
    return tokenfiles.token_digest(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL has no SimHash, no tokenizer and no block permutation; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.table(stage(spark, docs, sf_dir), name)
        if k:
            space.drop(STAGES[k - 1][0])
    return docs
