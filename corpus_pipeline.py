"""A corpus pipeline of five stages; each takes the documents that the one before kept.

Stages return all columns of their input, but for the last, which writes token ids and reports them.  ``run`` writes
every stage to the shared folder and reads it again, so a lost executor repeats one stage at most.

The step tables of a stage lie in a folder of their own.  It goes when the next stage begins, whose input is the written
result and doesn't read them; what a stage reads stays until the stage is written.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from claimsieve.llm import decontaminate, jaccard, mixing, quality_rules, token_pack
from claimsieve.session import materialize, release_group, step_group

VOCABULARY = 50_257
END_ID = 0


_groups: dict[str, list[str]] = {}  # by application: step tables of the stages that have run


def staged(stage):
    """Free the step tables of earlier stages, then keep this stage's own together."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = _groups.setdefault(spark.sparkContext.applicationId, [])
        held[:] = [g for g in held if not release_group(spark, g, docs)]
        with step_group(stage.__name__) as group:
            held.append(group)
            return stage(spark, docs, sf_dir)

    return run_stage


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@staged
def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return jaccard.one_row_of_each_group(docs, k=5, percent=80)


@staged
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@staged
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the source, language and topic targets, counted in estimated tokens; those of rare cells repeat."""
    columns, docs = docs.columns, docs.withColumn("_form", mixing.form_topic())
    cells = materialize(mixing.cells_of(docs, ["source", *mixing.TARGETS], mixing.estimated_tokens()), "cells")
    targets = {"source": mixing.source_targets(cells)} | mixing.TARGETS
    mixed = mixing.mix(docs, targets, cells, most=None)
    return mixing.drawn(mixed, columns)


@staged
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids: where each document starts, how many ids it has, and their checksum."""
    import public_tokenizers

    return token_pack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), VOCABULARY, END_ID)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: The decision list is learned and the ids come from a tokenizer, neither of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[str] = []
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        with step_group("kept") as group:
            docs = materialize(kept, name.split()[0].lower())
        written.append(group)
        if len(written) > 2:
            release_group(spark, written[-3])  # no later stage reads it
    return docs
