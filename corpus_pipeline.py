"""A cleaning run over `documents`: five stages, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept. The first four return documents with the columns they came
with; the last one gives token ids in place of the text. Rows are handled as each operator defines for null, empty and
repeated ones; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortlib.llm import bpe, host_rules, mixing, paragraphs, simhash
from cohortlib.llm.helpers import delete, documents, n_written, prepare, stage, written_since

#: Words by runs of several matches, positions by a schedule and byte merges have no form in SQL; the run is tested
#: against a brute-force version instead.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: dict[str, list[str]] = {}


def _stage(step: Stage) -> Stage:
    """A stage's own tables stay until the next stage begins: by then its result has been written and is read from there,
    so they are deleted, unless the next stage's input still reads them."""
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        app = spark.sparkContext.applicationId
        old = _scratch.pop(app, [])
        in_use = docs.inputFiles() if old else []
        delete(spark, [p for p in old if not any(p.split("://")[-1] in f for f in in_use)])
        mark = n_written()
        out = step(spark, docs, sf_dir)
        _scratch[app] = written_since(mark)
        return out
    return run_step


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and come from hosts that do."""
    return host_rules.passing(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHashes (three words, two bits) link: the one with the smallest id."""
    return simhash.keep_one(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents left without a word go."""
    return paragraphs.without_repeats(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in training order, each as often as its source's target asks for."""
    return mixing.curriculum(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and digests of the ids and of the decoded bytes."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the tables between them go to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
