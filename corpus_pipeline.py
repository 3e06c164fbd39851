"""The corpus pipeline: rules, near duplicates, benchmark passages, mixing and token files, one stage after the other.

Each stage reads what the one before it wrote as Parquet in the shared folder, so that a lost executor costs no more
than a part of one stage. What a stage stored for itself goes when the next one begins: its result has been written then.
All stages take any row: null, empty, blank and very long texts, null and repeated doc_ids, equal rows, null languages and
sources, and columns of any other name, which are handed on as they are. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm import decontaminate, jaccard, mixing, quality_rules, token_codes
from pagelattice.llm.common import removed, scratch, scratch_paths, table
from pagelattice.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stage that ran last.
_before: list[str] = []


def _stage(fn: Stage) -> Stage:
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        removed(spark, _before)
        known = set(scratch_paths())
        out = fn(spark, docs, sf_dir)
        _before[:] = [path for path in scratch_paths() if path not in known]
        return out

    return run


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep. Texts that are null, empty or under 20 words fail the base rule; null
    languages and sources are groups of their own; equal rows share one verdict."""
    return quality_rules.kept_documents(docs)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity: that of the smallest doc_id, null being the last, and of
    equal doc_ids the one whose text's hash is smallest. Texts without words are in no group and all stay; texts that
    aren't linked stay whatever their doc_id; of rows equal in doc_id and text one stays."""
    return jaccard.one_of_each(docs)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark. Each row is judged by its text alone: null and empty ones hold none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times. A null source is one more source; documents without words
    stay once; rows equal in doc_id, text and source share what is taken of them."""
    return mixing.mixed_documents(docs)


@_stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed documents, and the documents read back from them: doc_id, start, n_tokens, ids_crc32. Null
    doc_ids come first; a null or empty text has the end id alone; repeated rows are separate documents."""
    return token_codes.read_tokens(token_codes.write_tokens(docs, tokenizer_path()))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token codes", token_stage),
]

#: The rules' cut-offs, the mix's draws and the token files can't be said in SQL; tests/llm holds the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
