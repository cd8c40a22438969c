"""A training corpus from raw documents, in five stages, each a table of its own.

Every stage takes ``(spark, docs, sf_dir)`` and returns documents, all their columns as
they were given, but the last, which returns the token ids' digests. Its rows are written
to the shared folder and read again as the next stage's input, so a lost executor costs
one stage's tasks, never the chain's.

Null, empty and repeated rows, ties, empty tables and further columns: as each operator
states. The near-duplicate stage keeps one document of each group, that with the least
``doc_id``; groups follow from links, so two documents of a group need not be linked
themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import materialized, table
from tablepact.llm.decontaminate import without_contained
from tablepact.llm.jaccard import one_of_each
from tablepact.llm.pii import redacted
from tablepact.llm.quality import judged_by_rules
from tablepact.llm.tokens import bpe_digests, encoded_by_words, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    judged, _, kept = judged_by_rules(docs, table(spark, sf_dir, "labels"))
    return judged.where(F.col(kept)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contained(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, encoded and decoded, as digests."""
    # Half of the usual chunk: by this stage the executors hold what earlier ones have grown to.
    return bpe_digests(encoded_by_words(docs, tokenizer(), chunk=8_000_000))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding", token_ids),
]

#: SQL has no tokenizer and no groups of near duplicates; tests/llm compares with the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
