"""Pipeline over ``documents``: quality, near copies, benchmark passages, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes what a stage returns to the shared folder and reads it again
for the next one, so a lost executor costs at most one stage.

Defined results: null and empty texts pass the stages after the first and have no tokens; of rows that share an id one stays in
the second stage; rows without an id stay; columns beside those of documents are kept up to the last stage; an empty table gives an
empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.bpe import token_digests
from barloom.llm.common import staged, table
from barloom.llm.decontaminate import decontaminated
from barloom.llm.ngram_join import one_of_each
from barloom.llm.quality import keep_quality
from barloom.llm.secret_scan import redacted

TOKENIZER = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its number of tokens, and digests of the ids and of what they decode to."""
    return token_digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: No SQL: the classifier is fitted and tokens are merged step by step; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
