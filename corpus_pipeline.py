"""From raw to packed documents in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontamination, ngram_join, packing, secrets, toxicity
from tessella.llm.common import shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Null and empty texts are judged by what they lack; repeated rows stay or go
    together; an empty table stays empty; other columns stay as they are."""
    chain = toxicity.train_chain(docs, toxicity.label_categories(table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    return toxicity.keep_clean(docs, chain)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id. Rows that share a doc_id are one document;
    null and empty texts, and rows without a doc_id, stay; an empty table stays empty."""
    return ngram_join.one_of_each(docs, ngram_join.jaccard_links(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark text go. Null and empty texts overlap nothing and stay; repeated rows stay or go together;
    with an empty benchmark all stay."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and n_chars brought up to date; every document stays, with nulls, repeats and other columns as they are."""
    return secrets.redacted_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its place in a sequence of 4096 tokens. A null text has the end token alone; repeated rows are
    packed each; pieces of one length are interchangeable; an empty table gives an empty result."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: Trained models, sampled paths and tokenizers aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, on the table documents."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
