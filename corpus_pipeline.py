"""A training corpus from `documents` in five stages; each reads what the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitab.llm import bpe, langid, mixing, simhash, substring_dedup
from lexitab.llm._support import checkpoint_dir, fresh, remove, workspace, write_table
from lexitab.llm.queries import DOMAINS, VOCABULARY, domain_of_labels

#: Shares of all tokens after mixing; documents whose likeliest domain is good or plain stay, whatever the shares.
WEIGHTS = {"good": 0.8, "plain": 0.15, "toxic": 0.05}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or unlike every language go."""
    model = langid.train(docs)
    flags = fresh(docs, "of_language")[0]
    judged = langid.identify(docs, model, prefix=flags)
    return judged.where(f"not `{flags}rejected`").select(*[f"`{c}`" for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has; n_chars follows the text."""
    out = substring_dedup.remove_repeats(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as its fitted rate says."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = mixing.train_domains(docs, labels, domain_of_labels(), DOMAINS)
    mixed, _ = mixing.mix(docs, model, WEIGHTS, keep=["good", "plain"])
    return mixing.take(docs, mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests and those of the decoded bytes."""
    return bpe.encode_documents(docs, vocabulary=VOCABULARY, with_ids=True).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]
#: The stages train models and follow hash functions that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents table; each result is written in the shared folder and read again.

    What a stage leaves there besides, and what the stage before it has written, goes once its result is written; the folder of the
    last result stays, for its reader to remove.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    last = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        with workspace(spark):
            write_table(stage(spark, docs, sf_dir), path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
