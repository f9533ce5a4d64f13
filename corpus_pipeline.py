"""Corpus pipeline: stages over `documents`, each written as Parquet and read by the next.

In every stage an empty table gives an empty table, repeated rows are each judged, texts are read
whole at any length, and further columns are carried along, those named like an operator's result too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm import decontam, jaccard, langid, mixing, tokenbin
from assetlens.llm.common import Scratch, read_table, shared_dir, stored
from assetlens.llm.queries import MIX, tokenizer_file

#: Share of the tokens that the mix takes.
BUDGET = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those that the classifier rejects (null text, or text without a letter) go.

    A null or wrong ``lang`` doesn't matter, as the text alone is judged.
    """
    found = langid.identify(docs, langid.train(docs))
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of linked documents.

    Null and empty texts link with nothing and stay, as do rows without a doc_id; rows that share the least doc_id all stay.
    """
    found = jaccard.similarity_components(docs)
    copies = found.filter("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty texts have none and stay."""
    found = decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which source, language and topic have their target weights.

    A null source or language is the category ``unknown``; null and empty texts are a topic of their own, without tokens.
    Repeated rows are taken or left together.
    """
    return mixing.mixed(docs, MIX, BUDGET).filter("sampled").select(docs.columns)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus, and each document's place in them; null and empty texts are their end id alone."""
    folder = shared_dir(spark, "corpus-tokens")
    shards = tokenbin.write_token_files(docs, folder, tokenizer_file())
    return tokenbin.token_digest(shards, folder)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_binary),
]
#: SQL can't express the classifier, the raking or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; what the stages before the last wrote is deleted at the end."""
    docs = read_table(spark, sf_dir, "documents")
    with Scratch() as kept:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            docs = kept.stored(stage(spark, docs, sf_dir), f"stage-{k}")
        return stored(STAGES[-1][1](spark, docs, sf_dir), f"stage-{len(STAGES) - 1}")
