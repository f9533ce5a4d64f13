"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, langid, linededup, media, mixing, prefixtrie, quality, ranked, secrets, tokenbin, topk
from .common import read_table, shared_dir


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "media")
    media.write_archives(read_table(spark, sf_dir, "documents"), folder)
    return media.media_digest(media.read_archives(spark, folder))


#: Targets of the mix: shares of languages, and powers of the present shares of sources and topics.
MIX = {"source": 0.7, "lang": {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}, "topic": 0.8}


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.recurring_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(read_table(spark, sf_dir, "documents"), MIX, 0.5)
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.chat_digest(turns.unionByName(extra))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every document through one ledger, the earlier one under the base rules alone.

    The second pass scans what the first left: new blobs, and further rules of blobs already seen.
    """
    documents, ledger = read_table(spark, sf_dir, "documents"), shared_dir(spark, "secret-ledger")
    secrets.update_ledger(secrets.first_saved(documents), ledger)
    return secrets.secret_digest(documents, ledger)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    shards = tokenbin.write_token_files(read_table(spark, sf_dir, "documents"), folder, tokenizer_file())
    return tokenbin.token_digest(shards, folder)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).drop("text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    found = langid.identify(documents.select("doc_id", "text"), langid.train(documents))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner(read_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_line_dedup, op3_source_mixing, op4_chat_formatting, op5_secret_scan, op6_token_binary, op7_decontamination, op8_language_id, op9_ngram_jaccard, op10_quality, op11_prefix_trie, op12_top_inner, op13_ranked_search)}
