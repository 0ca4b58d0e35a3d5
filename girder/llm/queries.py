"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_extract, ivfpq, kdtree, licenses, mixing, repetition, simhash, wordpiece
from .common import spread, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(spread(table(spark, sf_dir, "pages")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_rules(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat", "n_maximal")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat.conversations(table(spark, sf_dir, "conversations"))
    out = chat.preference_format(chat.with_other_reply(convs))
    learned = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    return out.select("conv_id", "prompt_turns", F.length("prompt").alias("prompt_chars"), *digests, learned("chosen_spans").alias("chosen_learned"), learned("rejected_spans").alias("rejected_learned"), "tied")


def op7_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kdtree.shards(table(spark, sf_dir, "documents"), n_shards=kdtree.SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spread(table(spark, sf_dir, "documents")), *bpe.vocabulary_of(spark, VOCABULARY), ids=False)


def op9_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(spread(table(spark, sf_dir, "documents")), bpe.vocabulary_of(spark, VOCABULARY)[0])


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_simhash": op2_simhash,
    "op3_mix": op3_mix,
    "op4_repetition": op4_repetition,
    "op5_licenses": op5_licenses,
    "op6_preference": op6_preference,
    "op7_kdtree": op7_kdtree,
    "op8_bpe": op8_bpe,
    "op9_ivfpq": op9_ivfpq,
    "op10_wordpiece": op10_wordpiece,
}
#: DuckDB SQL with the same rows. The others can't be said in it; tests hold them against brute force.
SQL: dict[str, str] = {"op5_licenses": licenses.sql(), "op6_preference": chat.SQL}
