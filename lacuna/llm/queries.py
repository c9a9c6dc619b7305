"""Registered queries of the numbered operators: each applies one to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import cdc_fingerprint, chat_format, decontaminate, html_extract, jaccard_join, langid_hd, pii, suffix_dedup, token_align, token_orc, url_rules, vector_codes, vector_pack


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start_word", "end_word")


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op4_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid_hd.predict(docs, langid_hd.learn(langid_hd.train_rows(docs)))
    return found.select("doc_id", langid_hd.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_rules.judge(pages, url_rules.label_urls(pages, table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = vector_pack.pack_documents(table(spark, sf_dir, "documents"), tokens=2048, end_id=0, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.tokens_to_orc(table(spark, sf_dir, "documents"), end_id=1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(odd)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.link_statistics(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: (f, None) for f in (op1_html_templates, op2_decontaminate, op3_repeated_substrings, op4_jaccard_rtree, op5_language_id, op6_url_rules, op7_vector_best_fit, op8_token_orc, op9_pii, op10_fingerprints, op11_chat_format, op12_vector_codes, op13_token_alignment)}
