"""Registered queries of the text operators (thin: operator, then digest columns)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bodega.llm import (bpe, decontamination, lang_id, ngram_lm, prefix_trie, quality_rules, rare_features, simhash, substring_dedup,
                        token_counts, token_ids, toxicity, vector_codes)
from bodega.llm.common import id_residue, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_residue("doc_id", 4) == 2
    dicts = lang_id.learn_dictionaries(docs.where(~held_out))
    return lang_id.identify_languages(docs, dicts).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("rest.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    token_ids.write_token_shards(table(spark, sf_dir, "documents"), path)
    return token_ids.read_token_shards(spark, path)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("text", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_residue("doc_id", 3) == 1
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted",
                                                         F.lit(model.n_swaps).cast("long").alias("swaps_penalised"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_residue("doc_id", 7) == 2
    model = ngram_lm.train_on(docs.where(~held_out))
    return ngram_lm.score_texts(docs, model).withColumn("held_out", held_out)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_features.fingerprint_documents(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_token_counts, op4_token_ids, op5_bpe, op6_toxicity,
                                    op7_quality_rules, op8_simhash, op9_ngram_lm,
                                    op10_decontamination, op11_prefix_trie, op12_rare_features, op13_vector_codes)}
ORACLE: dict[str, str] = {"op11_prefix_trie": prefix_trie.ORACLE_SQL, "op13_vector_codes": vector_codes.oracle_sql()}
