"""A corpus cleaned and tokenized in five stages, each calling one text operator.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet to the shared folder and read again as the next stage's docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bodega.llm import bpe, decontamination, simhash, substring_dedup, toxicity
from bodega.llm.common import id_residue, scratch
from bodega.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier rejects go. It learns as its own query does."""
    labels = table(spark, sf_dir, "labels").where(id_residue("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that begin in a document with a smaller id are cut out; a
    text that loses nothing stays as it is. n_chars follows the text."""
    out = substring_dedup.remove_repeats(docs, unchanged_as_is=True)
    cols = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of the text decoded from them."""
    coded = bpe.encode(docs, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encode_decode", encode),
]

#: The classifier's weights cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
