"""Training-corpus pipeline over ``documents``: STAGES in order, each on all that the one before kept.

Every stage but the last returns the columns of documents. Stages decide by row or by text, never by doc_id: a null or
repeated doc_id is like any other. Of a group of copies, exact ones under one doc_id included, one row stays.
A null or empty text is an empty one, whatever its stage; empty texts are no copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table
from lattica.llm.decontaminate import contamination
from lattica.llm.minhash import near_duplicates
from lattica.llm.packing import pack
from lattica.llm.pii import redact
from lattica.llm.toxicity import fit, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5; labels of a fifth of the ids stay out of its fit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    docs = docs.select(*COLUMNS)
    return score(docs, fit(docs, labels)).where("score < 0.5").select(*COLUMNS)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, of those of least doc_id (null is the last)."""
    numbered = table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")  # written, so that a row keeps its number
    classes = near_duplicates(numbered.select("row", "text"), doc_id="row").select(F.col("doc_id").alias("row"), "class_id")
    members = table(classes.join(numbered.select("row", "doc_id"), "row"), "members")
    first = members.groupBy("class_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("stays"))
    first = table(first.where("n > 1").select("class_id", "stays"), "first")  # written, so that the join below can split a large class
    gone = table(members.join(first, "class_id").where("row <> stays").select("row"), "copies")
    return numbered.join(gone, "row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Rows of one text share its fate, whatever their doc_ids."""
    docs = docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    found = contamination(docs.select("key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    gone = table(found.where("n_hit > 0").select("doc_id").distinct().withColumnRenamed("doc_id", "key"), "contaminated")
    return docs.join(gone, "key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind, and their new lengths."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    # workers serve the other stages too, so the tokenizer goes with the task
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=False)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_documents),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packing),
]

#: Neither a fitted machine's scores nor token ids have an SQL form; tests check which documents each stage keeps on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
