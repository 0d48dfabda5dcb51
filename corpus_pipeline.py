"""A corpus pipeline of five stages over `documents`: each takes what the one before kept.

A row is told apart by its doc_id and a hash over all its columns: rows that share an id but not a text are documents of their
own, and only rows that are equal in everything are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import mix, pack, quality, simhash, suffix
from barloom.llm.common import materialize, row_hash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the least id."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier too; n_chars is counted anew."""
    cut = suffix.kept_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, or up to three times. Equal rows are taken together."""
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").alias("key"), row_hash(docs).alias("hash"), "text", "source")
    taken = mix.mix(rows, id_col="key", row_col="hash").where("copies > 0").groupBy("doc_id", "row").agg(F.sum("copies").cast("int").alias("copies"))
    taken = materialize(taken.withColumnRenamed("doc_id", "id"))
    one = rows.dropDuplicates(["key", "hash"]).join(taken, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row")))
    return one.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return pack.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("packing", packing),
]

#: The stages can't be written in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
