"""A training corpus in four stages: quality rules, near-dedup, substring dedup, packing.

Each stage works on everything the stage before it kept, written as Parquet and read again. All stages but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm import packing, quality, simhash, substring
from flowquarry.llm.queries import END_ID, tokenizer_path
from flowquarry.llm.stage import file_place, settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    return judged.select(*[F.col(c if c in ("doc_id", "text") else f"in_{c}").alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest id stays."""
    place, _ = file_place(docs)
    keep = simhash.near_duplicates(docs, place=place).where("row = keeper").select(F.col("row").alias("_keep"))
    rows = docs.select(place.alias("_place"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    return rows.join(keep, F.col("_place") == F.col("_keep"), "left_semi").select("_doc.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; every document stays, its text rewritten."""
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    # by place, as the documents may have columns of the operator's names
    out = substring.substring_dedup(docs, keep=others, stored=True).toDF(*[f"_{i}" for i in range(len(others))], "_text", "_words", "_removed")
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType), **{c: F.col(f"_{i}") for i, c in enumerate(others)}}
    return out.select(*[new[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in one place of one sequence."""
    parts = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), END_ID)
    return packing.assign(settled(parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")))


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: Tokenising, XXH64 and the fitted score have no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
